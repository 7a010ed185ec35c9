"""What an index promises beside its queries' results: folds that merge, plans that read only what is asked for."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import build
from kmerloom.operators.index import Index


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows_of(spark, values):
    return spark.createDataFrame(values, "key long, value double")


def test_inserts_fold_on_or_refuse(spark):
    first, more = rows_of(spark, [(1, 5.0), (1, 6.0)]), rows_of(spark, [(1, 100.0), (2, 1.0)])
    assert dict(Index.build(first, ["key"], kind="reduction").insert(more).rows.collect()) == {1: 111.0, 2: 1.0}
    assert dict(Index.build(first, ["key"], kind="reduction", fold=F.max).insert(more).insert(more).rows.collect()) == {1: 100.0, 2: 1.0}
    assert dict(Index.build(first, ["key"], kind="reduction", fold=F.count, merge=F.sum).insert(more).insert(first).rows.collect()) == {1: 5, 2: 1}
    with pytest.raises(ValueError, match="merge"):
        Index.build(first, ["key"], kind="reduction", fold=F.avg).insert(more)


def test_a_find_on_a_stored_sorted_index_reads_the_range_of_its_queries(spark):
    entries = spark.range(100_000).select(F.col("id").alias("key"), (F.col("id") * 2).cast("double").alias("value"))
    stored = Index.build(entries, ["key"], kind="multimap", sorted_by_range=True).saved()
    found = stored.find(spark.createDataFrame([(500,), (510,), (-1,)], "key long"))
    assert sorted(map(tuple, found.collect())) == [(500, 1000.0), (510, 1020.0)]
    text = plan(found)
    assert "GreaterThanOrEqual(key,-1)" in text and "LessThanOrEqual(key,510)" in text and "BroadcastHashJoin" in text


def test_counts_and_exists_look_at_the_asked_keys_first(spark):
    entries = spark.range(1000).select((F.col("id") % 100).alias("key"), F.col("id").cast("double").alias("value"))
    i = Index.build(entries, ["key"], kind="multimap")
    asked = spark.createDataFrame([(5,), (5,), (777,)], "key long")
    assert dict(i.count(asked).collect()) == {5: 10, 777: 0} and dict(i.exists(asked).collect()) == {5: 1, 777: 0}
    assert "LeftSemi" in plan(i.count(asked)) and "LeftSemi" in plan(i.exists(asked))
    again = Index.build(entries, ["key"], kind="multimap", dedupe=False)
    assert sorted(map(tuple, again.count(asked).collect())) == [(5, 10), (5, 10), (777, 0)]
    assert sorted(map(tuple, again.exists(asked, F.col("value") > 900).collect())) == [(5, 1), (5, 1), (777, 0)]


def test_files_to_indices(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@a\nACGTN\n+\nIIIII\n@b\nCCAC\n+\nIIII\n")
    path = str(tmp_path / "r.fastq")
    assert dict(build.count_index(path, 2, spark=spark).rows.collect()) == {"AC": 2, "CG": 1, "GT": 1, "TA": 1, "CC": 1, "CA": 1}
    kept = build.records_of(spark, path, n="drop")
    assert {r.kmer for r in build.kmer_index(kept, 2).rows.collect()} == {"CC", "CA", "AC"}
    cut = build.records_of(spark, path, n="split")
    assert dict(build.count_index(cut, 2, model="canonical").rows.collect()) == {"AC": 3, "CG": 1, "CC": 1, "CA": 1}
    at = {(r.kmer, r.value.record_start, r.value.offset) for r in build.position_index(cut, 3).rows.collect()}
    assert at == {("ACG", 0, 0), ("CGT", 0, 1), ("CCA", 17, 0), ("CAC", 17, 1)}
    assert build.position_quality_index(kept, 4).rows.first().value.quality > 0.999
    with pytest.raises(ValueError):
        build.tuples(kept, 3, "other")
