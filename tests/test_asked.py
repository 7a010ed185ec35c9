"""Positions of the k-mers asked for alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import build


@pytest.mark.parametrize("k", [3, 14])
@pytest.mark.parametrize("made", [build.position_index, build.position_quality_index])
def test_made_as_asked_equals_the_join(spark, k, made):
    rows = [(0, 10 * i, f"r{i}", t, "I5!" * (len(t) // 3) + "7") for i, t in enumerate(["ACGTTGCAACGTACGTTGCAACGT", "acgxé", "AC", "", "TTTTTTTTTTTTTTTTT", "ACGTTGCAACGTACGTTG"])]
    records = spark.createDataFrame(rows, "file_id int, record_start long, name string, seq string, qual string")
    index = made(records, k, more=("name",))
    asked = index.rows.select("kmer").where(F.col("kmer").substr(1, 1) != "T").unionByName(spark.createDataFrame([("NNN",), (None,), ("AC",), ("acg",)], "kmer string"))
    plan = index.find(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    show = lambda df: sorted(str(r) for r in df.collect())
    want = index.rows.join(asked.distinct(), "kmer")
    assert show(index.find(asked)) == show(want) and want.count() > 0
    changed = index.erase(asked.limit(1))
    assert "Join" in changed.find(asked)._jdf.queryExecution().optimizedPlan().toString()
