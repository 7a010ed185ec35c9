"""Files of very many small splits, and numbers of their records."""

from __future__ import annotations

import pytest

from kmerloom.plans import registry
from kmerloom.sources import seqfiles


@pytest.mark.parametrize("split", [7, 40, 1000])
def test_small_splits_share_tasks(spark, tmp_path, split):
    for f in range(2):
        (tmp_path / f"{f}.fastq").write_text("".join(f"@{f}-{i}\n{'ACGT' * (1 + i % 5)}\n+\n{'@III' * (1 + i % 5)}\n" for i in range(400)))
    df = seqfiles.read(spark, str(tmp_path), split)
    assert df.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    got = seqfiles.with_numbers(df).orderBy("seq_index").collect()
    assert [(r.seq_index, r.name, len(r.seq)) for r in got] == [(400 * f + i, f"{f}-{i}", 4 * (1 + i % 5)) for f in range(2) for i in range(400)]


def test_numbering_leaves_sequences_where_they_are(spark, sf_dir):
    plan = registry.queries()["record_numbers"](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "seq_index" in plan and "qual#" not in plan and "Window [row_number" not in plan
