"""k-mers counted by runs of neighbouring windows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from kmerloom.operators import generate
from kmerloom.plans import registry
from kmerloom.plans.common import raw_texts


def plain(texts, k):
    read = ["".join(c.upper() if c in "ACGTacgt" else "A" for c in t or "") for t in texts]
    return Counter(t[i : i + k] for t in read for i in range(len(t) - k + 1))


@pytest.mark.parametrize("k", [32, 62, 63])
def test_counts_by_runs(spark, k):
    r = random.Random(k)
    texts = ["", None, "A" * 500, "acgtX" * 30, "é" * 70, "ACGT" * 16] + ["".join(r.choice("ACGTaxyz é") for _ in range(r.randrange(500))) for _ in range(60)]
    texts += texts[:40]
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    want = plain(texts, k)
    for least in (1, 2):
        got = [tuple(x) for x in generate.count_runs(df, k, least).collect()]
        assert len(got) == len(dict(got)) and dict(got) == {a: n for a, n in want.items() if n >= least}


def test_a_bucket_larger_than_a_pass(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(generate, "AT_ONCE", 50)
    monkeypatch.setattr(generate, "MOST", 200)
    texts = ["ACGTTGCA" * 40, "TTGAC" * 60, "C" * 300] * 3
    runs = pa.Table.from_batches(list(generate._run_batches([pa.RecordBatch.from_arrays([pa.array(texts)], ["seq"])], 63))).sort_by("bucket")
    got = [x for b in generate._run_counts(runs.to_batches(max_chunksize=2), 63, 1) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(got) == len(dict(got)) and dict(got) == plain(texts, 63)


def test_equal_hashes_of_different_keys():
    high, low = np.array([5, 5, 3, 5, 3], np.uint64), np.array([1, 2, 1, 1, 1], np.uint64)
    got = generate._wide_sums(high, low, np.zeros(5, np.uint64), np.ones(5, np.int64))
    assert [x.tolist() for x in got] == [[3, 5, 5], [1, 1, 2], [2, 2, 1]]


@pytest.mark.parametrize("name", ["kmer_count_63", "kmer_repeated_63"])
def test_no_window_is_shuffled_by_itself(spark, sf_dir, name):
    """What is dealt to tasks are few rows: one for many windows."""
    windows = sum(max(len(r.seq) - 62, 0) for r in raw_texts(spark, sf_dir).collect())
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "bases" in plan
    runs = raw_texts(spark, sf_dir).select("seq").mapInArrow(lambda it: generate._run_batches(it, 63), generate._RUN)
    assert 10 * runs.count() < windows
