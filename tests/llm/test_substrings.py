"""Substring dedup against counting all windows, in plain Python and in SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm import substrings

from .odd import empty_docs, odd_docs


def plain(docs, n):
    words = [[w for w in re.split(r"[ \x09-\x0D]+", t or "") if w] for _, t in docs]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def run(spark, docs, window, gram):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, substrings.drop_repeats(df, window, gram).collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=25), st.integers(1, 3)), max_size=5), st.integers(2, 6))
def test_automaton_counts_occurrences(rows, window):
    a, seen = substrings.Automaton(), Counter()
    for s, weight in rows:
        a.add(list(s), weight)
        for i in range(len(s) - window + 1):
            seen[s[i : i + window]] += weight
    a.count()
    for s, _ in rows:
        want = sum(1 << i for i in range(len(s) - window + 1) if seen[s[i : i + window]] > 1)
        assert a.repeated(list(s), window) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=60), max_size=6))
def test_each_window_is_in_one_segment(docs):
    texts = [" ".join(d).encode() for d in docs]
    d, start, run, anchor, ids = substrings.segments(texts, 9, 3)
    got = [(int(i), int(s) + k) for i, s, r in zip(d, start, run) for k in range(r)]
    assert sorted(got) == [(i, s) for i, x in enumerate(docs) for s in range(len(x) - 8)]
    assert all(r <= 7 for r in run)
    by = {}
    for i, s, r, a, h in zip(d, start, run, anchor, ids):
        for k in range(r):
            assert by.setdefault(tuple(docs[i][s + k : s + k + 9]), int(a)) == int(a)


@pytest.mark.parametrize("large", [False, True])
def test_matches_counting_all_windows(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(substrings, "SHARD_SEGMENTS", 1)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(8, 40))] for _ in range(5)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(shared)[rng.randint(0, 4) :] if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        docs.append((i, " ".join(w)))
    docs += [(60, None), (61, ""), (None, "x " * 30), (3, docs[3][1]), (3, "x y " * 20), (62, "short one")]
    assert run(spark, docs, 10, 3) == plain(docs, 10)


def test_matches_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = con.sql(substrings.OP5_SQL)
    got = substrings.op5_substrings(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = sorted(map(tuple, substrings.drop_repeats(docs).collect()), key=str)
    assert rows == plain([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert substrings.drop_repeats(empty_docs(spark)).count() == 0
