"""The n-gram Jaccard join against all pairs, in plain Python and in SQL."""

from __future__ import annotations

import random
import re

import duckdb

from kmerloom.llm import common, graph, near_duplicates

from .odd import empty_docs, odd_docs


def grams(text, n=5):
    w = [x for x in re.split(r"[ \x09-\x0D]+", text or "") if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def plain(docs, similarity=0.8):
    """{row number: (class, links)} by comparing all pairs of different texts."""
    texts = sorted({t or "" for _, t in docs})
    sets = [grams(t) for t in texts]
    up, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    at = {t: i for i, t in enumerate(texts)}
    first: dict = {}
    for d, t in docs:
        if grams(t):
            c = find(at[t or ""])
            first[c] = min(first.get(c, d), d)
    return sorted((d, first[find(at[t or ""])] if grams(t) else d, links[at[t or ""]]) for d, t in docs)


def variants(rng, count=60):
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for k in range(5):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(count // 5):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    docs += ["few words", "few  words", "few words here", "", None, "x", docs[0].replace(" ", "\n"), docs[0]]
    return [(i, t) for i, t in enumerate(docs)]


def got(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.near_duplicates(df, **options).collect())


def test_matches_all_pairs_over_many_blocks(spark, monkeypatch):
    docs = variants(random.Random(11))
    want = plain(docs)
    assert got(spark, docs) == want
    real = near_duplicates.near_classes
    monkeypatch.setattr(near_duplicates, "near_classes", lambda *a: real(*a, block=4))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert got(spark, docs) == want


def test_matches_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = con.sql(near_duplicates.OP9_SQL)
    rows = near_duplicates.op9_near_duplicates(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())


def test_odd_rows_and_keep_one(spark):
    docs = odd_docs(spark)
    rows = near_duplicates.near_duplicates(docs).collect()
    assert len(rows) == 14
    one, seven = (next(r for r in rows if r.doc_id == i) for i in (1, 7))
    assert one.class_id == seven.class_id == 1 and one.n_links == 0
    assert near_duplicates.near_duplicates(empty_docs(spark)).count() == 0
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [(str(r.doc_id), r.text[:9] if r.text else r.text) for r in kept.collect()]
    assert ("7", "one two t") not in ids and ("1", "one two t") in ids
    assert sum(i == "9" for i, _ in ids) == 2 and sum(i in ("2", "3", "4") for i, _ in ids) == 3 and sum(i in ("5", "6") for i, _ in ids) == 1


def test_bands_reach_the_recall():
    for s, rows in ((0.8, 7), (0.8, 4), (0.6, 3)):
        b = near_duplicates.bands_for(s, 0.999, rows)
        assert 1 - (1 - s**rows) ** b >= 0.999 > 1 - (1 - s**rows) ** (b - 1)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}
    assert graph.components(edges.limit(0)).count() == 0
