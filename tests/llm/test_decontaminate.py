"""Decontamination against its SQL and against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb

from kmerloom.llm import decontaminate

from .odd import empty_docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, bench, n=13):
    windows = {}
    for item, text in bench:
        w = words(text)
        k = min(len(w), n)
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    items |= windows[tuple(w[a : a + k])]
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    from pyspark.sql import functions as F

    out = decontaminate.contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("h"), "contaminated")
    return sorted(map(tuple, out.collect()), key=str)


def test_matches_plain_python(spark):
    rng = random.Random(5)
    vocab = ["a", "B", "c1", "é", "É", "the", "x-y"]
    long = [" ".join(rng.choice(vocab) for _ in range(rng.randint(12, 40))) for _ in range(12)]
    bench = [(i, t) for i, t in enumerate(long)] + [(20, "short Item é"), (21, ""), (22, None), (10, long[0]), (0, long[0]), (23, "a a a a a a a a a a a a a a a")]
    docs = [(i, " ".join([rng.choice(vocab) for _ in range(30)] + long[i % 12].upper().split()[rng.randint(0, 5) :] + ["zz"] * (i % 3))) for i in range(30)]
    docs += [(100, None), (101, ""), (None, long[3]), (None, long[3]), (5, "SHORT, item. é!"), (5, "a " * 40), (102, "short item É")]
    assert run(spark, docs, bench) == plain(docs, bench)
    assert run(spark, docs, [(1, None)]) == plain(docs, [(1, None)])


def test_matches_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(decontaminate.OP7_SQL)
    got = decontaminate.op7_decontaminate(spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_odd_rows_postings_and_drops(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "tail w976")], "item_id long, text string")
    docs = odd_docs(spark)
    rows = decontaminate.contamination(docs, bench).collect()
    assert len(rows) == 14 and sum(r.contaminated for r in rows) == 2
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 12
    assert decontaminate.contamination(empty_docs(spark), bench).count() == 0
    index = decontaminate.PositionalIndex.build(docs, spark.createDataFrame([("b",), ("one",), ("never",)], "term string"))
    p = index.postings.join(index.terms, "term_id").join(index.catalog, "row").collect()
    assert sorted((r.doc_id, r.term, r.pos) for r in p) == [(1, "one", 0), (7, "one", 0), (9, "b", 1), (9, "b", 1)]
    assert {r.term: r.n for r in index.terms.collect()} == {"b": 2, "one": 2, "never": 0} and index.catalog.count() == 14


def test_one_window_in_a_long_text_is_enough_to_drop_it(spark):
    passage = " ".join(f"q{i}" for i in range(13))
    docs = spark.createDataFrame([(1, "z " * 5000 + passage + " y" * 5000, 0), (2, "z " * 100 + passage.replace("q12", "q11"), 0), (None, passage, 0), (None, None, 0)], "_doc_id long, text string, bad int").withColumnRenamed("_doc_id", "doc_id")
    docs = docs.withColumn("_doc_id", docs.bad).withColumn("key", docs.bad).withColumn("_row", docs.bad).withColumn("row", docs.bad)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, bool(r.text)) for r in kept.collect()) == [(0, False), (2, True)]
    assert decontaminate.drop_contaminated(docs, bench, least_share=0.05).count() == 3


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    from kmerloom.llm import common

    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "tail w976")], "item_id long, text string")
    near = lambda: sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    want = near()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert near() == want


def test_proximity_against_plain_python(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(40)]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 6)))) for i in range(12)] + [(90, ""), (91, None)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    count = {}
    for _, t in docs:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    want = {}
    for i, t in docs:
        w = words(t)
        for j, b in bench:
            rare = sorted(set(words(b)), key=lambda x: (count.get(x, 0), x))[:3]
            at = [p for p, x in enumerate(w) if rare and x == rare[0]]
            if any(all(any(abs(p - q) <= 30 and x == r for q, x in enumerate(w)) for r in rare) for p in at):
                want[i] = want.get(i, 0) + 1
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {r.doc_id: r.n_near for r in got.collect() if r.n_near} == want


def test_the_query_reads_the_stored_lists(spark, monkeypatch):
    """With the postings taken away nothing is found: there is no other path to a match."""
    build = decontaminate.PositionalIndex.build

    def emptied(docs, terms):
        index = build(docs, terms)
        index.postings = index.postings.limit(0)
        return index

    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.contamination(docs, bench).first().n_hit == 3
    monkeypatch.setattr(decontaminate.PositionalIndex, "build", staticmethod(emptied))
    assert decontaminate.contamination(docs, bench).first().n_hit == 0
