"""The random field against enumeration, and held-out accuracy."""

from __future__ import annotations

import itertools

import numpy as np

from kmerloom.llm import quality

from .odd import empty_docs, odd_docs


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([3, 1, 0, 4])
    e, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, pair, z = quality.forward_backward(e, trans, counts)
    want, want_pair, want_z, at = np.zeros_like(e), np.zeros((2, 2)), 0.0, 0
    for n in counts:
        if not n:
            continue
        paths = list(itertools.product((0, 1), repeat=n))
        s = np.array([sum(e[at + i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        want_z += np.log(np.exp(s).sum())
        for p, w in zip(paths, np.exp(s) / np.exp(s).sum()):
            for i, y in enumerate(p):
                want[at + i, y] += w
            for a, b in zip(p, p[1:]):
                want_pair[a, b] += w
        at += n
    assert np.allclose(got, want) and np.allclose(pair, want_pair) and np.isclose(z, want_z)


def test_lines_and_neighbours():
    x, length, counts = quality.line_features([b"AB cd\n\nef! ef!", b"", b"one | two"])
    assert counts.tolist() == [2, 0, 1] and length.tolist() == [5, 7, 9]
    assert np.isclose(x[0, 0], 0.5) and np.isclose(x[1, 2], 2 / 6) and np.isclose(x[1, 7], 0.5)
    assert np.allclose(x[0, 20:30], x[1, :10]) and np.allclose(x[1, 10:20], x[0, :10])
    assert x[:, 30:].tolist() == [[1, 0, 1], [1, 1, 0], [1, 0, 0]]


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op2_quality(spark, at).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert len(rows) == 1000 and sum(p == q for p, q in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_odd_rows(spark):
    docs, labels = odd_docs(spark), spark.createDataFrame([(1, 1), (1, 1), (5, 0), (7, None), (None, 1), (9, 1), (9, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    rows = out.collect()
    assert len(rows) == 14 and set(docs.columns) < set(out.columns)
    assert {r.score for r in rows if not (r.text or "").strip()} == {model.base}
    assert quality.score(empty_docs(spark), model).count() == 0
    none = quality.fit(empty_docs(spark), labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_all_lines_of_a_long_document_are_learnt(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "train", lambda x, length, counts, label: seen.update(counts=counts.tolist(), rows=(len(x), len(length))))
    docs = spark.createDataFrame([(i, "\n".join(f"line {k}" for k in range(n))) for i, n in ((1, 450), (3, 2))], "doc_id long, text string")
    ids = [r.doc_id for r in docs.where(~quality.held_out()).collect()]
    quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"))
    assert 1 in ids and seen["counts"][0] == 450 and seen["rows"] == (sum(seen["counts"]),) * 2
