"""The Pitman-Yor model: base scores in plain Python, probabilities that sum to one, draws against enumeration."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kmerloom.llm import language_model as lm

from .odd import empty_docs, odd_docs


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[ \x09-\x0D]+", low) if w] + [None]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain(docs):
    c = Counter(w for i, t in docs if not is_held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        w = words(t)
        out.append((i, is_held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return sorted(out, key=str), c


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9)


def test_base_scores_and_gain(spark):
    at = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    rows = lm.op6_language_model(spark, at).collect()
    key = lambda r: str(r)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=lambda r: r[0])
    close(got, sorted(plain(docs)[0], key=lambda r: r[0]))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)
    assert all(r.score < 0 for r in rows) and key(rows[0])


@pytest.mark.parametrize("shard_tokens", [100, 10**6])
def test_probabilities_sum_to_one(spark, shard_tokens, monkeypatch):
    """With small shards, many contexts are cut into parts; the coded words are few, so that both forms occur."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(lm, "CODED_WORDS", 9)
    train = [(i, " ".join(f"w{(i * k * k + k) % 37 if k % 3 else k % 5}" for k in range(60))) for i in range(40) if not is_held(i)]
    vocab = sorted({w for _, t in train for w in words(t) if w})
    held = [i for i in range(1000, 90000) if is_held(i)]
    probes = list(zip(held, [f"{a} {b}" for a in ("w0", "w3", "w7", "never") for b in [*vocab, "never-seen", ""]]))
    got = lm.probabilities(spark.createDataFrame(train + probes + [(held[-1], "")], "doc_id long, text string")).collect()
    count, size, by, known = Counter(), Counter(), {}, {}
    for _, t in train:
        for a, b in zip([None, *words(t)], words(t)):
            count[a, b] += 1
            size[b] += 1
    name = {int(lm._tokens([w.encode()])[0][0].view(np.int64)): w for w in [*vocab, "never", "never-seen"]} | {int(np.uint64(lm._END).view(np.int64)): None}
    for r in got:
        assert r["count"] == count[name[r.context], name[r.word]] and r.word_count == size[name[r.word]]
        by.setdefault(name[r.context], {})[name[r.word]] = r.p
    for a in ("w0", "w3", "w7", "never"):
        known = {w: p for w, p in by[a].items() if size[w]}
        assert math.isclose(sum(known.values()) + by[a]["never-seen"], 1, rel_tol=1e-9), a


def test_shards_and_codes_change_little(spark, monkeypatch):
    """Draws differ by shard, but the scores of a model of 6 sweeps stay close, and pairs, words and tokens are the same."""
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"v{x}" for x in rng.zipf(1.4, 80) % 300)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = {r.doc_id: r for r in lm.scores(df).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", 150)
    monkeypatch.setattr(lm, "_BLOCK", 700)
    many = {r.doc_id: r for r in lm.scores(df).collect()}
    for i, r in one.items():
        assert r[:5] == many[i][:5] and math.isclose(r.base_score, many[i].base_score, rel_tol=1e-9) and math.isclose(r.score, many[i].score, rel_tol=0.02)
    assert any(r.score != many[i].score for i, r in one.items())


def test_table_draws_match_their_distribution():
    d, c, a = 0.6, 6, 0.8
    p = np.exp(lm._stirling(d)[c] + np.arange(1, c + 1) * np.log(a))
    p /= p.sum()
    same = lambda a: lambda i, j: np.full(np.broadcast(i, j).shape, a)
    seen = np.bincount(lm.draw_tables(np.full(40000, c), same(a), d, np.random.default_rng(1)), minlength=c + 1)[1:] / 40000
    assert np.abs(seen - p).max() < 0.012
    rng = np.random.default_rng(2)
    exact = lm.draw_tables(np.full(3000, lm._EXACT), same(3.0), d, rng)  # the last count drawn from its conditional, and one beyond
    crowd = lm.draw_tables(np.full(3000, lm._EXACT + 100), same(3.0), d, rng)
    assert abs(crowd.mean() / exact.mean() - 1) < 0.1 and (crowd <= lm._EXACT + 100).all()


def test_a_sweep_draws_from_the_conditional_of_all_other_tables():
    """One context, two words, one root table each: many sweeps visit the numbers of tables as often as enumeration says."""
    d, c = 0.5, np.array([3, 4])
    rise = lambda x, n, step: sum(math.log(x + step * i) for i in range(n))
    s = lm._stirling(d)
    states = [(i, j) for i in range(1, 4) for j in range(1, 5)]
    p = {t: math.exp(rise(1.0, sum(t), d) - rise(1.0, sum(t), 1.0) + sum(s[n][k - 1] + s[k][0] for n, k in zip(c, t))) for t in states}
    t, seen, rng, one = np.array([1, 1]), Counter(), np.random.default_rng(3), np.array([1])
    for _ in range(6000):
        for k in (0, 1):
            others = np.array([t.sum() - t[k]])
            t[k] = lm.draw_tables(c[k : k + 1], lm.pair_weights(t[k : k + 1], others, 0 * one, one, others, 1e-9, d), d, rng)[0]
        seen[tuple(t.tolist())] += 1
    assert max(abs(seen[x] / 6000 - p[x] / sum(p.values())) for x in states) < 0.03


def test_stirling_by_recounting():
    d, got = 0.3, lm._stirling(0.3)
    # arrangements of 3 customers: one table (1-d)(2-d); two tables 3(1-d); three tables 1
    assert np.allclose(np.exp(got[3]), [(1 - d) * (2 - d), 3 * (1 - d), 1])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = lm.scores(docs).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
    close(got, plain([(r.doc_id, r.text) for r in docs.collect()])[0])
    assert lm.scores(empty_docs(spark)).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(30) if is_held(i)], "doc_id long, text string")
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in lm.scores(only_held).collect())


def test_every_preceding_word_is_a_context(spark):
    """Each of 600 words is always followed by its own one: more contexts than any fixed number of frequent words holds."""
    ids = [i for i in range(4000) if not is_held(i)][:1200]
    train = [(i, f"a{k % 600} b{k % 600}") for k, i in enumerate(ids)]
    held = [i for i in range(4000, 20000) if is_held(i)][:600]
    right = [(i, f"a{k} b{k}") for k, i in enumerate(held[:300])]
    wrong = [(i, f"a{k} b{(k + 1) % 600}") for k, i in enumerate(held[300:])]
    score = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(train + right + wrong, "doc_id long, text string")).collect()}
    assert all(score[a] > score[b] + 1 for (a, _), (b, _) in zip(right, wrong))
