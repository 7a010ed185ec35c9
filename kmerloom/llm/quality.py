"""Quality classifier: a linear-chain conditional random field over the lines of a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, documents, fresh_name, mix, prepare, text_or_empty, words_of

#: Byte classes whose shares describe a line; 0 is anything else (lower-case letters, letters beyond ASCII).
_UPPER, _DIGIT, _BLANK, _BANG, _PIPE, _STOP, _ODD = range(1, 8)
_CLASS = np.zeros(256, np.uint8)
for _kind, _chars in ((_DIGIT, "0123456789"), (_BLANK, " \t\r\v\f"), (_BANG, "!"), (_PIPE, "|"), (_STOP, ".,;:'\"?-()"), (_ODD, "#$%&*+/<=>@[\\]^_`{}~")):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _kind
_CLASS[65:91] = _UPPER
OWN = 10
N_FEATURES = 3 * OWN + 3


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line that isn't blank, its length in bytes, number of such lines of each text).

    A line's own features: shares of upper case, digits, "!", "|", usual and other punctuation, mean
    word length, share of distinct words, number of words, whether the text had the same line before. Then
    the same of the lines before and after, and three constants: 1, has a line before, has one after.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    doc = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
    kind = _CLASS[data]
    length = (ends - starts).astype(np.float64)
    count = {k: np.add.reduceat((kind == k).view(np.uint8), starts, dtype=np.int64)[: len(starts)] for k in range(1, 8)}
    lines = [memoryview(data)[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    h, line, n_words = words_of(lines)
    own = mix(h + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    new = np.ones(len(own), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    distinct = np.bincount(line[order], new, len(lines)) if len(own) else np.zeros(len(lines))
    keep = n_words > 0
    seen: set = set()
    again = np.zeros(len(lines))
    for i in np.flatnonzero(keep).tolist():
        key = (int(doc[i]), lines[i])
        if key in seen:
            again[i] = 1
        seen.add(key)
    length, doc, n = length[keep], doc[keep], n_words[keep].astype(np.float64)
    solid = np.maximum(length - count[_BLANK][keep], 1)
    own_cols = [count[k][keep] / solid for k in (_UPPER, _DIGIT, _BANG, _PIPE, _STOP, _ODD)]
    x = np.stack([*own_cols, solid / n / 10, distinct[keep] / n, np.log1p(n) / 5, again[keep]], 1)
    m = len(x)
    prev_ok, next_ok = np.zeros(m, bool), np.zeros(m, bool)
    if m:
        same = doc[1:] == doc[:-1]
        prev_ok[1:], next_ok[:-1] = same, same
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    out = np.concatenate([x, before * prev_ok[:, None], after * next_ok[:, None], np.ones((m, 1)), prev_ok[:, None], next_ok[:, None]], 1)
    return out.astype(np.float32), length, np.bincount(doc, minlength=len(texts))


def forward_backward(e: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line's two states, expected transitions, log Z over all documents.

    e: log scores (lines, 2) of documents one after another; counts: lines of each. All documents take each
    step together, longest first, so a step is one vector operation over those that still have lines.
    """
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    first = (np.cumsum(counts) - counts)[order]
    n = counts[order]
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    steps = int(n[0]) if len(n) else 0
    active = [int(np.searchsorted(-n, -t, side="left")) for t in range(steps)]  # documents with more than t lines
    for t in range(steps):
        at = first[: active[t]] + t
        alpha[at] = e[at] if t == 0 else e[at] + np.logaddexp(alpha[at - 1, :1] + trans[0], alpha[at - 1, 1:] + trans[1])
    pair = np.zeros((2, 2))
    log_z = np.zeros(len(e))
    ends = first + n - 1
    z = np.logaddexp(alpha[ends, 0], alpha[ends, 1]) if len(n) else np.zeros(0)
    for t in range(steps - 1, 0, -1):
        at = first[: active[t]] + t
        onward = e[at] + beta[at]
        beta[at - 1] = np.logaddexp(trans[:, 0] + onward[:, :1], trans[:, 1] + onward[:, 1:])
        pair += np.exp(alpha[at - 1][:, :, None] + trans + onward[:, None, :] - z[: active[t], None, None]).sum(0)
    log_z = np.repeat(z, n)
    index = np.concatenate([np.arange(a, a + k) for a, k in zip(first.tolist(), n.tolist(), strict=True)]) if len(n) else np.zeros(0, np.int64)
    marginal = np.zeros_like(e)
    marginal[index] = np.exp(alpha[index] + beta[index] - log_z[:, None])
    return marginal, pair, float(z.sum())


@dataclass
class Model:
    """Weights of the field, the scaling of its features, and the line from log odds to a score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float
    base: float  # score of a text without lines

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, length, counts = line_features(texts)
        return self.of(x, length, counts)

    def odds(self, x: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        e = ((x - self.mean) / self.scale) @ self.weights
        p = forward_backward(e, self.trans, counts)[0][:, 1]
        doc = np.repeat(np.arange(len(counts)), counts)
        mean = np.bincount(doc, p * length, len(counts)) / np.maximum(np.bincount(doc, length, len(counts)), 1e-9)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def of(self, x: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not self.weights.size:
            return np.full(len(counts), self.base)
        s = 1 / (1 + np.exp(-(self.slope * self.odds(x, length, counts) + self.offset)))
        return np.where(counts > 0, s, self.base)


def _adam(step, params: list[np.ndarray], rounds: int, rate: float) -> None:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        for p, g, a, b in zip(params, step(), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def train(x: np.ndarray, length: np.ndarray, counts: np.ndarray, quality: np.ndarray, rounds: int = 150, ridge: float = 1.0) -> Model:
    """Fits the field to lines that carry their document's label, then the score's slope and offset."""
    base = float((quality.sum() + 1) / (len(quality) + 2))
    none = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((0, 2)), np.zeros((2, 2)), 1.0, 0.0, base)
    if not len(x) or len(set(quality[counts > 0].tolist())) < 2:
        return none
    mean, scale = x.mean(0), x.std(0)
    fixed = scale < 1e-6
    mean[fixed], scale[fixed] = 0, 1
    z = ((x - mean) / scale).astype(np.float64)
    y = np.repeat(quality, counts)
    seen = np.stack([y == 0, y == 1], 1).astype(np.float64)
    inner = np.maximum(counts - 1, 0)
    pairs = np.diag([inner[quality == 0].sum(), inner[quality == 1].sum()]).astype(np.float64)
    w, trans = np.zeros((z.shape[1], 2)), np.zeros((2, 2))

    def step():
        p, expected, _ = forward_backward(z @ w, trans, counts)
        return [(z.T @ (seen - p) - ridge * w) / len(z), (pairs - expected - ridge * trans) / len(z)]

    _adam(step, [w, trans], rounds, 0.1)
    model = Model(mean, scale, w, trans, 1.0, 0.0, base)
    o, q = model.odds(x, length, counts)[counts > 0], quality[counts > 0]
    a = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's method with a small ridge about the identity
        s = 1 / (1 + np.exp(-(a[0] * o + a[1])))
        f = np.stack([o, np.ones_like(o)], 1)
        g = f.T @ (q - s) - 1.0 * (a - [1.0, 0.0])
        h = (f * (s * (1 - s))[:, None]).T @ f + np.eye(2)
        a = a + np.clip(np.linalg.solve(h, g), -1, 1)
    model.slope, model.offset = max(float(a[0]), 1e-3), float(a[1])
    return model


def held_out(col: str = "doc_id"):
    """Whether a row's label must not be learnt: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _feature_batches(batches):
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column("text").cast("binary").to_pylist()]
        x, length, counts = line_features(texts)
        stops = np.cumsum(counts).tolist()
        cuts = list(zip([0, *stops], stops))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array([v[a:b].tobytes() for a, b in cuts], pa.binary()) for v in (x, length))], ["doc_id", "label", "x", "length"])


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 3000) -> Model:
    """Learns from at most ``most_docs`` labelled documents, chosen by a hash of doc_id among all that may be learnt.

    Of each, all lines enter the fit, as in scoring. A doc_id with several labels has the more frequent one; a tie
    leaves it out. Rows of one doc_id with different texts are documents of their own, repeated rows are one; the driver
    gets ``most_docs`` rows at most. Without both labels the model gives every text the base rate.
    """
    prepare(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q <> 0.5")
    kind = dict(docs.dtypes)["doc_id"]
    chosen = usable.select("doc_id", (F.col("q") > 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    h = F.xxhash64(text_or_empty())
    rows = docs.select("doc_id", "text", h.alias("h")).join(F.broadcast(chosen), "doc_id")
    keys = rows.select("doc_id", "h").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most_docs)
    rows = rows.join(F.broadcast(keys), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "label", "text")
    got = rows.mapInArrow(_feature_batches, f"doc_id {kind}, label int, x binary, length binary")
    got = sorted(got.collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    x = [np.frombuffer(bytes(r.x), np.float32).reshape(-1, N_FEATURES) for r in got]
    counts = np.array([len(a) for a in x], np.int64)
    x = np.concatenate(x) if x else np.zeros((0, N_FEATURES), np.float32)
    length = np.concatenate([np.frombuffer(bytes(r.length), np.float64) for r in got]) if got else np.zeros(0)
    return train(x, length, counts, np.array([r.label for r in got], np.int64))


def _score_batches(batches, model: Model, name: str):
    for batch, texts in blocks(batches):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts), pa.float64())], [*batch.schema.names, name])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column ``name``, 0 to 1: likeness to documents labelled 1. All rows stay; a column of that name is replaced.

    Only the text enters the score, all its lines weighted by length. Null, empty and blank texts get
    the base rate of label 1; repeated rows get the same score; no rows give no rows.
    """
    prepare(docs.sparkSession)
    plain = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(lambda it: _score_batches(it, model, name), f"{schema}, `{name}` double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs whose score is at least ``least``; their columns stay as they are, whatever their names. Nulls, repeated rows: as in score()."""
    name = fresh_name(docs, "quality_score")
    return score(docs, model, name).where(F.col(name) >= least).drop(name)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Fits on the labels that may be learnt and scores the whole table documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
