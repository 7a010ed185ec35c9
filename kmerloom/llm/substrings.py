"""Substring dedup: suffix automata of reference shards give matching statistics; repeated spans are removed.

A window is WINDOW consecutive words. Its anchor is the leftmost of its GRAM-word grams of least hash, so equal windows have
equal anchors at equal places. A segment is the stretch of words whose windows have one anchor occurrence between
them; each window lies in exactly one segment. Segments of one anchor hash are a reference shard: only there can a
window of them occur again. Shards of one segment occurrence are done with after a count. The automaton of any other shard is built
from its different segments, weighted by how often each occurs; a segment is streamed through it, and where
its matching statistic reaches WINDOW, the state of its last WINDOW words knows how often they occur.

Automata of all shards together grow with the corpus, so they aren't broadcast: each goes to the task of its shard, and so do
the segments. A shard of very many different segments is dealt anew, by the windows themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INV, _powers, blocks, documents, mix, partitions, prepare, text_or_empty, words_of, written

WINDOW, GRAM = 35, 8
#: Different segments of one shard up to which one task builds its automaton.
SHARD_SEGMENTS = 4096
_P = 0x9E3779B97F4A7C15


class Automaton:
    """Generalised suffix automaton of weighted word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.weight.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of the strings of q that end a string of p by word."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, weight: int) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = nexts[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new = self._state(length[last] + 1, {}, 0)
                p = last
                while p >= 0 and word not in nexts[p]:
                    nexts[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nexts[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            self.weight[last] += weight

    def count(self) -> None:
        """Turns the weights of ends into numbers of occurrences."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.weight[self.link[s]] += self.weight[s]

    def matching_statistics(self, words: list):
        """At each word, the length of the longest match that ends there, and the state that it leads to."""
        s = n = 0
        for word in words:
            while s and word not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if word in self.next[s]:
                s, n = self.next[s][word], n + 1
            yield n, s

    def repeated(self, words: list, window: int) -> int:
        """Bit i is set if the window that starts at word i occurs at least twice."""
        mask = 0
        for end, (n, s) in enumerate(self.matching_statistics(words)):
            if n >= window:
                while self.length[self.link[s]] >= window:
                    s = self.link[s]
                if self.weight[s] >= 2:
                    mask |= 1 << (end - window + 1)
        return mask


def _sequence_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h | np.uint64(1)) * _powers(len(h), _P | 1), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(len(h) + 1, _INV)[starts] + (ends - starts).astype(np.uint64))


def segments(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first word in it, number of windows, anchor hash, hash of all words) of each segment."""
    h, doc, counts = words_of(texts)
    n = len(h) - window + 1
    whole = doc[:n] == doc[window - 1 :] if n > 0 else np.zeros(0, bool)
    if not whole.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for i in range(gram):
        g = g * np.uint64(_P) + h[i : i + len(g)]
    g = mix(g)
    span, at, k = window - gram + 1, np.arange(len(g)), 1

    def merged(left, right):
        return np.where(g[left] <= g[right], left, right)

    while 2 * k <= span:  # at: where the least of the k grams from here on is
        at = merged(at[:-k], at[k:])
        k *= 2
    if k < span:
        at = merged(at[: len(at) - (span - k)], at[span - k :])
    at = at[:n]
    new = whole.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new)
    run = np.add.reduceat(whole.astype(np.int64), first)
    stop = first + run
    ids = _sequence_hash(h, first, stop + window - 1)
    begin = np.cumsum(counts) - counts
    d = doc[first].astype(np.int64)
    return d, first - begin[d], run, g[at[first]], ids


def _segment_batches(batches, window: int, gram: int):
    for batch, texts in blocks(batches):
        d, start, run, anchor, ids = segments(texts, window, gram)
        take = pa.array(d)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(start.astype(np.int32)), pa.array(run.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(ids.view(np.int64))], ["doc_id", "text_hash", "start", "windows", "anchor", "segment"])


def _cut_batches(batches, window: int):
    """The words of each wanted segment of the documents: a row for each."""
    for batch in batches:
        out = [[], [], [], [], []]
        for text, wanted in zip(batch.column("text").cast("binary").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            words = text.split()
            for w in wanted:
                for col, v in zip(out, (w["anchor"], w["segment"], w["occurs"], w["different"], b" ".join(words[w["start"] : w["start"] + w["windows"] + window - 1])), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["anchor", "segment", "occurs", "different", "words"])


def _automaton_batches(batches, window: int):
    """Rows of (anchor, segment, occurs, words), those of an anchor together: the mask of repeated windows of each."""
    out: list[tuple] = []

    def flush():
        b = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["anchor", "segment", "mask"])
        out.clear()
        return b

    def shard(key, rows):
        a, parts = Automaton(), []
        for segment, occurs, words in dict.fromkeys(rows):
            parts.append((segment, words.split(b" ")))
            a.add(parts[-1][1], occurs)
        a.count()
        out.extend((key, segment, a.repeated(words, window)) for segment, words in parts)

    key, rows = None, []
    for batch in batches:
        for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "occurs", "words")), strict=True):
            if anchor != key:
                if rows:
                    shard(key, rows)
                key, rows = anchor, []
                if len(out) > 20_000:
                    yield flush()
            rows.append(tuple(row))
    if rows:
        shard(key, rows)
    yield flush()


def _window_batches(batches, window: int):
    """A row for each window of very large shards' segments, with two hashes of its words."""
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for anchor, segment, occurs, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "occurs", "words")), strict=True):
            w = words.split(b" ")
            for i in range(len(w) - window + 1):
                d = hashlib.blake2b(b" ".join(w[i : i + window]), digest_size=16).digest()
                for col, v in zip(cols, (anchor, segment, occurs, i, d), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["anchor", "segment", "occurs", "place", "digest"])


def _keep_batches(batches, window: int):
    """Removes the words inside repeated windows: n_words, n_removed and the kept words joined by spaces."""
    bits = np.arange(window)
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column("text").cast("binary").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            if spans:
                start, mask = (np.array([s[k] for s in spans], np.int64) for k in ("start", "mask"))
                at = (start[:, None] + bits)[(mask[:, None] >> bits) & 1 == 1]
                size = len(words) + 1
                gone = np.cumsum(np.bincount(at, minlength=size)[:size] - np.bincount(at + window, minlength=size)[:size])[:-1] > 0
                n_removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast("string")], ["doc_id", "n_words", "n_removed", "kept"])


def _with(docs: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """docs joined to rows of more by document. Both sides are shuffled: what is known of documents grows with them."""
    more = more.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    return docs.join(more, docs.doc_id.eqNullSafe(F.col("_id")) & (docs.text_hash == F.col("_hash")), how).drop("_id", "_hash")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, spans): for each document with repeated windows, where segments start and which of their windows repeat.

    docs: doc_id, text (not null), text_hash. A segment's first window starts at ``start``; bit i of ``mask`` is the window i words on.
    """
    if not 1 <= gram <= window <= gram + 61:
        raise ValueError("a segment's windows must fit the bits of a mask")
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    found = written(docs.mapInArrow(lambda it: _segment_batches(it, window, gram), f"doc_id {kind}, text_hash long, start int, windows int, anchor long, segment long"))
    shards = found.groupBy("anchor").agg(F.count("*").alias("total"), F.min("segment").alias("low"), F.max("segment").alias("high")).where("total > 1")
    shards = written(shards.select("anchor", (F.col("low") == F.col("high")).alias("alike")))  # apart, so that the join can split a hot anchor
    again = written(found.join(shards, "anchor"))
    mixed = again.where("not alike").drop("alike")
    each = mixed.groupBy("anchor", "segment").agg(F.count("*").alias("occurs"), F.min(F.struct("doc_id", "text_hash", "start", "windows")).alias("rep")).checkpoint()
    wide = each.groupBy("anchor").agg(F.count("*").alias("different"))
    wanted = each.join(wide, "anchor").select("rep.doc_id", "rep.text_hash", F.struct("anchor", "segment", "occurs", "different", "rep.start", "rep.windows").alias("w"))
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("w").alias("wanted")).checkpoint()
    cut = written(_with(docs, wanted, "inner").select("text", "wanted").mapInArrow(lambda it: _cut_batches(it, window), "anchor long, segment long, occurs long, different long, words binary"))
    usual = cut.where(F.col("different") <= SHARD_SEGMENTS).drop("different")
    usual = usual.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", "segment")
    masks = usual.mapInArrow(lambda it: _automaton_batches(it, window), "anchor long, segment long, mask long")
    large = cut.where(F.col("different") > SHARD_SEGMENTS).drop("different").dropDuplicates(["anchor", "segment"])
    windows = large.mapInArrow(lambda it: _window_batches(it, window), "anchor long, segment long, occurs long, place long, digest binary")
    often = windows.groupBy("digest").agg(F.sum("occurs").alias("n")).where("n > 1").select("digest")
    large_masks = windows.join(often, "digest").groupBy("anchor", "segment").agg(F.sum(F.expr("shiftleft(1L, cast(place as int))")).alias("mask"))
    masks = masks.unionByName(large_masks).where("mask <> 0")
    marks = mixed.join(masks, ["anchor", "segment"]).select("doc_id", "text_hash", "start", "mask")
    alike = again.where("alike").select("doc_id", "text_hash", "start", F.expr("shiftleft(1L, windows) - 1").alias("mask"))
    return marks.unionByName(alike).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "mask")).alias("spans"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept (the words left, joined by single spaces).

    A word goes if a window that covers it occurs anywhere else, in the same document or another, judged on the input. Words are
    what ASCII white space separates. Null, empty and short texts lose nothing; each of some repeated rows counts, so
    their windows all go; rows with one doc_id and different texts are told apart; other columns are ignored; no rows give no rows.
    """
    prepare(docs.sparkSession)
    t = text_or_empty()
    rows = docs.select("doc_id", t.alias("text"), F.xxhash64(t).alias("text_hash"))
    spans = repeated_spans(rows, window, gram).checkpoint()
    out = _with(rows, spans, "left").select("doc_id", "text", "spans")
    return out.mapInArrow(lambda it: _keep_batches(it, window), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept string")


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    """drop_repeats() of the whole table documents; the kept words as a digest."""
    out = drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB's SQL: all windows are counted.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT k, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS s FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT k, i FROM g JOIN (SELECT s FROM g GROUP BY s HAVING count(*) > 1) USING (s)),
p AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS i FROM r),
a AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
o AS (SELECT a.k, count(p.i) AS n_removed, string_agg(CASE WHEN p.i IS NULL THEN x END, ' ' ORDER BY a.i) AS kept FROM a LEFT JOIN p ON p.k = a.k AND p.i = a.i GROUP BY a.k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (k)
"""
