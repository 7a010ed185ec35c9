"""Language-model scores from a hierarchical Pitman-Yor model.

Two levels of restaurants: one for each preceding word (or the document's start), however rare, and the root that they share
as parent. The root's base measure gives part of its mass to the one symbol of all unknown words and deals the rest evenly to
the known ones. Seating is kept as the number of tables of each (context, word) and of each word at the root; the probability of a word is
averaged over the sweeps kept.

The pairs (context, word) are dealt to shards by context, so the customers and tables of a context are counted in its shard; a
context that would fill a shard is cut by word, and the totals of its parts are added up between sweeps. Words are dealt to
ranges of the root. A Gibbs sweep draws the tables of all pairs, each from its conditional given all other tables, its own customers
taken out of the context and of the root; then the root's tables likewise. Draws of one sweep are made side by side, given the
sweep before. Shards and ranges send each other packed arrays: a sum of tables for each word, and back what the root has of it. A pair
that occurs once has one table in every sweep, and sends nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, documents, freed, mix, partitions, prepare, released, words_of, written

SWEEPS, BURN_IN, STRENGTH = 6, 3, 1.0
#: Training tokens of one shard, and shards at least.
SHARD_TOKENS, SHARDS = 1_500_000, 4
#: Words that rows name by a short code instead of their hash. It changes the rows' size, not the results.
CODED_WORDS = 65_535
_END = 0x8E5C3A9F17B2D461  # the end's hash; a document's first token follows an end
_EXACT = 1024  # counts up to this draw tables from their exact conditional
_BLOCK = 4 << 20
_STATE, _MESSAGE, _ROWS, _SUM, _HOT, _DOCS = range(6)
_SCHEMA = "kind int, at int, src long, data binary"


def held_out(col: str = "doc_id"):
    """Whether a document must not be learnt from: crc32 of doc_id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Totals:
    """What all tasks need of the training corpus. Only ``coded`` (CODED_WORDS at most) and ``hot`` (contexts larger than a half shard) are lists."""

    tokens: int
    words: int
    discount: float
    unknown: float  # the base measure's mass of the unknown symbol
    shards: int
    coded: np.ndarray  # hashes, the most frequent first
    hot: dict[int, int] = field(default_factory=dict)  # context: parts
    _slots: np.ndarray | None = None

    @property
    def base(self) -> float:
        return (1 - self.unknown) / max(self.words, 1)

    @property
    def slots(self) -> np.ndarray:
        """At the low bits of a coded word's hash, its place from 1; of words that share them one is found, and the others go by their hash."""
        if self._slots is None:
            self._slots = np.zeros(1 << 20, np.int32)
            self._slots[(self.coded & np.uint64((1 << 20) - 1)).astype(np.int64)] = np.arange(1, len(self.coded) + 1)
        return self._slots

    @property
    def hot_contexts(self) -> np.ndarray:
        return np.array(sorted(self.hot), np.uint64)


# ---------------------------------------------------------------- packed rows


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each behind its type and length; numbers of 2 and 4 bytes lie byte by byte, for the upper ones repeat."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        flat = np.ascontiguousarray(a)
        if a.dtype.itemsize in (2, 4):
            flat = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), flat.tobytes()]
    data = b"".join(out)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at, out = 2, []
    for _ in range(int.from_bytes(data[:2], "little")):
        kind, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        wide = kind.itemsize in (2, 4)
        flat = np.frombuffer(data, np.uint8 if wide else kind, n * kind.itemsize if wide else n, at + 12)
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if wide else flat)
        at += 12 + n * kind.itemsize
    return out


def _tight(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32 if most < 2**32 else np.uint64)


def _find(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_values, x), max(len(sorted_values) - 1, 0))
    return at, (sorted_values[at] == x) if len(sorted_values) else np.zeros(len(x), bool)


def _short(x: np.ndarray, g: Totals) -> tuple[np.ndarray, np.ndarray]:
    """(codes, hashes of the words without one): coded words take two bytes, the others code 0 and their hash."""
    at = g.slots[(x & np.uint64((1 << 20) - 1)).astype(np.int64)]
    if len(g.coded):
        at = np.where(g.coded[at - 1] == x, at, 0)
    return at.astype(np.uint16), x[at == 0]


def _long(codes: np.ndarray, rest: np.ndarray, g: Totals) -> np.ndarray:
    out = np.empty(len(codes), np.uint64)
    some = codes > 0
    out[some], out[~some] = g.coded[codes[some].astype(np.int64) - 1], rest
    return out


def _rows_of(kinds, ats, srcs, datas) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ats, pa.int32()), pa.array(srcs, pa.int64()), pa.array(datas, pa.binary())], ["kind", "at", "src", "data"])


def _batched(rows: Iterator[tuple], most: int = 16 << 20):
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[3])
        if size > most:
            yield _rows_of(*zip(*out))
            out, size = [], 0
    yield _rows_of(*(zip(*out) if out else ([], [], [], [])))


def _places(batches):
    """(place, its rows (kind, src, data)) of rows sorted by place."""
    key, rows = None, []
    for batch in batches:
        for kind, at, src, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "at", "src", "data")), strict=True):
            if at != key:
                if rows:
                    yield key, rows
                key, rows = at, []
            rows.append((kind, src, data))
    if rows:
        yield key, rows


def _by_place(df: DataFrame, n: int) -> DataFrame:
    """Rows of one place in one task, in order."""
    return df.repartitionById(n, F.col("at")).sortWithinPartitions("at", "kind", "src")


# ---------------------------------------------------------------- tokens, pairs


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, its document, tokens of each document): words in lower case, then an end."""
    h, _, counts = words_of(texts, lower=True)
    ends = np.cumsum(counts) + np.arange(len(counts))
    out, owner = np.empty(len(h) + len(counts), np.uint64), np.repeat(np.arange(len(counts)), counts + 1)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = np.uint64(_END), h
    return out, owner, counts + 1


def _word_batches(batches, most: int = 3_000_000):
    """(w, n): training tokens by word, combined as far as memory allows."""
    kept, size = [], 0

    def flush():
        w, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
        return w, np.bincount(at, np.concatenate([c for _, c in kept]), len(w)).astype(np.int64)

    def batch_of(w, n):
        for i in range(0, len(w), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(w[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["w", "n"])

    for batch, texts in blocks(batches, _BLOCK):
        learn = ~np.array(batch.column("held_out").to_pylist(), bool)
        w, doc, _ = _tokens(texts)
        w, n = np.unique(w[learn[doc]], return_counts=True)
        kept.append((w, n))
        size += len(w)
        if size > most:
            w, n = flush()
            kept, size = [(w, n)], len(w)
            if size > most // 2:
                yield from batch_of(w, n)
                kept, size = [], 0
    if kept:
        yield from batch_of(*flush())


def _range_of(h: np.ndarray, n) -> np.ndarray:
    """Which of n ranges a hash is in, so that hashes in order are in order of ranges."""
    return (((h >> np.uint64(32)) * np.asarray(n, np.uint64)) >> np.uint64(32)).astype(np.int64)


def _pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hashes by which pairs are ordered and told apart: the context's above the word's."""
    return (mix(u ^ np.uint64(_END)) & np.uint64(0xFFFFFFFF00000000)) | (w >> np.uint64(32))


def _dealt_keys(u: np.ndarray, w: np.ndarray, g: Totals) -> np.ndarray:
    """Pair keys whose range is the pair's shard: for a hot context's pairs, the upper half is the least of their part's shard."""
    key = _pair_keys(u, w)
    at, hot = _find(g.hot_contexts, u)
    if hot.any():
        parts = np.array([g.hot[c] for c in g.hot_contexts.tolist()], np.uint64)[at[hot]]
        shard = ((_range_of(key[hot], g.shards) + _range_of(mix(w[hot] ^ np.uint64(_END)), parts)) % g.shards).astype(np.uint64)
        least = ((shard << np.uint64(32)) + np.uint64(g.shards - 1)) // np.uint64(g.shards)
        key[hot] = (least << np.uint64(32)) | (key[hot] & np.uint64(0xFFFFFFFF))
    return key


def _as_bytes(ids: pa.Array) -> np.ndarray:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
    return np.frombuffer(sink.getvalue(), np.uint8)


def _from_bytes(data: np.ndarray) -> pa.Array:
    with pa.ipc.open_stream(data.tobytes()) as rows:
        return rows.read_next_batch().column(0)


def _block_rows(batches, g: Totals, give_docs: bool):
    """Of each block of documents and each shard a row of its pairs; with give_docs also of who has them, and a row of the documents.

    A row of pairs: contexts and how many pairs each has, words, how often they are learnt; and, with give_docs, how often they occur, and in
    which documents of the block.
    """
    from pyspark import TaskContext

    serial, task = 0, TaskContext.get().partitionId()
    for batch, texts in blocks(batches, _BLOCK):
        learn = ~np.array(batch.column("held_out").to_pylist(), bool)
        w, doc, counts = _tokens(texts)
        u = np.empty_like(w)
        u[1:], u[:1] = w[:-1], np.uint64(_END)
        key = _dealt_keys(u, w, g)
        order = np.argsort(key)
        key, doc, u, w = key[order], doc[order], u[order], w[order]
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1]))))
        n = np.diff(starts, append=len(key))
        c = np.add.reduceat(learn[doc].astype(np.int64), starts)
        u, w, shard = u[starts], w[starts], _range_of(key[starts], g.shards)
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        ids = shard[first]
        cell, block = np.append(starts, len(doc)), (task << 32) + serial
        serial += 1
        if give_docs:
            yield _DOCS, serial % g.shards, block, packed(~learn, _tight(counts), _as_bytes(batch.column("doc_id")))
        for s, a, b in zip(ids.tolist(), first.tolist(), np.append(first[1:], len(u)).tolist(), strict=True):
            new = np.flatnonzero(np.concatenate(([True], u[a + 1 : b] != u[a : b - 1])))
            arrays = [*_short(u[a:b][new], g), _tight(np.diff(new, append=b - a)), *_short(w[a:b], g), _tight(c[a:b])]
            if give_docs:
                arrays += [_tight(n[a:b]), _tight(doc[cell[a] : cell[b]]), np.array([len(texts)], np.uint32)]
            yield _ROWS, s, block, packed(*arrays)


class Shard:
    """The distinct pairs of a shard, in the order of their keys, with the rows of the blocks they came from."""

    def __init__(self, rows: list[bytes], g: Totals):
        self.rows = [unpacked(r) for r in rows]
        u = np.concatenate([np.repeat(_long(r[0], r[1], g), r[2].astype(np.int64)) for r in self.rows])
        w = np.concatenate([_long(r[3], r[4], g) for r in self.rows])
        _, first, self.at = np.unique(_pair_keys(u, w), return_index=True, return_inverse=True)
        self.c = np.bincount(self.at, np.concatenate([r[5] for r in self.rows]).astype(np.float64), len(first)).astype(np.int64)
        self.contexts, self.u = np.unique(u[first], return_inverse=True)
        self.words, self.w = np.unique(w[first], return_inverse=True)
        self.stops = np.cumsum([len(r[5]) for r in self.rows])

    @property
    def once(self) -> np.ndarray:
        """By context, its pairs that are learnt once."""
        return np.bincount(self.u, self.c == 1, len(self.contexts)).astype(np.int64)


# ---------------------------------------------------------------- drawing tables


def _stirling(d: float, most: int = _EXACT) -> list[np.ndarray]:
    """log of the generalised Stirling numbers of discount d: [c][t - 1] for 1 <= t <= c <= most."""
    rows = [np.zeros(1)]
    for c in range(1, most):
        last, new = rows[-1], np.full(c + 1, -np.inf)
        t = np.arange(1, c + 1)
        new[:c] = last + np.log(c - d * t)
        new[1:] = np.logaddexp(new[1:], last)
        rows.append(new)
    return [np.zeros(0), *rows]


_tables: dict = {}


def draw_tables(c: np.ndarray, weights, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers each: P(t) in proportion to S(c, t) times the weights of the first t tables.

    weights(rows, j): of opening table number j (from 0) at these rows. Counts above _EXACT are seated forward in crowds that grow by a
    quarter, each opening tables at the rate it begins and ends with.
    """
    if discount not in _tables:
        _tables.clear()
        _tables[discount] = _stirling(discount)
    stirling, out = _tables[discount], np.minimum(c, 1)
    if not len(c):
        return out
    x = rng.random(len(c))
    few = np.minimum(c, _EXACT)
    by = np.argsort(few, kind="stable")
    sizes, first = np.unique(few[by], return_index=True)
    for k, a, b in zip(sizes.tolist(), first.tolist(), np.append(first[1:], len(c)).tolist(), strict=True):
        step = max(1, 2_000_000 // max(k, 1))
        for i in range(a, b if k > 1 else a, step):
            rows = by[i : min(i + step, b)]
            p = stirling[k][None, :] + np.cumsum(np.log(np.maximum(weights(rows[:, None], np.arange(k)[None, :]), 1e-300)), 1)
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
            out[rows] = 1 + (x[rows][:, None] * p[:, -1:] > p).sum(1)
    many, at = np.flatnonzero(c > _EXACT), _EXACT
    while len(many):
        to = np.minimum(c[many], int(at * 1.25))
        t = out[many]
        a = np.maximum(weights(many, t), 1e-300)
        rate = a * np.log((a + to - discount * t) / (a + at - discount * t))
        out[many] = np.minimum(t + rng.poisson(rate), c[many])
        at = int(at * 1.25)
        many = many[c[many] > at]
    return out


def pair_weights(t: np.ndarray, tables: np.ndarray, root: np.ndarray, root_tables: np.ndarray, customers: np.ndarray, fresh: float, d: float):
    """Weights of draw_tables() for pairs that have t tables now: of table j, given all other tables.

    tables: the context's others; root: the word's other customers at the root, and its tables there; customers: all others at the root; fresh: what a new
    table there weighs, with the word's base probability. Own customers at the root have a table there as soon as there is one of them.
    """
    own = np.minimum(root_tables, root)

    def weights(i, j):
        seats = root[i] + j - d * np.maximum(own[i], np.minimum(root[i] + j, 1)) + fresh
        return (STRENGTH + d * (tables[i] + j)) * seats / (STRENGTH + customers[i] + j)

    return weights


@dataclass
class Sweep:
    """The totals that a sweep is drawn by: the root's customers and tables, and the tables of hot contexts."""

    number: int
    customers: int
    tables: int
    hot: dict[int, int] = field(default_factory=dict)

    def new_dish(self, g: Totals) -> float:
        return STRENGTH + g.discount * self.tables


# ---------------------------------------------------------------- what shards and the root's ranges do


def _set_up(batches, g: Totals):
    """From a shard's pairs: its state, and for each range of the root a message of its words.

    State: of the pairs learnt more than once c, context, word (places in the words of such pairs), tables; by context the pairs learnt once and
    the hash if it is hot (else 0). Message: words, tokens learnt, pairs learnt once, whether the word is in the state.
    """

    def out():
        for s, rows in _places(batches):
            x = Shard([r[2] for r in rows], g)
            often = np.flatnonzero(x.c > 1)
            is_hot = np.isin(x.contexts, g.hot_contexts)
            live = np.union1d(x.u[often], np.flatnonzero(is_hot))
            u, hot = np.searchsorted(live, x.u[often]), is_hot[live]
            active, w = np.unique(x.w[often], return_inverse=True)
            yield _STATE, s, s, packed(_tight(x.c[often]), _tight(u), _tight(w), np.ones(len(often), np.uint8), _tight(x.once[live]), np.where(hot, x.contexts[live], np.uint64(0)))
            n, once = (np.bincount(x.w, v, len(x.words)).astype(np.int64) for v in (x.c, x.c == 1))
            is_active = np.zeros(len(x.words), bool)
            is_active[active] = True
            ranges = _range_of(x.words, g.shards)
            ids, first = np.unique(ranges, return_index=True)
            for r, a, b in zip(ids.tolist(), first.tolist(), np.append(first[1:], len(ranges)).tolist(), strict=True):
                yield _MESSAGE, r, s, packed(x.words[a:b], _tight(n[a:b]), _tight(once[a:b]), is_active[a:b])
            yield from _hot_rows(x.contexts, np.bincount(x.u, x.c, len(x.contexts)), x.once + np.bincount(x.u, x.c > 1, len(x.contexts)).astype(np.int64), g)

    yield from _batched(out())


def _hot_rows(contexts: np.ndarray, customers: np.ndarray, tables: np.ndarray, g: Totals):
    at = np.flatnonzero(np.isin(contexts, g.hot_contexts))
    if len(at):
        yield _HOT, -1, 0, packed(contexts[at], customers[at].astype(np.int64), tables[at].astype(np.int64))


def _root_set_up(batches, g: Totals):
    """From the messages of the shards: the range's state, what it tells the shards, and its sums.

    State: words that more than one pair or an active one has, their tokens, constant customers, customers and tables now; the shards that
    have active words, how many, and places of these; the customers and tables of the sweeps kept.
    """

    def out():
        for r, rows in _places(batches):
            told = [(s, *unpacked(data)) for _, s, data in rows]
            words, at = np.unique(np.concatenate([t[1] for t in told]), return_inverse=True)
            total = lambda i: np.bincount(at, np.concatenate([t[i] for t in told]).astype(np.float64), len(words)).astype(np.int64)
            n, once, active = total(2), total(3), total(4)
            kept = (once > 1) | (active > 0)
            place = np.cumsum(kept) - 1
            stops, srcs, places = np.cumsum([len(t[1]) for t in told]).tolist(), [], []
            for t, a, b in zip(told, [0, *stops], stops):
                own = at[a:b][t[4]]
                if len(own):
                    srcs.append(t[0])
                    places.append(place[own])
            c = (once + active)[kept]  # one table for each active pair is the least; the shards' first sums replace it
            alone = int(((once == 1) & ~kept).sum())
            state = [words[kept], _tight(n[kept]), _tight(once[kept]), _tight(c), np.minimum(c, 1).astype(np.uint8), np.array(srcs, np.int64), np.array([len(p) for p in places], np.int64), _tight(np.concatenate(places) if places else np.zeros(0, np.int64)), np.array([alone], np.int64)]
            yield from _root_rows(r, state)

    yield from _batched(out())


def _root_rows(r: int, state: list[np.ndarray]):
    c, t, srcs, sizes, places, alone = state[3], state[4], state[5], state[6], state[7].astype(np.int64), int(state[8][0])
    yield _STATE, r, r, packed(*state)
    stops = np.cumsum(sizes).tolist()
    for s, a, b in zip(srcs.tolist(), [0, *stops], stops):
        yield _MESSAGE, s, r, packed(_tight(c[places[a:b]]), _tight(t[places[a:b]]))
    yield _SUM, -1, r, packed(np.array([int(c.sum()) + alone, int(t.sum()) + alone], np.int64))


def _sweep_shards(batches, g: Totals, now: Sweep):
    """Draws the tables of the pairs learnt more than once, and tells the root the new sums."""
    d, fresh, keep = g.discount, now.new_dish(g) * g.base, now.number >= BURN_IN

    def out():
        for s, rows in _places(batches):
            state = unpacked(rows[0][2])
            c, u, w, t, once, hot = (x.astype(np.int64) for x in state[:6])
            told = [unpacked(data) for kind, _, data in rows if kind == _MESSAGE]
            rc, rt = (np.concatenate([m[i] for m in told]).astype(np.int64) if told else np.zeros(0, np.int64) for i in (0, 1))
            tables = once + np.bincount(u, t, len(once)).astype(np.int64)
            for i in np.flatnonzero(hot).tolist():
                tables[i] = now.hot[int(hot[i]) % 2**64]
            weights = pair_weights(t, tables[u] - t, rc[w] - t, rt[w], now.customers - t, fresh, d)
            t = draw_tables(c, weights, d, np.random.default_rng([now.number, s]))
            yield _STATE, s, s, packed(*state[:3], _tight(t), *state[4:], *([_tight(t)] if keep else []))
            sums = _tight(np.bincount(w, t, len(rc)).astype(np.int64))
            at = 0
            for (_, r, _), m in zip([x for x in rows if x[0] == _MESSAGE], told, strict=True):
                yield _MESSAGE, r, s, packed(sums[at : at + len(m[0])])
                at += len(m[0])
            if hot.any():
                at = np.flatnonzero(hot)
                yield _HOT, -1, 0, packed(state[5][at], np.zeros(len(at), np.int64), (once + np.bincount(u, t, len(once)).astype(np.int64))[at])

    yield from _batched(out())


def _sweep_root(batches, g: Totals, now: Sweep):
    """Adds up the tables of a word, which are its customers at the root, and draws the root's tables."""
    d, keep = g.discount, now.number >= BURN_IN

    def out():
        for r, rows in _places(batches):
            state = unpacked(rows[0][2])
            told = [unpacked(data)[0] for kind, _, data in rows if kind == _MESSAGE]
            sums = np.concatenate(told).astype(np.float64) if told else np.zeros(0)
            c = state[2].astype(np.int64) + np.bincount(state[7].astype(np.int64), sums, len(state[0])).astype(np.int64)
            was = state[4].astype(np.int64)
            weights = lambda i, j: (STRENGTH + d * (now.tables - was[i] + j)) * g.base
            t = draw_tables(c, weights, d, np.random.default_rng([SWEEPS + now.number, r]))
            yield from _root_rows(r, [*state[:3], _tight(c), _tight(t), *state[5:], *([_tight(c), _tight(t)] if keep else [])])

    yield from _batched(out())


def _root_answers(batches):
    """For each shard that names words of the range: their tokens learnt, and customers and tables at the root in the sweeps kept."""

    def out():
        for r, rows in _places(batches):
            state = next((unpacked(data) for kind, _, data in rows if kind == _STATE), None)
            asked = [(s, *unpacked(data)) for kind, s, data in rows if kind == _MESSAGE]
            words, at = np.unique(np.concatenate([m[1] for m in asked]), return_inverse=True)
            n = np.bincount(at, np.concatenate([m[2] for m in asked]).astype(np.float64), len(words)).astype(np.int64)
            place, ok = _find(state[0], words)
            cols = [np.where(ok, v[place] if len(v) else 0, (n > 0).astype(np.int64)) for v in state[9:]]  # a word outside the state has one pair, and that once
            stops = np.cumsum([len(m[1]) for m in asked]).tolist()
            for m, a, b in zip(asked, [0, *stops], stops):
                yield _MESSAGE, m[0], r, packed(_tight(n[at[a:b]]), *[_tight(v[at[a:b]]) for v in cols])

    yield from _batched(out())


def _probabilities(rows: list[tuple], g: Totals, kept: list[Sweep], hot: list[dict]):
    """(shard, tokens learnt of each word, probability of each pair): averaged over the sweeps kept."""
    d = g.discount
    x = Shard([data for kind, _, data in rows if kind == _ROWS], g)
    state = next((unpacked(data) for kind, _, data in rows if kind == _STATE), None)
    told = [unpacked(data) for kind, _, data in rows if kind == _MESSAGE]
    col = lambda i: np.concatenate([m[i] for m in told]).astype(np.int64)
    n = col(0)
    assert len(n) == len(x.words), "the root has not answered for every word"
    often, customers, p = x.c > 1, np.bincount(x.u, x.c, len(x.contexts)), 0.0
    is_hot = np.flatnonzero(np.isin(x.contexts, g.hot_contexts)).tolist()
    for i in is_hot:
        customers[i] = hot[-1][int(x.contexts[i])][0]
    for k, sweep in enumerate(kept):
        t = (x.c > 0).astype(np.int64)
        t[often] = state[6 + k]
        tables = np.bincount(x.u, t, len(x.contexts))
        for i in is_hot:
            tables[i] = hot[k][int(x.contexts[i])][1]
        rc, rt, fresh = col(1 + 2 * k), col(2 + 2 * k), sweep.new_dish(g)
        root = np.where(n > 0, rc - d * rt + fresh * g.base, fresh * g.unknown) / (STRENGTH + sweep.customers)
        p = p + (x.c - d * t + (STRENGTH + d * tables[x.u]) * root[x.w]) / (STRENGTH + customers[x.u])
    return x, n, p / len(kept)


def _score_rows(batches, g: Totals, kept: list[Sweep], hot: list[dict]):
    """Of each block and shard the sums by document: places of the documents, known tokens, base scores, scores."""

    def out():
        for s, rows in _places(batches):
            yield from ((kind, s, src, data) for kind, src, data in rows if kind == _DOCS)
            if all(kind != _ROWS for kind, _, _ in rows):
                continue
            x, n, p = _probabilities(rows, g, kept, hot)
            base, p = np.log10((n + 1) / (g.tokens + g.words + 1)), np.log10(p)
            srcs = [src for kind, src, _ in rows if kind == _ROWS]
            for block, r, stop in zip(srcs, x.rows, x.stops.tolist(), strict=True):
                at = np.repeat(x.at[stop - len(r[5]) : stop], r[6].astype(np.int64))
                docs, word = r[7].astype(np.int64), x.w[at]
                size = int(r[8][0])
                some = np.flatnonzero(np.bincount(docs, minlength=size))
                yield _ROWS, s, block, packed(_tight(some), *[np.bincount(docs, v, size)[some] for v in (base[word], p[at])], _tight(np.bincount(docs, n[word] > 0, size)[some].astype(np.int64)))

    yield from _batched(out())


def _pair_batches(batches, g: Totals, kept: list[Sweep], hot: list[dict]):
    for _, rows in _places(batches):
        if all(kind != _ROWS for kind, _, _ in rows):
            continue
        x, n, p = _probabilities(rows, g, kept, hot)
        yield pa.RecordBatch.from_arrays([pa.array(x.contexts[x.u].view(np.int64)), pa.array(x.words[x.w].view(np.int64)), pa.array(x.c), pa.array(n[x.w]), pa.array(p)], ["context", "word", "count", "word_count", "p"])


def _merge_batches(batches):
    """Adds up the sums of each block, in the order of shards; a row for each document."""

    def done(head, sums):
        held, counts, ids = unpacked(head)
        known, base, score = (np.zeros(len(held)) for _ in range(3))
        for data in sums:
            docs, b, p, k = unpacked(data)
            docs = docs.astype(np.int64)
            base[docs] += b
            score[docs] += p
            known[docs] += k
        cols = [_from_bytes(ids), pa.array(held), pa.array(counts.astype(np.int64)), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    key, head, sums = None, None, []
    for batch in batches:
        for kind, src, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "src", "data")), strict=True):
            if src != key:
                if head is not None:
                    yield done(head, sums)
                key, head, sums = src, None, []
            if kind == _DOCS:
                head = data
            else:
                sums.append(data)
    if head is not None:
        yield done(head, sums)


# ---------------------------------------------------------------- the whole


@dataclass
class Model:
    """What learning leaves: totals, the sweeps kept, and written tables: the shards' state, the root's, and the shards' words."""

    totals: Totals
    kept: list[Sweep]
    hot: list[dict]  # for each sweep kept, of each hot context its customers and tables
    state: DataFrame
    root: DataFrame
    links: DataFrame

    def asked(self, rows: DataFrame) -> DataFrame:
        """For each shard its state, the root's answers, and the pairs of rows (doc_id, text, held_out), all of which were counted in learn()."""
        g = self.totals
        answers = _mapped(_by_place(self.links.unionByName(self.root), g.shards), _root_answers)
        pairs = rows.mapInArrow(lambda it: _batched(_block_rows(it, g, True)), _SCHEMA)
        return _by_place(pairs.unionByName(answers).unionByName(self.state), g.shards)


def _collected(df: DataFrame, kind: int) -> list[list[np.ndarray]]:
    return [unpacked(bytes(r.data)) for r in df.where(F.col("kind") == kind).select("data").collect()]


def _hot_sums(df: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each hot context its customers and tables, added up over its parts."""
    out: dict[int, tuple[int, int]] = {}
    for contexts, customers, tables in _collected(df, _HOT):
        for u, c, t in zip(contexts.tolist(), customers.tolist(), tables.tolist(), strict=True):
            out[u] = (out.get(u, (0, 0))[0] + c, out.get(u, (0, 0))[1] + t)
    return out


def _root_totals(root: DataFrame) -> tuple[int, int]:
    """The root's customers and tables, from the sums of its ranges."""
    sums = [x[0] for x in _collected(root, _SUM)]
    return int(sum(s[0] for s in sums)), int(sum(s[1] for s in sums))


def _mapped(df: DataFrame, f, *args) -> DataFrame:
    return df.mapInArrow(lambda it: f(it, *args), _SCHEMA)


def learn(docs: DataFrame) -> Model:
    """Counts words and pairs and samples seatings; docs: doc_id, text, held_out.

    The driver gets the CODED_WORDS most frequent words, the contexts of more than half a shard, and two sums of each range of the root; all
    else stays in tables. Pairs that only held-out documents have are counted 0, and name their words, so that the root answers for them.
    """
    prepare(docs.sparkSession)
    rows = docs.select("text", "held_out")
    counts = written(rows.mapInArrow(_word_batches, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    tokens, words, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
    unknown = min(0.98, max(0.5, once / max(discount**2 * words, 1)))
    shards = max(SHARDS, math.ceil(tokens / SHARD_TOKENS))
    size = F.floor(F.log2("n") * 8).cast("int")  # words by size class: the largest classes that together are few enough get codes
    classes = sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True)
    enough = int(np.searchsorted(np.cumsum([c.words for c in classes]), CODED_WORDS, side="right"))
    frequent = counts.where(size >= classes[enough - 1]["size"]).collect() if enough else []
    coded = np.array([r.w % 2**64 for r in sorted(frequent, key=lambda r: (-r.n, r.w))], np.uint64)
    hot = {r.w % 2**64: min(shards, math.ceil(2 * r.n / SHARD_TOKENS)) for r in counts.where(F.col("n") > SHARD_TOKENS / 2).collect()}
    g = Totals(int(tokens), int(words), discount, unknown, shards, coded, hot)
    released(counts)
    del frequent
    pairs = rows.mapInArrow(lambda it: _batched(_block_rows(it, g, False)), _SCHEMA)
    first = written(_mapped(_by_place(pairs, shards), _set_up, g))
    is_message, is_state = F.col("kind") == _MESSAGE, F.col("kind") == _STATE
    links, customers = first.where(is_message), _hot_sums(first)
    slim = replace(g, coded=np.zeros(0, np.uint64), _slots=None)  # sweeps need no codes
    root = written(_mapped(_by_place(links, shards), _root_set_up, g))
    freed(docs.sparkSession)
    at, tables, kept, hot_kept = first, {u: t for u, (_, t) in customers.items()}, [], []
    for k in range(SWEEPS):
        now = Sweep(k, *_root_totals(root), tables)
        drawn = written(_mapped(_by_place(at.where(is_state).unionByName(root.where(is_message)), shards), _sweep_shards, slim, now))
        seated = written(_mapped(_by_place(drawn.where(is_message).unionByName(root.where(is_state)), shards), _sweep_root, slim, now))
        released(root, *([at] if k else []))
        at, root, tables = drawn, seated, {u: t for u, (_, t) in _hot_sums(drawn).items()}
        if k >= BURN_IN:
            kept.append(Sweep(k, *_root_totals(root)))
            hot_kept.append({u: (customers[u][0], t) for u, t in tables.items()})
    freed(docs.sparkSession)
    return Model(g, kept, hot_kept, at.where(is_state), root.where(is_state), links)


def probabilities(docs: DataFrame) -> DataFrame:
    """(context, word, count, word_count, p): each pair of the documents, held out or not; words by hash, p as scores() takes it."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    model = learn(rows)
    g, kept, hot = model.totals, model.kept, model.hot
    return model.asked(rows).mapInArrow(lambda it: _pair_batches(it, g, kept, hot), "context long, word long, count long, word_count long, p double")


def scores(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents that aren't held out and scores all. score is log10 of the model's probability of the text: lower-case
    words, then an end. Every preceding word is a context of its own. Null, empty and blank texts are an end alone; repeated rows give
    repeated rows; null ids are kept and learnt from; other columns are ignored; no rows give no rows.
    Perplexity of a set of documents is 10 ** (-sum(score) / sum(n_tokens)).
    """
    spark = prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    model = learn(rows)
    g, kept, hot = model.totals, model.kept, model.hot
    scored = _mapped(model.asked(rows), _score_rows, g, kept, hot)
    merged = scored.repartition(partitions(spark), "src").sortWithinPartitions("src", F.col("kind") != _DOCS, "at")
    out = merged.mapInArrow(_merge_batches, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(g.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    """scores() of the whole table documents."""
    return scores(documents(spark, sf_dir).select("doc_id", "text"))
