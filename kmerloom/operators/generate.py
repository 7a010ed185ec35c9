"""Tuple generators: records to k-mers with positions, qualities or neighbours.

Records are cut into short pieces that overlap by k - 1, so that each window is generated once (by the piece that
holds its first character) and a substring never walks far into a long record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..functions.quality import ILLUMINA18, Codec
from ..session import ship_package

PIECE = 64


def pieces(records: DataFrame, k: int, seq: str = "seq", piece: int = PIECE, before: int = 0, after: int = 0) -> DataFrame:
    """Records of at least k characters, cut: _base (first window's place) and _part; with context characters if asked for.

    part starts ``before`` characters ahead of the piece where the record has them (lead says how many).
    """
    n = F.char_length(seq)
    cut = records.where(n >= k).withColumn("_base", F.explode(F.sequence(F.lit(0), n - k, F.lit(piece))))
    lead = F.least(F.col("_base"), F.lit(before))
    return cut.withColumn("_lead", lead).withColumn("_windows", F.least(F.lit(piece), n - k + 1 - F.col("_base"))).withColumn("_part", F.substring(F.col(seq), F.col("_base") - lead + 1, lead + F.col("_windows") + k - 1 + after))


def kmers(records: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """(keep..., pos, kmer): windows of k characters, step 1; none of a record that is shorter. ``where`` filters them."""
    rows = pieces(records.select(*keep, seq), k, seq).drop(seq)
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_windows") - 1)))
    out = rows.select(*keep, (F.col("_base") + F.col("_i")).alias("pos"), F.substring(F.col("_part"), F.col("_i") + 1, F.lit(k)).alias("kmer"))
    return out if where is None else out.where(where)


def kmer_counts_of_one(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, count 1): the tuples that a counting index takes."""
    return kmers(records, k, seq).select("kmer", F.lit(1).cast("long").alias("count"))


def kmer_positions(records: DataFrame, k: int, seq: str = "seq", file_id: str = "file_id", start: str = "record_start", begin: str | None = None) -> DataFrame:
    """(kmer, position): where in which record a window starts. ``begin``: where the sequence starts in its record."""
    rows = kmers(records, k, seq, tuple(c for c in (file_id, start, begin) if c))
    offset = F.col("pos") + (F.col(begin) if begin else 0)
    return rows.select("kmer", F.struct(F.col(file_id).alias("file_id"), F.col(start).alias("record_start"), offset.cast("long").alias("offset")).alias("position"))


def _quality_batches(batches, k: int, codec: Codec, n_keep: int):
    a = np.arange(256)
    usable = (a <= codec.last) & (a - codec.first >= max(codec.least, 1))
    logs = np.where(usable, np.log2(1 - 10.0 ** (-(np.where(usable, a, codec.first + 1) - codec.first) / 10)), -np.inf)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            seqs, quals = part.column(n_keep).to_pylist(), part.column(n_keep + 1).to_pylist()
            sizes = [max(min(len(s or ""), len(q or "")) - k + 1, 0) for s, q in zip(seqs, quals, strict=True)]
            texts, values = [], []
            for s, q, n in zip(seqs, quals, sizes, strict=True):
                if n:
                    m = n + k - 1
                    texts.append(_windows(s[:m], k))
                    lg = np.lib.stride_tricks.sliding_window_view(logs[np.frombuffer(q[:m].encode("latin-1", "replace"), np.uint8)], k)
                    values.append(np.exp2(lg.sum(1)))
            if texts:
                rows = np.repeat(np.arange(len(sizes)), sizes)
                pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes if n])
                cols = [c.take(pa.array(rows)) for c in part.columns[:n_keep]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pos), pa.concat_arrays(texts), pa.array(np.concatenate(values))], [*part.schema.names[:n_keep], "pos", "kmer", "quality"])


def _best_batches(batches, k: int, codec: Codec):
    a = np.arange(256)
    usable = (a <= codec.last) & (a - codec.first >= max(codec.least, 1))
    logs = np.where(usable, np.log2(1 - 10.0 ** (-(np.where(usable, a, codec.first + 1) - codec.first) / 10)), -np.inf)
    for batch in batches:
        rows = [(s[:n], q[:n]) for s, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (n := min(len(s or ""), len(q or ""))) >= k]
        at, size = 0, 0
        for i, (s, _) in enumerate(rows):
            size += len(s)
            if size > 1 << 20 or i == len(rows) - 1:
                chars, owner = _flat([s.encode("ascii", "replace") for s, _ in rows[at : i + 1]])
                lg = logs[np.frombuffer("".join(q for _, q in rows[at : i + 1]).encode("latin-1", "replace"), np.uint8)]
                at, size, n = i + 1, 0, len(chars) - k + 1
                own = np.flatnonzero(owner[:n] == owner[k - 1 :])
                quality = np.exp2(np.lib.stride_tricks.sliding_window_view(lg, k)[own].sum(1))
                code = packed_windows(_CODE[chars], k)[own]
                order = np.argsort(code, kind="stable")
                code, quality = code[order], quality[order]
                first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(code[first].view(np.int64)), pa.array(np.diff(first, append=len(code))), pa.array(np.maximum.reduceat(quality, first)), pa.array(np.add.reduceat((quality == 0).astype(np.int64), first))], ["code", "count", "best", "unusable"])


def best_quality(records: DataFrame, k: int, codec: Codec = ILLUMINA18, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """(kmer, count, best, unusable) of DNA for k up to 31: how often a k-mer occurs, its best quality, how often that is 0; combined by batch before the shuffle."""
    if not 1 <= k <= 31:
        raise ValueError("k is from 1 to 31")
    ship_package(records.sparkSession)
    found = records.select(seq, qual).mapInArrow(lambda it: _best_batches(it, k, codec), "code long, count long, best double, unusable long")
    out = found.groupBy("code").agg(F.sum("count").alias("count"), F.max("best").alias("best"), F.sum("unusable").alias("unusable"))
    return out.select(DNA.unpack(F.col("code"), k).alias("kmer"), "count", "best", "unusable")


def _prefix_batches(batches, k: int, prefix: str, names: list[str]):
    n_keep, size = len(names), len(prefix)
    want = packed_windows(_CODE[np.frombuffer(prefix.encode(), np.uint8)], size)[0]
    for batch in batches:
        for i, s in enumerate(batch.column(n_keep).to_pylist()):
            if s is None or len(s) < k:
                continue
            at = np.flatnonzero(packed_windows(_CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)], size)[: len(s) - k + 1] == want)
            if len(at):
                row = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(row) for j in range(n_keep)), pa.array(at.astype(np.int32)), pa.array([s[a : a + k] for a in at.tolist()])], [*names, "pos", "kmer"])


def kmers_with_prefix(records: DataFrame, k: int, prefix: str, seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., pos, kmer) of the windows of DNA records that begin with ``prefix``; the others are never made."""
    if not 1 <= len(prefix) <= min(k, 31):
        raise ValueError("a prefix has 1 to 31 letters, and k at most")
    ship_package(records.sparkSession)
    rows = records.select(*keep, seq)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "pos int, kmer string"])
    return rows.mapInArrow(lambda it: _prefix_batches(it, k, prefix, list(keep)), schema)


def _sided_batches(batches, k: int, codec: Codec, n_keep: int):
    """_quality_batches() with the characters beside each window."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            s, q = row.column(n_keep)[0].as_py() or "", row.column(n_keep + 1)[0].as_py() or ""
            for b in _quality_batches([row], k, codec, n_keep):
                n = b.num_rows
                right = [*s[k : k + n]] + [""] * (n - len(s[k : k + n]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(["", *s[: n - 1]]), pa.array(right)], [*b.schema.names, "left", "right"])


def kmers_with_edges_and_quality(records: DataFrame, k: int, codec: Codec = ILLUMINA18, seq: str = "seq", qual: str = "qual", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., pos, kmer, quality, left, right): kmers_with_quality() and kmers_with_edges() in one pass."""
    ship_package(records.sparkSession)
    rows = records.select(*keep, seq, qual)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "pos int, kmer string, quality double, left string, right string"])
    return rows.mapInArrow(lambda it: _sided_batches(it, k, codec, len(keep)), schema)


def _windows(text: str, k: int) -> pa.Array:
    """All windows of k characters of a text."""
    n = len(text) - k + 1
    if not text.isascii():
        return pa.array([text[i : i + k] for i in range(n)], pa.string())
    cut = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text.encode(), np.uint8), k))
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)[: n + 1]), pa.py_buffer(cut))


def kmers_with_quality(records: DataFrame, k: int, codec: Codec = ILLUMINA18, seq: str = "seq", qual: str = "qual", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., pos, kmer, quality): each window with the product of its bases' probabilities, 0 if one is unusable.

    Each window is summed by itself, so no rounding drifts along a read. Text beyond the shorter of both is left out.
    """
    ship_package(records.sparkSession)
    rows = records.select(*keep, seq, qual)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "pos int, kmer string, quality double"])
    return rows.mapInArrow(lambda it: _quality_batches(it, k, codec, len(keep)), schema)


def kmers_with_edges(records: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., pos, kmer, left, right): each window with the characters beside it, empty at the record's ends."""
    rows = pieces(records.select(*keep, seq), k, seq, before=1, after=1).drop(seq)
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_windows") - 1)))
    at = F.col("_i") + F.col("_lead")
    return rows.select(*keep, (F.col("_base") + F.col("_i")).alias("pos"), F.substring(F.col("_part"), at + 1, F.lit(k)).alias("kmer"), F.when(at > 0, F.substring(F.col("_part"), at, F.lit(1))).otherwise("").alias("left"), F.substring(F.col("_part"), at + k + 1, F.lit(1)).alias("right"))


def _asked_batches(batches, k: int, asked: np.ndarray, n_keep: int, codec: Codec | None):
    """Windows whose packed code is in ``asked`` (sorted), with their places, and qualities if a codec is given."""
    if codec is not None:
        a = np.arange(256)
        usable = (a <= codec.last) & (a - codec.first >= max(codec.least, 1))
        logs = np.where(usable, np.log2(1 - 10.0 ** (-(np.where(usable, a, codec.first + 1) - codec.first) / 10)), -np.inf)
    table = None
    if k <= 12:
        table = np.zeros(1 << (2 * k), bool)
        table[asked] = True

    def found(part, seqs, quals, rows):
        chars, owner = _flat(seqs)
        n = len(chars) - k + 1
        if n <= 0 or not len(asked):
            return
        codes = _CODE[chars]
        code = packed_windows(codes, k)
        good = table[code] if table is not None else asked[np.minimum(np.searchsorted(asked, code), len(asked) - 1)] == code
        at = np.flatnonzero(good & (owner[:n] == owner[k - 1 :]))
        if not len(at):
            return
        begin = np.cumsum([0, *map(len, seqs)])
        mine = owner[at]
        text = np.lib.stride_tricks.sliding_window_view(_LETTERS[codes.astype(np.uint8)], k)[at]
        kmer = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.arange(0, (len(at) + 1) * k, k, dtype=np.int32)[: len(at) + 1]), pa.py_buffer(text))
        row = pa.array(np.array(rows)[mine])
        cols = [*(c.take(row) for c in part.columns[:n_keep]), pa.array((at - begin[mine]).astype(np.int32)), kmer]
        if codec is not None:
            lg = logs[np.frombuffer(b"".join(quals), np.uint8)]
            total = lg[:n].copy()
            for j in range(1, k):
                total += lg[j : j + n]
            cols.append(pa.array(np.exp2(total[at])))
        yield pa.RecordBatch.from_arrays(cols, [*part.schema.names[:n_keep], "pos", "kmer", "quality"][: len(cols)])

    for batch in batches:
        seqs, quals, rows, size = [], [], [], 0
        texts = batch.column(n_keep).to_pylist()
        scores = batch.column(n_keep + 1).to_pylist() if codec is not None else texts
        for i, (s, q) in enumerate(zip(texts, scores, strict=True)):
            m = min(len(s or ""), len(q or ""))
            if m >= k:
                seqs.append(s[:m].encode("ascii", "replace"))
                quals.append(q[:m].encode("latin-1", "replace") if codec is not None else b"")
                rows.append(i)
                size += m
            if size > 1 << 18:
                yield from found(batch, seqs, quals, rows)
                seqs, quals, rows, size = [], [], [], 0
        if rows:
            yield from found(batch, seqs, quals, rows)


def kmers_asked(records: DataFrame, k: int, asked: list[str], seq: str = "seq", keep: tuple[str, ...] = (), codec: Codec | None = None, qual: str = "qual") -> DataFrame:
    """(keep..., pos, kmer[, quality]): the windows of DNA records that are among the k-mers ``asked``, for k up to 31; the others are never made.

    With a codec, qualities are those of kmers_with_quality(). Characters that DNA doesn't know are A.
    """
    if not 1 <= k <= 31:
        raise ValueError("k is from 1 to 31")
    ship_package(records.sparkSession)
    own = sorted({x for x in asked if x and len(x) == k and not x.strip("ACGT")})
    codes = np.unique(packed_windows(_CODE[np.frombuffer("".join(own).encode(), np.uint8)], k)[::k]) if own else np.zeros(0, np.uint64)
    rows = records.select(*keep, seq, *([qual] if codec is not None else []))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "pos int, kmer string"]) + (", quality double" if codec is not None else "")
    return rows.mapInArrow(lambda it: _asked_batches(it, k, codes, len(keep), codec), schema)


_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.zeros(256, np.uint64)
for _c, _v in zip(b"CGTcgt", (1, 2, 3, 1, 2, 3), strict=True):
    _CODE[_c] = _v


def two_bit_codes(chars: np.ndarray) -> np.ndarray:
    """Codes of DNA letters in either case; others are A."""
    return _CODE[chars]


def packed_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """All windows of k two-bit codes as numbers: windows of doubling width, put together by the bits of k."""
    acc, got, width, wide = np.zeros(len(codes), np.uint64), 0, 1, codes
    while k >> (width.bit_length() - 1):
        if k & width:
            n = len(codes) - got - width + 1
            acc = (acc[:n] << np.uint64(2 * width)) | wide[got : got + n]
            got += width
        if 2 * width > k:
            break
        wide = (wide[: len(wide) - width] << np.uint64(2 * width)) | wide[width:]
        width *= 2
    return acc


def _packed_counts(batches, k: int, model: str, t_symbol: bytes):
    """Counts of packed k-mers by batch: equal windows are combined before anything leaves the task."""
    code = _CODE.copy()
    if t_symbol == b"U":
        code[[ord("T"), ord("t")]] = 0
        code[[ord("U"), ord("u")]] = 3
    found: list = []

    def combined():
        v, at = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in found]), len(v)).astype(np.int64)
        return v, n

    def out(v, n):
        for i in range(0, len(v), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["code", "count"])

    size = 0
    for batch in batches:
        for chars, owner in joined_texts(batch.column(0)):
            n = len(chars) - k + 1
            if n <= 0:
                continue
            acc = packed_windows(code[chars], k)[owner[:n] == owner[k - 1 :]]
            if model != "single":
                acc = np.minimum(acc, reverse_complement_codes(acc, k))
            v, n = np.unique(acc, return_counts=True)
            found.append((v, n))
            size += len(v)
            if size > 4_000_000:
                v, n = combined()
                found, size = [(v, n)], len(v)
                if size > 2_000_000:
                    yield from out(v, n)
                    found, size = [], 0
    if found:
        yield from out(*combined())


def joined_texts(column: pa.Array, most: int = 4 << 20):
    """(characters, record of each) of some records at once; a character beyond ASCII counts as one."""
    group, size = [], 0
    for s in column.to_pylist():
        if s:
            group.append(s.encode("ascii", "replace"))
            size += len(s)
        if size > most:
            yield _flat(group)
            group, size = [], 0
    if group:
        yield _flat(group)


def _flat(group: list[bytes]):
    return np.frombuffer(b"".join(group), np.uint8), np.repeat(np.arange(len(group), dtype=np.int32), [len(s) for s in group])


def reverse_complement_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Packed two-bit k-mers to those of the other strand: complement, then reverse by halves."""
    x = ~code
    for shift, m in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = np.uint64(m)
        x = ((x >> np.uint64(shift)) & m) | ((x & m) << np.uint64(shift))
    x = (x >> np.uint64(32)) | (x << np.uint64(32))
    return x >> np.uint64(64 - 2 * k)


def count_packed(records: DataFrame, k: int, model: str = "single", alphabet: Alphabet = DNA, seq: str = "seq") -> DataFrame:
    """(kmer, count) for a two-bit alphabet and k up to 31, from raw text: vectorised, and combined before the shuffle.

    Characters that the alphabet doesn't know count as A. model: single, or canonical (the lesser strand).
    """
    if alphabet.bits != 2 or not 1 <= k <= 31:
        raise ValueError("packed counting takes two-bit alphabets and k from 1 to 31")
    ship_package(records.sparkSession)
    t = alphabet.symbols[3].encode()
    found = records.select(seq).mapInArrow(lambda it: _packed_counts(it, k, model, t), "code long, count long")
    return found.groupBy("code").agg(F.sum("count").alias("count")).select(alphabet.unpack(F.col("code"), k).alias("kmer"), "count")


def _wide_counts(batches, k: int):
    """Counts of k-mers packed in two numbers: the first k - 31 letters, and the last 31."""
    for batch in batches:
        for chars, owner in joined_texts(batch.column(0)):
            n = len(chars) - k + 1
            if n <= 0:
                continue
            codes, at = _CODE[chars], np.flatnonzero(owner[:n] == owner[k - 1 :])
            high, low = packed_windows(codes, k - 31)[at], packed_windows(codes, 31)[at + k - 31]
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))) if len(at) else np.zeros(0, np.int64)
            count = np.diff(first, append=len(at))
            for i in range(0, len(first), 100_000):
                cut = first[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(high[cut].view(np.int64)), pa.array(low[cut].view(np.int64)), pa.array(count[i : i + 100_000])], ["high", "low", "count"])


def count_wide(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, count) of DNA for k from 32 to 62, from raw text: 16 bytes a k-mer in the shuffle, equal ones of a batch combined before it."""
    if not 32 <= k <= 62:
        raise ValueError("k is from 32 to 62")
    ship_package(records.sparkSession)
    found = records.select(seq).mapInArrow(lambda it: _wide_counts(it, k), "high long, low long, count long")
    sums = found.groupBy("high", "low").agg(F.sum("count").alias("count"))
    return sums.select(F.concat(DNA.unpack(F.col("high"), k - 31), DNA.unpack(F.col("low"), 31)).alias("kmer"), "count")


def _position_sums(batches, k: int):
    for batch in batches:
        for chars, owner in joined_texts(batch.column(0)):
            n = len(chars) - k + 1
            if n <= 0:
                continue
            at = np.flatnonzero(owner[:n] == owner[k - 1 :])
            begin = np.searchsorted(owner, np.arange(owner[-1] + 1))
            pos = at - begin[owner[at]]
            code = packed_windows(_CODE[chars], k)[at]
            order = np.argsort(code, kind="stable")
            code, pos = code[order], pos[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(at) else np.zeros(0, np.int64)
            if len(first):
                cols = [code[first].view(np.int64), np.diff(first, append=len(code)), np.minimum.reduceat(pos, first), np.maximum.reduceat(pos, first), np.add.reduceat(pos, first)]
                for i in range(0, len(first), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000].astype(np.int64)) for c in cols], ["code", "count", "first_pos", "last_pos", "sum_pos"])


def position_sums(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, count, first_pos, last_pos, sum_pos) over all records of DNA, for k up to 31, from raw text: combined by batch before the shuffle."""
    if not 1 <= k <= 31:
        raise ValueError("k is from 1 to 31")
    ship_package(records.sparkSession)
    found = records.select(seq).mapInArrow(lambda it: _position_sums(it, k), "code long, count long, first_pos long, last_pos long, sum_pos long")
    out = found.groupBy("code").agg(F.sum("count").alias("count"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("sum_pos").alias("sum_pos"))
    return out.select(DNA.unpack(F.col("code"), k).alias("kmer"), "count", "first_pos", "last_pos", "sum_pos")


def _first_packed(batches, k: int, order: str):
    """Of each batch, for every canonical k-mer: how often it occurs, and where and on which strand first."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by = sorted((i for i, t in enumerate(texts) if t and ids[i] is not None), key=ids.__getitem__)
        group, size = [], 0
        for j, i in enumerate(by):
            group.append(i)
            size += len(texts[i])
            if size > 4 << 20 or j == len(by) - 1:
                chars, owner = _flat([texts[i].encode("ascii", "replace") for i in group])
                n = len(chars) - k + 1
                if n > 0:
                    whole = np.flatnonzero(owner[:n] == owner[k - 1 :])
                    own = packed_windows(_CODE[chars], k)[whole]
                    canon, first, count = np.unique(np.minimum(own, reverse_complement_codes(own, k)), return_index=True, return_counts=True)
                    at = whole[first]
                    begin = np.concatenate(([0], np.cumsum([len(texts[i]) for i in group])))
                    pos = at - begin[owner[at]]
                    cols = [pa.array(canon.view(np.int64)), batch.column(0).take(pa.array(np.array(group)[owner[at]])), pa.array(pos.astype(np.int64)), pa.array(own[first].view(np.int64)), pa.array(count)]
                    yield pa.RecordBatch.from_arrays(cols, ["canon", order, "pos", "own", "count"])
                group, size = [], 0


def bimolecule_packed(records: DataFrame, k: int, order: str, seq: str = "seq") -> DataFrame:
    """(kmer, count, order, pos): strands are one key, shown as it first occurred by (order, pos), and where that was.

    For DNA and k up to 31, from raw text; combined by batch before the shuffle. Records without an ``order`` value are left out.
    """
    if not 1 <= k <= 31:
        raise ValueError("k is from 1 to 31")
    ship_package(records.sparkSession)
    kind = dict(records.dtypes)[order]
    found = records.select(order, seq).mapInArrow(lambda it: _first_packed(it, k, order), f"canon long, `{order}` {kind}, pos long, own long, count long")
    out = found.groupBy("canon").agg(F.min(F.struct(order, "pos", "own")).alias("f"), F.sum("count").alias("count"))
    return out.select(DNA.unpack(F.col("f.own"), k).alias("kmer"), "count", f"f.{order}", "f.pos")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, one to one; 0 stays."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _sliding_least(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w numbers in a row."""
    width = 1
    while 2 * width <= w:
        a, width = np.minimum(a[:-width], a[width:]), 2 * width
    return np.minimum(a[: len(a) - (w - width)], a[w - width :]) if w > width else a


#: Of runs: letters of the part that all their windows share; windows that are cut, and those that are counted, at once.
SHARED, AT_ONCE, MOST = 31, 1 << 18, 3 << 20
_FOUR = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3  # the codes in a byte
_FOUR_LETTERS = np.ascontiguousarray(np.frombuffer(b"ACGT", np.uint8)[_FOUR]).view(np.uint32).ravel()
_RUN = "bucket int, size int, count long, bases binary"


def _run_batches(batches, k: int):
    """Runs of neighbouring windows that share the part of the least hash, four letters a byte; equal runs of some records are combined."""
    for batch in batches:
        for chars, owner in joined_texts(batch.column(0), 1 << 18):
            n = len(chars) - k + 1
            at = np.flatnonzero(owner[:n] == owner[k - 1 :]) if n > 0 else ()
            if not len(at):
                continue
            codes = _CODE[chars]
            least = _sliding_least(~_mixed(packed_windows(codes, SHARED)), k - SHARED + 1)[at]  # a part of A alone, which is common, has the greatest
            first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]))))
            data, buckets, found = codes.astype(np.uint8).tobytes(), (least[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), {}
            for i, (a, m) in enumerate(zip(at[first].tolist(), (np.diff(first, append=len(at)) + k - 1).tolist(), strict=True)):
                found.setdefault(data[a : a + m], [i, 0])[1] += 1
            sizes = np.array([len(x) for x in found])
            ends = np.cumsum((sizes + 3) // 4)
            wide = np.zeros(4 * ends[-1], np.uint8)
            wide[np.repeat(4 * (ends - (sizes + 3) // 4) - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.frombuffer(b"".join(found), np.uint8)
            four = wide.reshape(-1, 4)
            packed = (four[:, 0] << 6) | (four[:, 1] << 4) | (four[:, 2] << 2) | four[:, 3]
            bases = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(packed)])
            i, count = np.array(list(found.values())).T
            out = pa.RecordBatch.from_arrays([pa.array(buckets[i]), pa.array(sizes.astype(np.int32)), pa.array(count), bases], ["bucket", "size", "count", "bases"])
            for a in range(0, len(sizes), 50_000):
                yield out.slice(a, 50_000)


def _run_windows(rows: pa.Table, k: int):
    """(first k - 31 letters, last 31, count) of all windows of some runs."""
    bases = rows.column("bases").combine_chunks()
    bases = bases.chunk(0) if isinstance(bases, pa.ChunkedArray) else bases
    ends = np.frombuffer(bases.buffers()[1], np.int32)[bases.offset : bases.offset + len(bases) + 1]
    data = np.concatenate([np.frombuffer(bases.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.zeros(9, np.uint8)])
    words = np.ndarray(len(data) - 7, ">u8", data, 0, (1,))  # the 32 letters from each byte on
    n = rows.column("size").to_numpy().astype(np.int64) - k + 1
    at = np.repeat(4 * (ends[:-1] - ends[0]).astype(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())

    def letters(at, m: int):
        byte, shift = at >> 2, ((at & 3) << 1).astype(np.uint64)
        x = (words[byte].astype(np.uint64) << shift) | (data[byte + 8].astype(np.uint64) >> (np.uint64(8) - shift))
        return x >> np.uint64(64 - 2 * m)

    return letters(at, k - 31), letters(at + (k - 31), 31), np.repeat(rows.column("count").to_numpy(), n)


def _wide_sums(high: np.ndarray, low: np.ndarray, mix: np.ndarray, n: np.ndarray):
    """Sums by (high, low). Sorted by a hash; where two keys have one hash, by the keys."""
    order = np.argsort(mix)
    for _ in range(2):
        high_, low_ = high[order], low[order]
        new = (high_[1:] != high_[:-1]) | (low_[1:] != low_[:-1])
        if not np.any(new & (np.diff(mix[order]) == 0)):
            break
        order = np.lexsort((low, high))
        mix = np.arange(len(high), dtype=np.uint64)
    first = np.flatnonzero(np.concatenate(([True], new)))
    return high_[first], low_[first], np.add.reduceat(n[order], first)


def _run_counts(batches, k: int, least: int):
    """(kmer, count) of runs that come in the order of their buckets: equal windows have one bucket, so all that is held is counted at its ends."""

    def letters(high, low):
        parts = [_FOUR_LETTERS[x.astype(">u8").view(np.uint8)].view(np.uint8).reshape(len(x), 32) for x in (high, low)]
        return np.ascontiguousarray(np.concatenate([parts[0][:, 63 - k :], parts[1][:, 1:]], axis=1))

    def counted(rows: pa.Table, total: int):
        passes = -(-total // MOST)  # of one bucket with very many windows, a share at a time
        for p in range(passes):
            found, a = [], 0
            ends = np.cumsum(rows.column("size").to_numpy().astype(np.int64) - k + 1)
            while a < rows.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE)))
                high, low, n = _run_windows(rows.slice(a, b - a), k)
                mix = _mixed(high ^ _mixed(low))
                mine = slice(None) if passes == 1 else mix % np.uint64(passes) == p
                found.append((high[mine], low[mine], mix[mine], n[mine]))
                a = b
            high, low, mix, n = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(high):
                continue
            high, low, n = _wide_sums(high, low, mix, n)
            if least > 1:
                high, low, n = high[n >= least], low[n >= least], n[n >= least]
            for i in range(0, len(n), 50_000):
                text = letters(high[i : i + 50_000], low[i : i + 50_000])
                m = len(text)
                kmer = pa.StringArray.from_buffers(m, pa.py_buffer(np.arange(0, (m + 1) * k, k, dtype=np.int32)[: m + 1]), pa.py_buffer(text))
                yield pa.RecordBatch.from_arrays([kmer, pa.array(n[i : i + 50_000])], ["kmer", "count"])

    def weight(rows) -> int:
        return int(rows.column("size").to_numpy().astype(np.int64).sum()) - rows.num_rows * (k - 1)

    held, total, most = [], 0, AT_ONCE
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += weight(batch)
        if total >= most:
            rows = pa.Table.from_batches(held).combine_chunks()
            bucket = rows.column("bucket").to_numpy()
            cut = int(np.flatnonzero(bucket == bucket[-1])[0])
            if cut:
                yield from counted(rows.slice(0, cut), weight(rows.slice(0, cut)))
                rows = rows.slice(cut).combine_chunks()
            else:  # one bucket: equal runs are put together
                rows = rows.group_by(["bucket", "size", "bases"]).aggregate([("count", "sum")]).rename_columns({"count_sum": "count"}).select(["bucket", "size", "count", "bases"]).combine_chunks()
            held, total = rows.to_batches(), weight(rows)
            most = max(AT_ONCE, 2 * total)
    if held:
        yield from counted(pa.Table.from_batches(held).combine_chunks(), total)


def count_runs(records: DataFrame, k: int, least: int = 1, seq: str = "seq") -> DataFrame:
    """(kmer, count) of DNA for k from 32 to 63, from raw text, of k-mers that occur ``least`` times.

    What is shuffled is not windows but runs of neighbours that share the part of the least hash, about two bytes a window before compression;
    a task cuts its runs, sorted by that hash, into windows and counts them a few hashes at a time. Characters that DNA doesn't know count as A.
    """
    if not 32 <= k <= 63:
        raise ValueError("k is from 32 to 63")
    ship_package(records.sparkSession)
    runs = records.select(seq).mapInArrow(lambda it: _run_batches(it, k), _RUN)
    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _run_counts(it, k, least), "kmer string, count long")
