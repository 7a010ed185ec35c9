"""BPE encoding and decoding with content-defined chunks that documents share.

Texts are cut by a rolling hash alone, wherever it says, inside words too. Chunks are looked up first; each new one is encoded once,
without the words that its ends may have cut. Then the joins are repaired: the word that runs across a join is
encoded again together with the whole words before and after it, and the codes on both sides must come out as the chunks have
them. Where they don't, the two chunks become one and are encoded again, until all joins agree.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, documents, prepare

#: ASCII white space never lies inside a token of this kind of vocabulary (white space is dropped).
_SPACES = re.compile(rb"[ \t\n\v\f\r]")
_WINDOW = 16
#: A control character that is a word and a token of its own; words that hold it are encoded one by one.
_MARK = "\x1d"
_MARK_BYTES = _MARK.encode()
_GROUP = 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def rolling_hash(data: np.ndarray, window: int = _WINDOW) -> np.ndarray:
    """At each byte, the hash of the ``window`` bytes that end there (window: a power of two).

    Doubles the width instead of rolling: h_2w(i) = h_w(i - w) * B**w + h_w(i), four vector operations for 16.
    """
    h = data.astype(np.uint32) + np.uint32(1)
    width, power = 1, 0x01000193
    while width < window:
        wide = h.copy()
        wide[width:] += h[:-width] * np.uint32(power)
        h, width, power = wide, width * 2, power * power % 2**32
    return h


def cuts(text: bytes, bits: int = 9, longest: int = 1 << 16) -> list[int]:
    """Ends of the content-defined chunks of a text.

    A cut is where the rolling hash has ``bits`` zero bits at its top, or at the next character boundary; so equal passages in
    different documents have equal chunks from their first cut on. Stretches of over ``longest`` bytes without any are cut as well.
    """
    if len(text) < 1 << bits:
        return [len(text)] if text else []
    data = np.frombuffer(text, np.uint8)
    hits = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - bits) == 0) + 1
    starts = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(text))
    ends = np.unique(np.append(starts[np.searchsorted(starts, hits)], len(text)))
    if np.diff(ends, prepend=0).max() <= longest:
        return ends.tolist()
    out, last = [], 0
    for e in ends.tolist():
        while e - last > longest:
            last += longest
            while data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        out.append(e)
        last = e
    return out


def chunked(text: bytes, bits: int = 9, longest: int = 1 << 16) -> list[bytes]:
    ends = cuts(text, bits, longest)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class Chunk(NamedTuple):
    """A coded chunk: what stands before its first and after its last white space, and the codes of the words between.

    first and last: the first and last of these words with their ids, None if there are none. A chunk without white space is all head, and tail is None.
    """

    head: bytes
    tail: bytes | None
    ids: bytes
    text: bytes
    first: tuple[bytes, list[int]] | None
    last: tuple[bytes, list[int]] | None


class ChunkCoder:
    """Encodes blocks of texts chunk by chunk; chunks, joins and words seen before are looked up.

    For each text: its ids as decimals joined by spaces, and its decoded text, both bytes. The
    tables are renewed when they pass ``most`` bytes, so memory is bounded and results are the same.
    """

    def __init__(self, path: str, bits: int = 9, most: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits, self.most = bits, most
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.word_ids: dict[bytes, bytes] = {}
        self.word_text: dict[bytes, bytes] = {}
        self.old_ids: dict[bytes, bytes] = {}
        self.old_text: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, Chunk] = {}
        self.joins: dict[tuple, tuple[bytes, bytes] | None] = {}
        self.word_size = self.chunk_size = self.join_size = 0
        self.encoded_chunks = self.encoded_joins = 0
        self._tables()

    def _tables(self) -> None:
        """The decimal and the decoded form of every id."""
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.decimal = [b"%d" % i for i in range(n)]
        self.decoded = [self.tokenizer.decode([i], skip_special_tokens=False).encode() for i in range(n)]

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. Words go to the tokenizer many at a time, a mark between them that is one token."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if _MARK_BYTES not in w and b"<|" not in w]
        groups = [plain[i : i + _GROUP] for i in range(0, len(plain), _GROUP)] if self.mark is not None else []
        joined = [f" {_MARK} ".join([words[i].decode() for i in g]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = e.ids
            ends = np.flatnonzero(np.array(ids) == self.mark).tolist()
            last = 0
            for i, end in zip(g, [*ends, len(ids)], strict=True):
                out[i] = ids[last:end]
                last = end + 1
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def learn(self, words: list[bytes]) -> None:
        """Makes the words' codes known. When the table is full it becomes the old one, of which what is used again is kept."""
        if self.word_size > self.most:
            self.old_ids, self.old_text = self.word_ids, self.word_text
            self.word_ids, self.word_text, self.word_size = {}, {}, 0
        new = []
        for w in dict.fromkeys(w for w in words if w not in self.word_ids):
            if w in self.old_ids:
                self.word_ids[w], self.word_text[w] = self.old_ids[w], self.old_text[w]
                self.word_size += 2 * len(w) + len(self.word_ids[w]) + 240
            else:
                new.append(w)
        decimal, decoded = self.decimal, self.decoded
        for w, ids in zip(new, self._ids(new), strict=True):
            self.word_ids[w] = code = b" ".join([decimal[i] for i in ids])
            self.word_text[w] = b" ".join([decoded[i] for i in ids])
            self.word_size += 2 * len(w) + len(code) + 240

    def _encode_chunks(self, parts: list[bytes]) -> dict[bytes, Chunk]:
        """The codes of chunks; the new ones are encoded together."""
        out = {p: self.chunks.get(p) for p in parts}
        new = [p for p, c in out.items() if c is None]
        self.encoded_chunks += len(new)
        cut = []
        for p in new:
            a = _SPACES.search(p)
            if a is None:
                cut.append(None)
                continue
            words = p[a.start() :].split()
            tail = words.pop() if words and not p[-1:].isspace() else b""
            cut.append((p[: a.start()], tail, words))
        self.learn([w for c in cut if c for w in c[2]])
        if self.chunk_size > self.most // 3:
            self.chunks, self.chunk_size = {}, 0
        for p, c in zip(new, cut, strict=True):
            if c is None:
                out[p] = Chunk(p, None, b"", b"", None, None)
                continue
            head, tail, words = c
            ids = b" ".join(filter(None, map(self.word_ids.__getitem__, words)))
            ends = [(w, [int(i) for i in self.word_ids[w].split()]) for w in (words[0], words[-1])] if words else (None, None)
            out[p] = chunk = Chunk(head, tail, ids, b" ".join(filter(None, map(self.word_text.__getitem__, words))), *ends)
            if len(p) > 64:
                self.chunks[p] = chunk
                self.chunk_size += len(p) + len(ids) + len(chunk.text) + 800
        return out

    def _encode_joins(self, joins: list[tuple]) -> dict[tuple, tuple[bytes, bytes] | None]:
        """The codes of the words across joins, given as (last, word, first); None where the neighbours' codes come out otherwise."""
        key = lambda j: (j[0] and j[0][0], j[1], j[2] and j[2][0])
        asked = {key(j): j for j in joins}
        out = {k: self.joins[k] for k in asked if k in self.joins}
        new = [k for k in asked if k not in out]
        self.encoded_joins += len(new)
        if self.join_size > self.most // 3:
            self.joins, self.join_size = {}, 0
        for k, ids in zip(new, self._ids([b" ".join(w for w in k if w) for k in new]), strict=True):
            before, after = asked[k][0][1] if k[0] else [], asked[k][2][1] if k[2] else []
            a, b = len(before), len(ids) - len(after)
            agree = a <= b and ids[:a] == before and ids[b:] == after
            out[k] = self.joins[k] = (b" ".join([self.decimal[i] for i in ids[a:b]]), b" ".join([self.decoded[i] for i in ids[a:b]])) if agree else None
            self.join_size += 3 * sum(len(w) for w in k if w) + 300
        return out

    @staticmethod
    def _joins(parts: list[bytes], chunks: dict[bytes, Chunk]):
        """(place among the parts of the chunk that ends the word, last, word, first) of every join; the text's ends are joins too."""
        pending, last = b"", None
        for i, p in enumerate(parts):
            c = chunks[p]
            pending += c.head
            if c.tail is not None:
                yield i, last, pending, c.first
                pending, last = c.tail, c.last
        yield len(parts), last, pending, None

    def code(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        todo, out = {i: chunked(t, self.bits) for i, t in enumerate(texts)}, [(b"", b"")] * len(texts)
        while todo:
            chunks = self._encode_chunks([p for parts in todo.values() for p in parts])
            joins = {i: list(self._joins(parts, chunks)) for i, parts in todo.items()}
            key = lambda last, word, first: (last and last[0], word, first and first[0])
            codes = self._encode_joins([j[1:] for js in joins.values() for j in js if j[2]])
            left = {}
            for i, parts in todo.items():
                ids, text, bad = [], [], set()
                for at, last, word, first in joins[i]:
                    if word:
                        got = codes[key(last, word, first)]
                        if got is None:
                            bad.add(at)
                            continue
                        ids.append(got[0])
                        text.append(got[1])
                    if at < len(parts):
                        ids.append(chunks[parts[at]].ids)
                        text.append(chunks[parts[at]].text)
                if bad:
                    left[i] = glued(parts, bad)
                else:
                    out[i] = b" ".join(filter(None, ids)), b" ".join(filter(None, text))
            todo = left
        return out


def glued(parts: list[bytes], bad: set[int]) -> list[bytes]:
    """Parts with each of those in ``bad`` put to the one before it; one alone gets a space, so that its first word is whole."""
    out: list[bytes] = []
    for i, p in enumerate(parts):
        if i in bad and out:
            out[-1] += p
        else:
            out.append(p)
    if len(parts) in bad and len(out) > 1:
        out[-2:] = [out[-2] + out[-1]]
    return out if len(out) < len(parts) else [b" " + b"".join(parts) + b" "]


_coders: dict[tuple, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """One coder for each Python worker; workers serve many tasks, so its tables stay warm."""
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


def _code_batches(batches, path: str, give: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    c = coder(path)
    for batch, texts in blocks(batches, 4 << 20):
        n, ids_col, text_col = [], [], []
        for ids, text in c.code(texts):
            n.append(ids.count(b" ") + 1 if ids else 0)
            if give == "digest":
                ids_col.append(hashlib.sha256(ids).hexdigest())
                text_col.append(hashlib.sha256(text).hexdigest())
            elif give == "full":
                ids_col.append(np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32))
                text_col.append(text.decode())
        cols = [batch.column("doc_id"), pa.array(n, pa.int64())]
        names = ["doc_id", "n_tokens"]
        if give == "digest":
            cols, names = [*cols, pa.array(ids_col), pa.array(text_col)], [*names, "ids_sha256", "decoded_sha256"]
        elif give == "full":
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids_col]))).astype(np.int32)
            values = np.concatenate(ids_col) if ids_col else np.zeros(0, np.int32)
            cols, names = [*cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array(text_col, pa.string())], [*names, "ids", "decoded"]
        yield pa.RecordBatch.from_arrays(cols, names)


def _coded(docs: DataFrame, path: str | None, give: str, more: str) -> DataFrame:
    prepare(docs.sparkSession)
    path = path or default_tokenizer()
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda it: _code_batches(it, path, give), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long{more}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids (array of int) and decoded (the text its ids give).

    Null and empty texts have no ids and decode to an empty text; repeated rows give repeated
    rows; other columns are ignored; no rows give no rows. ``path`` names a tokenizers file whose vocabulary drops
    white space, readable on every executor. Rows are coded where they are read: no shuffle.
    """
    return _coded(docs, path, "full", ", ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """encode() with SHA-256 digests of the ids and of the decoded text instead of both."""
    return _coded(docs, path, "digest", ", ids_sha256 string, decoded_sha256 string")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens alone."""
    return _coded(docs, path, "count", "")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """encode_digest() of the whole table documents."""
    return encode_digest(documents(spark, sf_dir))
