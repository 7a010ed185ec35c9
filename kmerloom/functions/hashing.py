"""The 128-bit hash of the Murmur family, for placements that must agree with other programs; Spark's own hashes are faster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

# The constants of MurmurHash3 x64 128.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_FIRST, _SECOND = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
SEED = 42


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _finished(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def murmur3_of(keys: list[bytes], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Both words of the hash of each key; keys of one length are hashed together."""
    low, high = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    sizes = np.array([len(k) for k in keys], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        wide = np.zeros((len(at), (size + 15) // 16 * 16), np.uint8)
        if size:
            wide[:, :size] = np.frombuffer(b"".join(keys[i] for i in at.tolist()), np.uint8).reshape(-1, size)
        lanes = wide.view("<u8").astype(np.uint64)
        a, b = (np.full(len(at), seed, np.uint64) for _ in range(2))
        whole = size // 16
        for i in range(lanes.shape[1] // 2):
            x, y = _turned(lanes[:, 2 * i] * _C1, 31) * _C2, _turned(lanes[:, 2 * i + 1] * _C2, 33) * _C1
            if i < whole:
                a = (_turned(a ^ x, 27) + b) * np.uint64(5) + _FIRST
                b = (_turned(b ^ y, 31) + a) * np.uint64(5) + _SECOND
            else:  # what is left: lanes without bytes are 0 and change nothing
                a, b = a ^ x, b ^ y
        a, b = a ^ np.uint64(size), b ^ np.uint64(size)
        a = a + b
        b = b + a
        a, b = _finished(a), _finished(b)
        a = a + b
        low[at], high[at] = a, b + a
    return low, high


def murmur3(key: str | Column, word: int = 0, seed: int = SEED) -> Column:
    """One word of the hash of a string column's UTF-8 bytes, as a signed number: word 1 places keys on partitions, word 0 inside one."""

    ship_package(SparkSession.active())

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            words = murmur3_of([x.encode() for x in s], seed)
            yield pd.Series(words[word].view(np.int64))

    return hashed(key)


def murmur_place(key: str | Column, parts: int, seed: int = SEED) -> Column:
    """Which of ``parts`` a key is dealt to, by word 1 as an unsigned number."""
    half = F.pmod(F.shiftrightunsigned(murmur3(key, 1, seed), 1), F.lit(parts))
    return F.pmod(half * 2 + murmur3(key, 1, seed).bitwiseAND(F.lit(1)), F.lit(parts)).cast("int")
