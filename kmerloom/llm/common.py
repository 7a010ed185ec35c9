"""What the corpus operators share: session set-up, scratch tables and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package, spread

#: Rows in one Arrow batch: few enough that a batch of very long texts stays small.
ARROW_ROWS = 1000

def prepare(spark: SparkSession) -> SparkSession:
    """Makes the package importable on every executor, sets a checkpoint folder where none is set, and bounds batches."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def scratch_path(spark: SparkSession) -> str:
    """A new folder name inside the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def written(df: DataFrame) -> DataFrame:
    """df, cut from its lineage by a Parquet table in the shared folder that outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents; if it has fewer splits than there are cores, its rows are dealt to all of them."""
    return spread(table(spark, sf_dir, "documents"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; the rest goes when the session ends."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path.rpartition("/")[2].startswith("table-"):
                _remove(df.sparkSession, path)


def freed(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more; it finds these when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


def sized_broadcast(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, to be broadcast if the sum of ``row_bytes`` (an upper estimate of a row in memory) is at most BROADCAST_BYTES; else as it is, to be shuffled."""
    size = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def packed_row(df: DataFrame, name: str = "_row") -> Column:
    """All columns of df in one, so that no name of theirs clashes with those an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked_row(rows: DataFrame, df: DataFrame, name: str = "_row") -> DataFrame:
    """The columns of df again."""
    return rows.select(*[F.col(f"{name}.`{c}`") for c in df.columns])


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- vectorised words

#: ASCII white space: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_INV = pow(int(_MULT), -1, 1 << 64)


def words_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes the white-space separated words of all texts at once.

    Returns (word hash uint64, document ordinal of each word int32, number of words of each document).
    The hash is a polynomial in the word's bytes modulo 2**64, finalised, so equal words of any two
    calls have equal hashes. ``lower`` folds A-Z only.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _SPACE[data]
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(gap & np.concatenate(([False], inside[:-1])))
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    doc_starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    doc = (np.searchsorted(doc_starts, starts, side="right") - 1).astype(np.int32)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), int(_MULT)), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(len(data) + 1, _INV)[starts]
    h = mix(h + (ends - starts).astype(np.uint64))
    return h, doc, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def trim() -> None:
    """Gives memory that is free back to the system: workers outlive their tasks, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU C library has it
        pass


def blocks(batches: Iterator, most_bytes: int = 1 << 20) -> Iterator[tuple]:
    """Slices Arrow batches with a ``text`` column into (batch slice, texts as bytes) of bounded size."""
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column("text").cast("binary").to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most_bytes:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t)
        if at < len(texts):
            yield batch.slice(at), texts[at:]
    trim()
