"""Record filters and splits."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package


def where(records: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Records that satisfy the predicate; none given: all."""
    return records if predicate is None else records.where(predicate)


def without_n(records: DataFrame, seq: str = "seq", any_case: bool = False) -> DataFrame:
    """Drops records that hold an upper-case N (or n too)."""
    has = F.upper(F.col(seq)).contains("N") if any_case else F.col(seq).contains("N")
    return records.where(~has)


def _split_batches(batches, pattern: str, seq: str, qual: str | None):
    runs = re.compile(pattern)
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            quals = part.column(qual).to_pylist() if qual else [None] * part.num_rows
            row, at, text, q = [], [], [], []
            for i, (s, own) in enumerate(zip(part.column(seq).to_pylist(), quals, strict=True)):
                for m in runs.finditer(s or ""):
                    row.append(i)
                    at.append(m.start())
                    text.append(m.group())
                    q.append(own[m.start() : m.end()] if own is not None else None)
            made = {seq: pa.array(text, pa.string())} | ({qual: pa.array(q, pa.string())} if qual else {})
            cols = [made.get(n, part.column(n).take(pa.array(row, pa.int64())) if n not in made else None) for n in part.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at, pa.int64())], [*part.schema.names, "offset"])


def split_on(records: DataFrame, bad: str = "Nn", seq: str = "seq", qual: str | None = None) -> DataFrame:
    """Each record's maximal runs without a bad character: the run as ``seq``, its own part of ``qual``, its offset in the record."""
    ship_package(records.sparkSession)
    rows = records.drop("offset")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda it: _split_batches(it, f"[^{re.escape(bad)}]+", seq, qual), f"{schema}, offset long")


def without_line_ends(records: DataFrame, seq: str = "seq") -> DataFrame:
    return records.withColumn(seq, F.regexp_replace(seq, r"[\r\n]", ""))


def owned_windows(records: DataFrame, k: int, block: int, seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., block, windows): how many windows start in each block of ``block`` characters: a window belongs to the block of its first."""
    n = F.char_length(seq) - k + 1
    rows = records.where(n > 0).select(*keep, n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))).alias("block"))
    return rows.select(*keep, "block", F.least(F.lit(block), F.col("n") - F.col("block") * block).cast("long").alias("windows"))
