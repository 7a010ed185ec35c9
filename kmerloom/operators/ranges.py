"""Half-open intervals and range-partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """[a, b) and [c, d) in common, as a struct; null if nothing is."""
    low, high = F.greatest(a, c), F.least(b, d)
    return F.when(low < high, F.struct(low.alias("start"), high.alias("end")))


def hull(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.struct(F.least(a, c).alias("start"), F.greatest(b, d).alias("end"))


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)


def adjacent(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (b == c) | (d == a)


def contains(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= c) & (d <= b)


def shifted(a: Column, b: Column, by: Column) -> Column:
    return F.struct((a + by).alias("start"), (b + by).alias("end"))


def merged(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Each key's intervals joined where they overlap or touch."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def blocks(total: int, parts: int) -> list[tuple[int, int]]:
    """[0, total) in ``parts`` ranges whose sizes differ by one at most, the larger ones first."""
    size, rest = divmod(total, parts)
    at = [i * size + min(i, rest) for i in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def in_blocks(df: DataFrame, number: str, total: int, parts: int) -> DataFrame:
    """Rows numbered from 0 to total - 1 dealt to blocks(): the first ones to part 0."""
    size, rest = divmod(total, parts)
    n = F.col(number)
    part = F.when(n < rest * (size + 1), F.floor(n / (size + 1))).otherwise(rest + F.floor((n - rest * (size + 1)) / max(size, 1)))
    return df.withColumn("part", part.cast("int"))


def cyclic(df: DataFrame, number: str, parts: int) -> DataFrame:
    """Row numbers dealt to parts in turn."""
    return df.withColumn("part", F.pmod(F.col(number), F.lit(parts)).cast("int"))


def between(df: DataFrame, key: str, low, high) -> DataFrame:
    return df.where((F.col(key) >= low) & (F.col(key) < high))
