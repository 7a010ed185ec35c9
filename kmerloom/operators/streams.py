"""Combinators on streams of elements: map, filter, zip, concatenate, expand, fold, slide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transform(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def filter_transform(df: DataFrame, predicate: Column, **columns: Column) -> DataFrame:
    """Elements that satisfy the predicate, transformed; the predicate may look at a parallel column."""
    return df.where(predicate).withColumns(columns)


def conditional(df: DataFrame, predicate: Column, yes: Callable[[DataFrame], DataFrame], no: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Two transforms with one schema, by predicate; a null predicate counts as false."""
    p = F.coalesce(predicate, F.lit(False))
    return yes(df.where(p)).unionByName(no(df.where(~p)))


def zipped(df: DataFrame, a: str, b: str, out: str = "zipped") -> DataFrame:
    return df.withColumn(out, F.arrays_zip(a, b))


def unzipped(df: DataFrame, pairs: str, field: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(pairs)[field])


def concatenated(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def counting(df: DataFrame, name: str, start: Column, stride: int, n: Column) -> DataFrame:
    """n rows for each: start, start + stride, ..."""
    rows = df.where(n > 0)
    return rows.withColumn(name, F.explode(F.sequence(start, start + (n - 1) * stride, F.lit(stride))))


def one_to_many(df: DataFrame, array: Column, name: str, pos: str = "pos") -> DataFrame:
    return df.select("*", F.posexplode(array).alias(pos, name))


def many_to_one(df: DataFrame, keys: list[str], pos: str, m: int, *aggregates: Column) -> DataFrame:
    """Folds each m neighbours (by place in ``pos``) of a key to one row."""
    return df.groupBy(*keys, F.floor(F.col(pos) / m).alias("chunk")).agg(*aggregates)


def sliding(df: DataFrame, keys: list[str], order: list[str], size: int, **aggregates: Callable[..., Column] | Column) -> DataFrame:
    """A row for each full window of ``size`` rows, with aggregates over it; keyed, so keys slide side by side."""
    by = Window.partitionBy(*keys).orderBy(*order)
    w = by.rowsBetween(0, size - 1)
    out = df.withColumns({k: a.over(w) for k, a in aggregates.items()}).withColumn("_n", F.count("*").over(w))
    return out.where(F.col("_n") == size).drop("_n")
