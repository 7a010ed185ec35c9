"""What containers do on insert, as aggregations by key."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package


def first_wins(df: DataFrame, keys: list[str], value: Column, order: Column, name: str = "value") -> DataFrame:
    """One value for each key: that of the least ``order``."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(name))


def reduced(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def reduced_by(df: DataFrame, keys: list[str], value: str, fold: Callable, name: str = "value") -> DataFrame:
    """Any associative and commutative fold of pairs, given as a Python function; partial folds run before the shuffle.

    For folds that Spark has no aggregate for.
    """
    ship_package(df.sparkSession)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{name}` {kinds[value]}"])

    def partial(batches):
        for pdf in batches:
            out = pdf.groupby(keys, dropna=False)[value].agg(lambda s: _folded(s, fold)).reset_index()
            yield out.rename(columns={value: name})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby(keys, dropna=False)[name].agg(lambda s: _folded(s, fold)).reset_index()

    half = df.select(*keys, value).mapInPandas(partial, schema)
    return half.groupBy(*keys).applyInPandas(final, schema)


def _folded(values, fold: Callable):
    it = iter(values)
    out = next(it)
    for v in it:
        out = fold(out, v)
    return out


def counted(df: DataFrame, keys: list[str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def saturated(df: DataFrame, keys: list[str], most: int, name: str = "count") -> DataFrame:
    """Counts that stop at ``most``."""
    return df.groupBy(*keys).agg(F.least(F.count("*"), F.lit(most).cast("long")).alias(name))


def sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: size, unique_size, multiplicity (their ratio), is_empty. Keys are counted after they are grouped, so a hot one costs nothing."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    size, unique = F.coalesce(F.sum("n"), F.lit(0).cast("long")), F.count("*")
    return per_key.agg(size.alias("size"), unique.alias("unique_size"), (size / F.nullif(unique, F.lit(0))).alias("multiplicity"), (unique == 0).alias("is_empty"))


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def range_sorted(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Rows in global order of the keys over range partitions; equal keys share one."""
    by = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return by.sortWithinPartitions(*keys)


def rebalanced(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts)


def sampled(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(fraction, seed)


def sampled_by_key(df: DataFrame, key: str, ratio: int) -> DataFrame:
    """One key in ``ratio``, the same ones wherever the table is read."""
    return df.where(F.pmod(F.col(key), F.lit(ratio)) == 0)
