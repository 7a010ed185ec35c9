"""Global row numbers without one global task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with 0, 1, ... in the order of the columns. Rows are dealt by ranges, sorted and numbered in each, and moved by the sizes of those before.

    All columns of df go through a checkpoint, so leave out those that aren't asked for.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = checkpointed(parts.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select("_p", before.alias("_o"))
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_i") + F.col("_o")).cast("long")).drop("_p", "_i", "_o")
