"""k-mer counts and event windows on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.generate import kmers


def kmer_counts(stream: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Running counts of a stream of records, for output modes update and complete. State holds a row for each k-mer seen."""
    return kmers(stream, k, seq).groupBy("kmer").agg(F.count("*").alias("count"))


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need time stamps with a zone; those without are read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_kmer_counts(stream: DataFrame, k: int, time: str, window: str, late: str, seq: str = "seq") -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are dropped, so state is bounded and windows are put out once."""
    rows = kmers(_timed(stream, time, late), k, seq, (time,))
    return rows.groupBy(F.window(time, window), "kmer").agg(F.count("*").alias("count"))


def windowed_events(stream: DataFrame, time: str, late: str, window: str, slide: str, keys: list[str], value: str) -> DataFrame:
    rows = _timed(stream, time, late).groupBy(F.window(time, window, slide), *keys)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def append_batches(stream: DataFrame, index_path: str, k: int, checkpoint: str, seq: str = "seq"):
    """Adds each micro-batch's counts to a Parquet index under its batch number; reading sums them. A batch that runs again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        kmers(batch, k, seq).groupBy("kmer").agg(F.count("*").alias("count")).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def read_index(spark, index_path: str) -> DataFrame:
    return spark.read.parquet(index_path).groupBy("kmer").agg(F.sum("count").alias("count"))
