"""Random records, the same for the same seed wherever they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..functions.quality import ILLUMINA18, Codec


def random_records(spark: SparkSession, n: int, size: int, alphabet: Alphabet = DNA, seed: int = 1, codec: Codec | None = None) -> DataFrame:
    """(record_start, seq[, qual]): n records of ``size`` symbols, drawn evenly by a hash of record, place and seed."""
    letters = "".join(c for c in alphabet.symbols if c != "?")
    places = F.sequence(F.lit(1), F.lit(size))

    def drawn(salt: int, count: int):
        return lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed), F.lit(salt)), F.lit(count)).cast("int")

    pick = drawn(0, len(letters))
    rows = spark.range(n).withColumn("seq", F.array_join(F.transform(places, lambda i: F.substring(F.lit(letters), pick(i) + 1, F.lit(1))), ""))
    if codec:
        score = drawn(1, codec.last - codec.first + 1)
        rows = rows.withColumn("qual", F.array_join(F.transform(places, lambda i: F.char(score(i) + codec.first)), ""))
    return rows.withColumnRenamed("id", "record_start")


def random_reads(spark: SparkSession, n: int, size: int, seed: int = 1) -> DataFrame:
    return random_records(spark, n, size, DNA, seed, ILLUMINA18)
