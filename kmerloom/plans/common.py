"""Tables as records, and the SQL that stands for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..session import spread

TEXT = "coalesce(text, '')"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(spark, sf_dir: str) -> DataFrame:
    """(doc_id, seq): the documents' texts as they are; null is empty."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("seq")))


def sequences(spark, sf_dir: str, alphabet: Alphabet = DNA) -> DataFrame:
    """(doc_id, seq): the documents' texts read in an alphabet."""
    return raw_texts(spark, sf_dir).withColumn("seq", alphabet.normalise(F.col("seq")))


def sequences_sql(alphabet: Alphabet = DNA) -> str:
    return f"d AS (SELECT doc_id, {alphabet.normalise_sql(TEXT)} AS s FROM documents)"


def kmers_sql(k: int, alphabet: Alphabet = DNA) -> str:
    """WITH-clauses d and k: (doc_id, pos, kmer)."""
    return f"{sequences_sql(alphabet)}, k AS (SELECT doc_id, i - 1 AS pos, substr(s, i, {k}) AS kmer FROM (SELECT doc_id, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM d))"


def rc_sql(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def canonical_sql(x: str) -> str:
    return f"least({x}, {rc_sql(x)})"


def registered(queries: dict) -> Callable:
    """A decorator that puts a query and its SQL under the function's name."""

    def with_sql(sql: str | None = None) -> Callable:
        def put(f):
            queries[f.__name__] = (f, sql)
            return f

        return put

    return with_sql
