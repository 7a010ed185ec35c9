"""From files to indices: records are read, cut into tuples, and put into an index in one call."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..functions.quality import ILLUMINA18, Codec
from ..sources import seqfiles
from . import filters, generate
from .index import Index, strand

#: What the tuples of an index hold beside the k-mer.
KINDS = ("kmer", "count", "position", "position_quality")


def records_of(spark: SparkSession, path: str, split_bytes: int = 64 << 20, n: str = "keep") -> DataFrame:
    """The records of a file or folder. n: what becomes of records with N: keep them, ``drop`` them, or ``split`` them into runs without (seq, qual and offset)."""
    records = seqfiles.read(spark, path, split_bytes)
    if n == "drop":
        return filters.without_n(records, any_case=True)
    if n == "split":
        return filters.split_on(records, qual="qual" if "qual" in records.columns else None)
    if n != "keep":
        raise ValueError("n is keep, drop or split")
    return records


def tuples(records: DataFrame, k: int, kind: str = "count", alphabet: Alphabet = DNA, codec: Codec = ILLUMINA18, more: tuple[str, ...] = (), asked: list[str] | None = None) -> DataFrame:
    """(kmer[, value][, more...]) of records with file_id, record_start, seq (and qual): the value is 1, the position, or position and quality.

    more: columns of the records that positions take along; asked: the k-mers (of DNA, k up to 31) whose positions alone are made.
    Windows of a record shorter than k, and of none, give nothing. Positions count from the record's first base, or from that of its piece (column offset).
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    rows = records.withColumn("seq", alphabet.normalise(F.col("seq"))) if asked is None else records
    if kind == "kmer":
        return generate.kmers(rows, k).select("kmer")
    if kind == "count":
        return generate.kmer_counts_of_one(rows, k).withColumnRenamed("count", "value")
    keep = tuple(dict.fromkeys(("file_id", "record_start", *(c for c in ("offset",) if c in rows.columns), *more)))
    if asked is not None:
        made = generate.kmers_asked(rows, k, asked, keep=keep, codec=None if kind == "position" else codec)
    else:
        made = generate.kmers(rows, k, keep=keep) if kind == "position" else generate.kmers_with_quality(rows, k, codec, keep=keep)
    at = F.col("pos") + (F.col("offset") if "offset" in keep else 0)
    position = F.struct(F.col("file_id"), F.col("record_start"), at.cast("long").alias("offset"))
    return made.select("kmer", (position if kind == "position" else F.struct(position.alias("position"), "quality")).alias("value"), *more)


def build(source: DataFrame | str, k: int, kind: str = "count", container: str | None = None, model: str = "single", alphabet: Alphabet = DNA, codec: Codec = ILLUMINA18, spark: SparkSession | None = None, where: Column | None = None, more: tuple[str, ...] = (), **options) -> Index:
    """An index of the k-mers of a file, a folder, or records already read.

    kind: see tuples(); container: map, multimap, counting or saturating (counting for counts, multimap else); model: single or canonical strands;
    where: which tuples go in; more: columns of the records that positions take along; options: of Index.build(), such as sorted_by_range. Two-bit counts of k up to 31 are packed and combined before they are shuffled.
    """
    records = records_of(spark or SparkSession.active(), source) if isinstance(source, str) else source
    container = container or ("counting" if kind == "count" else "multimap")
    if kind == "count" and container == "counting" and where is None and alphabet.bits == 2 and k <= 31 and not options:
        counts = generate.count_packed(records, k, "canonical" if model == "canonical" else "single", alphabet)
        return Index(counts.withColumnRenamed("count", "value"), ("kmer",), kind="counting", transform=strand(model, alphabet))
    made = tuples(records, k, kind, alphabet, codec, more)
    if kind == "kmer":
        made = made.withColumn("value", F.lit(None).cast("boolean"))
    index = Index.build(made, ["kmer"], kind=container, where=where, transform=strand(model, alphabet), **options)
    if kind in ("position", "position_quality") and container == "multimap" and model == "single" and alphabet == DNA and k <= 31 and where is None and not options:
        return replace(index, only=(index.rows, lambda asked: tuples(records, k, kind, alphabet, codec, more, asked)))
    return index


def kmer_index(source, k: int, **options) -> Index:
    """The k-mers that occur, each once."""
    return build(source, k, "kmer", "map", **options)


def count_index(source, k: int, **options) -> Index:
    return build(source, k, "count", **options)


def saturating_count_index(source, k: int, most: int = 255, **options) -> Index:
    return build(source, k, "count", "saturating", most=most, **options)


def position_index(source, k: int, **options) -> Index:
    return build(source, k, "position", **options)


def position_quality_index(source, k: int, **options) -> Index:
    return build(source, k, "position_quality", **options)
