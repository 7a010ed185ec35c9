"""Queries on files: the documents are written as FASTQ and FASTA to the shared folder, and read back in odd splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import DNA
from ..functions.quality import ILLUMINA18
from ..operators import build, filters, generate, graph
from ..session import scratch_path, ship_package
from ..sources import random, seqfiles
from .common import canonical_sql, kmers_sql, raw_texts, registered, sequences, sequences_sql, table

QUERIES: dict = {}
query = registered(QUERIES)
SPLIT = 50_021  # bytes: no record starts with a split but by chance

_Q = "array_to_string(list_transform(range(1, length(s) + 1), lambda i: chr(33 + ((7 * (i - 1) + ascii(substr(s, i, 1))) % 41)::INT)), '')"


def _quality_batches(batches, at: int):
    for batch in batches:
        seq = batch.column(at)
        text = [s.encode("ascii", "replace") for s in seq.to_pylist()]
        ends = np.cumsum([0, *map(len, text)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        chars = ((7 * place + np.frombuffer(b"".join(text), np.uint8)) % 41 + 33).astype(np.uint8)
        qual = pa.StringArray.from_buffers(len(text), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(chars))
        yield pa.RecordBatch.from_arrays([*batch.columns, qual], [*batch.schema.names, "qual"])


def with_quality(records: DataFrame) -> DataFrame:
    """Phred characters made from the text, which is ASCII: place and base give a score from 0 to 40."""
    ship_package(records.sparkSession)
    rows = records.where(F.length("seq") > 0)
    at = rows.columns.index("seq")
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), "qual string"])
    return rows.mapInArrow(lambda it: _quality_batches(it, at), schema)


def _fastq(spark, sf_dir, parts: int | None = None) -> str:
    rows = sequences(spark, sf_dir).withColumnRenamed("doc_id", "name")
    rows = rows.repartitionByRange(parts, "name").sortWithinPartitions("name") if parts else rows
    return seqfiles.write_fastq(with_quality(rows), scratch_path(spark))


def _reads(spark, sf_dir, split: int = SPLIT) -> DataFrame:
    return seqfiles.read(spark, _fastq(spark, sf_dir), split)


def _fasta(spark, sf_dir, width: int | None) -> str:
    return seqfiles.write_fasta(sequences(spark, sf_dir).where("seq <> ''").withColumnRenamed("doc_id", "name"), scratch_path(spark), width)


@query(f"WITH {sequences_sql()} SELECT doc_id, length(s)::BIGINT AS size, md5(s) AS seq_md5, md5({_Q}) AS qual_md5, (length(doc_id::VARCHAR) + 5 + 2 * length(s) - 0)::BIGINT AS record_size, (length(doc_id::VARCHAR) + 2)::BIGINT AS seq_at FROM d WHERE s <> ''")
def fastq_scan(spark, sf_dir) -> DataFrame:
    rows = _reads(spark, sf_dir)
    return rows.select(F.col("name").cast("long").alias("doc_id"), F.char_length("seq").cast("long").alias("size"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.md5(F.col("qual").cast("binary")).alias("qual_md5"), "record_size", F.col("seq_begin_offset").alias("seq_at"))


@query(f"WITH {sequences_sql()} SELECT doc_id, length(s)::BIGINT AS size, md5(s) AS seq_md5, (length(doc_id::VARCHAR) + 1 + length(s) + (length(s) + 59) // 60)::BIGINT AS record_size, ((length(s) + 59) // 60)::BIGINT AS n_lines, (length(doc_id::VARCHAR) + 1 + length(s) + (length(s) + 59) // 60 - 1)::BIGINT AS last_byte FROM d WHERE s <> ''")
def fasta_scan(spark, sf_dir) -> DataFrame:
    """Lines of 60; last_byte is that of the last base, found through the table of lines."""
    rows = seqfiles.read(spark, _fasta(spark, sf_dir, 60), SPLIT)
    last = seqfiles.byte_of(F.char_length("seq") - 1, F.col("lines"))
    return rows.select(F.col("name").cast("long").alias("doc_id"), F.char_length("seq").cast("long").alias("size"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), "record_size", F.size("lines").cast("long").alias("n_lines"), last.alias("last_byte"))


@query(f"WITH {sequences_sql()} SELECT doc_id, length(s)::BIGINT AS bases, md5(s) AS seq_md5, greatest(length(s) - 14, 0)::BIGINT AS windows FROM d WHERE s <> ''")
def fasta_pieces(spark, sf_dir) -> DataFrame:
    """Records of one line, read in pieces by splits smaller than a record: the pieces put together are the record, and each window is in one."""
    rows = seqfiles.read_fasta_pieces(spark, _fasta(spark, sf_dir, None), 14, 4_099)
    rows = rows.withColumn("windows", F.greatest(F.char_length("seq") - 14, F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("base", F.expr("left(seq, cast(valid as int))").alias("own"))))
    whole = rows.groupBy("file_id", "record_start", F.col("name").cast("long").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda p: p.own), "").alias("s"), F.sum("windows").cast("long").alias("windows"))
    return whole.select("doc_id", F.char_length("s").cast("long").alias("bases"), F.md5(F.col("s").cast("binary")).alias("seq_md5"), "windows")


@query(f"WITH {kmers_sql(15)} SELECT doc_id, count(*) AS windows, sum(pos)::BIGINT AS places, count(DISTINCT kmer) AS kmers, min(kmer) AS least, max(kmer) AS most FROM k GROUP BY doc_id")
def fasta_piece_kmers(spark, sf_dir) -> DataFrame:
    """k-mers of pieces with their places in the whole record, by record."""
    rows = seqfiles.read_fasta_pieces(spark, _fasta(spark, sf_dir, 60), 14, 9_001)
    found = generate.kmers(rows.withColumn("doc_id", F.col("name").cast("long")), 15, keep=("doc_id", "base"))
    return found.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(F.col("base") + F.col("pos")).alias("places"), F.count_distinct("kmer").alias("kmers"), F.min("kmer").alias("least"), F.max("kmer").alias("most"))


@query(f"WITH {sequences_sql()} SELECT round(avg(length(doc_id::VARCHAR) + 5 + 2 * length(s)), 6) AS record_size, round(avg(length(s)), 6) AS seq_size FROM d WHERE s <> ''")
def record_sizes(spark, sf_dir) -> DataFrame:
    """The size estimate, asked of all records."""
    found = seqfiles.record_size_estimate(_reads(spark, sf_dir), 2**31 - 1)
    return found.select(F.round("record_size", 6).alias("record_size"), F.round("seq_size", 6).alias("seq_size"))


@query(f"WITH {sequences_sql()} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq_index, doc_id FROM d WHERE s <> ''")
def record_numbers(spark, sf_dir) -> DataFrame:
    """Records numbered through all files in order."""
    rows = seqfiles.read(spark, _fastq(spark, sf_dir, 3), SPLIT).select("file_id", "record_start", "name")
    rows = seqfiles.with_numbers(rows)
    return rows.select("seq_index", F.col("name").cast("long").alias("doc_id"))


@query(f"WITH {kmers_sql(21)} SELECT kmer, count(*) AS count FROM k GROUP BY kmer")
def file_count_index(spark, sf_dir) -> DataFrame:
    return build.count_index(_fastq(spark, sf_dir), 21, spark=spark).rows.select("kmer", F.col("value").alias("count"))


@query(f"WITH {kmers_sql(9)}, c AS (SELECT {canonical_sql('kmer')} AS kmer, count(*) AS n FROM k GROUP BY 1) SELECT kmer, least(n, 7)::BIGINT AS count FROM c")
def file_saturating_count_index(spark, sf_dir) -> DataFrame:
    return build.saturating_count_index(_fastq(spark, sf_dir), 9, 7, model="canonical", spark=spark).rows.select("kmer", F.col("value").alias("count"))


@query(f"WITH {kmers_sql(11)} SELECT DISTINCT {canonical_sql('kmer')} AS kmer FROM k")
def file_kmer_index(spark, sf_dir) -> DataFrame:
    return build.kmer_index(_fasta(spark, sf_dir, 60), 11, model="canonical", spark=spark).rows.select("kmer")


_ASKED = "b AS (SELECT upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', 'A', 'g')) AS s FROM benchmark), q0 AS (SELECT DISTINCT substr(s, j, 12) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 10)) AS j FROM b))"


def _asked(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.coalesce("text", F.lit("")).alias("seq"))
    return generate.count_packed(q, 12).select("kmer")


def _named(found: DataFrame, position: str, *more) -> DataFrame:
    """Positions with the names of their records."""
    return found.select("kmer", F.col("name").cast("long").alias("doc_id"), F.col(f"{position}.offset").alias("pos"), *more)


@query(f"WITH {kmers_sql(12)}, {_ASKED} SELECT kmer, doc_id, pos::BIGINT AS pos FROM q0 JOIN k USING (kmer)")
def file_position_index(spark, sf_dir) -> DataFrame:
    """The benchmark's k-mers, asked of a multimap of positions in a FASTQ file."""
    return _named(build.position_index(_reads(spark, sf_dir), 12, more=("name",)).find(_asked(spark, sf_dir)), "value")


@query(
    f"WITH {kmers_sql(12)}, {_ASKED}, m AS (SELECT k.kmer, k.doc_id, pos, s FROM q0 JOIN k USING (kmer) JOIN d USING (doc_id)), q AS (SELECT kmer, doc_id, pos, list_transform(range(pos, pos + 12), lambda i: ((7 * i + ascii(substr(s, (i + 1)::INT, 1))) % 41)::INT) AS q FROM m) "
    "SELECT kmer, doc_id, pos::BIGINT AS pos, round(CASE WHEN list_min(q) < 1 THEN 0.0 ELSE pow(2, list_sum(list_transform(q, lambda x: CASE WHEN x < 1 THEN 0.0 ELSE log2(1 - pow(10, -x / 10.0)) END))) END, 6) AS quality FROM q"
)
def file_position_quality_index(spark, sf_dir) -> DataFrame:
    found = build.position_quality_index(_reads(spark, sf_dir), 12, more=("name",)).find(_asked(spark, sf_dir))
    rounded = F.floor(F.col("value.quality") * 1e6 + 0.5) / 1e6  # F.round() makes a BigDecimal of each
    return _named(found, "value.position", rounded.alias("quality"))


@query("SELECT doc_id, length(coalesce(text, ''))::BIGINT AS size FROM documents")
def all_records(spark, sf_dir) -> DataFrame:
    """The filter that lets everything pass."""
    return filters.where(raw_texts(spark, sf_dir)).select("doc_id", F.char_length("seq").cast("long").alias("size"))


@query("SELECT n_nationkey AS record, 40 AS size, true AS in_alphabet, 40 AS scores, true AS in_codec FROM nation")
def random_reads(spark, sf_dir) -> DataFrame:
    """A record for each nation: 40 random letters and scores, all of the alphabet and the codec."""
    rows = random.random_reads(spark, table(spark, sf_dir, "nation").count(), 40, 7)
    odd = "".join(f"\\x{ord(c):02x}" for c in map(chr, range(ILLUMINA18.first, ILLUMINA18.last + 1)))
    return rows.select(F.col("record_start").alias("record"), F.char_length("seq").alias("size"), F.col("seq").rlike(f"^[{DNA.symbols}]*$").alias("in_alphabet"), F.char_length("qual").alias("scores"), F.col("qual").rlike(f"^[{odd}]*$").alias("in_codec"))


# Edges of a graph from the files' reads.
_CODE = "CASE {x} WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 ELSE 0 END"


def _edge_rows(k: int) -> str:
    """e: (doc_id, pos, kmer, l, r, edges): each window with its neighbours and their codes in one byte."""
    return f"""{sequences_sql()}, w AS (SELECT doc_id, s, i - 1 AS pos, substr(s, i, {k}) AS kmer, CASE WHEN i > 1 THEN substr(s, i - 1, 1) ELSE '' END AS l, substr(s, i + {k}, 1) AS r FROM (SELECT doc_id, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM d)),
e AS (SELECT doc_id, s, pos, kmer, l, r, ({_CODE.format(x='l')}) * 16 + ({_CODE.format(x='r')}) AS edges FROM w)"""


def _turned(k: int) -> str:
    """o: the rows of e on the lesser strand."""
    rc = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
    other = "translate({x}, 'ACGT', 'TGCA')"
    return f"{_edge_rows(k)}, o AS (SELECT least(kmer, {rc}) AS kmer, CASE WHEN kmer <= {rc} THEN edges ELSE ({_CODE.format(x=other.format(x='r'))}) * 16 + ({_CODE.format(x=other.format(x='l'))}) END AS edges, s, pos FROM e)"


@query(f"WITH {_edge_rows(6)} SELECT kmer, edges::INT AS edges, count(*) AS count FROM e GROUP BY 1, 2")
def dbg_edge_tuples(spark, sf_dir) -> DataFrame:
    """Windows with their neighbours' codes in one byte."""
    return graph.edge_tuples(sequences(spark, sf_dir), 6).groupBy("kmer", "edges").agg(F.count("*").alias("count"))


@query(f"WITH {_turned(6)} SELECT kmer, edges::INT AS edges, count(*) AS count FROM o GROUP BY 1, 2")
def dbg_oriented_tuples(spark, sf_dir) -> DataFrame:
    """The same on the lesser strand: edges turn with their k-mer."""
    return graph.oriented(graph.edge_tuples(sequences(spark, sf_dir), 6)).groupBy("kmer", "edges").agg(F.count("*").alias("count"))


@query(f"WITH {_turned(8)} SELECT kmer, bit_or(edges)::INT AS mask FROM o GROUP BY kmer")
def dbg_mask_nodes(spark, sf_dir) -> DataFrame:
    return graph.mask_nodes(graph.edge_tuples(sequences(spark, sf_dir), 8))


_SIDES = ", ".join(f"count(*) FILTER ((edges >> {i}) & 1 = 1) AS {c}" for i, c in enumerate((*graph.OUT, *graph.IN)))


@query(f"WITH {_turned(33)} SELECT kmer, {_SIDES}, count(*) AS self FROM o GROUP BY kmer HAVING count(*) > 1")
def dbg_engine_33(spark, sf_dir) -> DataFrame:
    """The engine beyond packed k; nodes that occur more than once."""
    return graph.engine(raw_texts(spark, sf_dir), 33).where("self > 1")


@query(
    f"WITH {_turned(5)}, b AS (SELECT doc_id, i - 1 AS pos, ((7 * (i - 1) + ascii(substr(s, i, 1))) % 41)::INT AS q FROM (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM d)), "
    "l AS (SELECT doc_id, pos, sum(CASE WHEN q >= 1 THEN log2(1 - pow(10, -q / 10.0)) ELSE 0 END) OVER x AS lg, sum((q < 1)::INT) OVER x AS bad FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), "
    "t AS (SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, CASE WHEN bad > 0 THEN 0.0 ELSE pow(2, lg) END AS quality, doc_id, e.pos, kmer AS own, edges FROM e JOIN l USING (doc_id, pos)), "
    f"u AS (SELECT t.kmer, quality, CASE WHEN own = t.kmer THEN edges ELSE (({_CODE.format(x=chr(39) + chr(39))}) + list_sum(list_transform(range(0, 8), lambda i: CASE WHEN (edges >> i) & 1 = 1 THEN 1 << (7 - i)::INT ELSE 0 END))) END::BIGINT AS edges FROM t) "
    f"SELECT kmer, {_SIDES}, count(*) AS self, round(max(quality), 6) AS quality FROM u WHERE quality >= 0.2 GROUP BY kmer"
)
def dbg_quality_engine(spark, sf_dir) -> DataFrame:
    """Nodes of the windows whose quality is at least 0.2."""
    nodes = graph.quality_engine(with_quality(sequences(spark, sf_dir)), 5, least=0.2)
    return nodes.withColumn("quality", F.round("quality", 6))


_N = f"WITH {_turned(7)}, n AS (SELECT kmer, {_SIDES} FROM o GROUP BY kmer), a AS (" + " UNION ALL ".join([f"SELECT kmer, substr(kmer, 2) || '{b}' AS neighbour, out_{b.lower()} AS frequency FROM n" for b in "ACGT"] + [f"SELECT kmer, '{b}' || left(kmer, 6), in_{b.lower()} FROM n" for b in "ACGT"]) + f"), c AS (SELECT *, {canonical_sql('neighbour')} AS node FROM a WHERE frequency > 0)"


@query(_N + " SELECT kmer, neighbour, frequency, node FROM c WHERE node IN (SELECT kmer FROM n)")
def dbg_adjacency(spark, sf_dir) -> DataFrame:
    return graph.adjacency(graph.engine(raw_texts(spark, sf_dir), 7), 7)
