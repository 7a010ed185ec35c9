"""FASTQ and FASTA: counts that are known beforehand, whatever the splits; records equal the bytes they came from."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions.alphabet import DNA5
from kmerloom.operators import filters, generate
from kmerloom.sources import seqfiles


def fastq(rng, n, size, with_n=0):
    out, reads = [], []
    for i in range(n):
        s = "".join(rng.choice("ACGTacgt") for _ in range(size + i % 3))
        if i < with_n:
            s = s[: size // 2] + "N" + s[size // 2 + 1 :]
        q = "".join(rng.choice("@+>;IHGF5!") for _ in s)
        reads.append((f"read{i} x", s, q))
        out.append(f"@read{i} x\n{s}\n+\n{q}\n")
    return "".join(out), reads


@pytest.mark.parametrize("split", [17, 200, 1 << 20])
def test_fastq_any_split(spark, tmp_path, split):
    text, reads = fastq(random.Random(1), 60, 50)
    path = tmp_path / "a.FastQ"
    path.write_text(text)
    df = seqfiles.read(spark, str(path), split)
    rows = sorted(df.collect(), key=lambda r: r.record_start)
    assert [(r.name, r.seq, r.qual) for r in rows] == reads
    for r in rows:
        body = text[r.record_start : r.record_start + r.record_size]
        assert body[0] == "@" and body.endswith(r.qual) and body[r.seq_begin_offset :].startswith(r.seq)
    n = sum(max(len(s) - 34, 0) for _, s, _ in reads)
    assert generate.kmers(df.withColumn("seq", DNA5.normalise(F.col("seq"))), 35).count() == n


def test_fastq_n_filter_and_split(spark, tmp_path):
    text, reads = fastq(random.Random(2), 30, 60, with_n=8)
    (tmp_path / "b.fq").write_text(text.replace("\n", "\r\n"))
    df = seqfiles.read(spark, str(tmp_path / "b.fq"), 333)
    assert df.count() == 30 and filters.without_n(df).count() == 22
    pieces = filters.split_on(df, qual="qual").collect()
    assert len(pieces) == 38
    for p in pieces:
        seq, qual = next((s, q) for n, s, q in reads if n == p.name)
        assert seq[p.offset :].startswith(p.seq) and qual[p.offset : p.offset + len(p.seq)] == p.qual


@pytest.mark.parametrize("bad", ["read\nAC\n+\nII\n", "@r\nAC\nII\n@r\n", "@r\nACG\n+\nII\n"])
def test_fastq_errors(spark, tmp_path, bad):
    (tmp_path / "bad.fastq").write_text(bad)
    with pytest.raises(Exception, match="byte"):
        seqfiles.read(spark, str(tmp_path / "bad.fastq")).collect()


def test_fastq_empty_sequence_is_kept(spark, tmp_path):
    (tmp_path / "e.fastq").write_text("@a\n\n+\n\n@b\nAC\n+\n@I\n")
    rows = seqfiles.read(spark, str(tmp_path / "e.fastq")).orderBy("record_start").collect()
    assert [(r.name, r.seq, r.qual) for r in rows] == [("a", "", ""), ("b", "AC", "@I")]


FASTA = "junk before\n>one\nACGTAC\nGTTT\n\n;two\n;more of two\nACG\n>three\n>still three\nAAAA\r\nCC\r\n>empty\n"


@pytest.mark.parametrize("split", [1, 3, 7, 20, 1000])
def test_fasta_any_split(spark, tmp_path, split):
    (tmp_path / "a.fasta").write_bytes(FASTA.encode())
    df = seqfiles.read(spark, str(tmp_path / "a.fasta"), split)
    rows = seqfiles.with_numbers(df).orderBy("seq_index").collect()
    assert [(r.seq_index, r.name, r.seq) for r in rows] == [(0, "one", "ACGTACGTTT"), (1, "two more of two", "ACG"), (2, "three still three", "AAAACC"), (3, "empty", "")]
    for r in rows:
        assert FASTA[r.record_start] in ">;"
    bases = df.where("seq <> ''").select("record_start", "seq", "lines", F.explode(F.sequence(F.lit(0), F.char_length("seq") - 1)).alias("pos"))
    for r in bases.withColumn("byte", F.col("record_start") + seqfiles.byte_of(F.col("pos"), F.col("lines"))).collect():
        assert FASTA[r.byte] == r.seq[r.pos]


def test_folders_endings_and_sizes(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.fa").write_text(f">r{i}\nACGT\n")
    (tmp_path / "notes.txt").write_text("no")
    df = seqfiles.read(spark, str(tmp_path))
    assert sorted((r.file_id, r.name) for r in df.collect()) == [(0, "r0"), (1, "r1"), (2, "r2")]
    assert seqfiles.record_size_estimate(df).first().seq_size == 4
    with pytest.raises(ValueError):
        seqfiles.format_of("reads.txt")
    with pytest.raises(FileNotFoundError):
        seqfiles.read(spark, str(tmp_path / "none.fa"))


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.record_start, r.base)):
        got = out.setdefault(r.record_start, [r.name, ""])
        assert r.base == len(got[1])
        got[1] += r.seq[: r.valid]
    return list(map(tuple, out.values()))


@pytest.mark.parametrize("split", [1, 2, 5, 9, 23, 1000])
def test_fasta_pieces_any_split(spark, tmp_path, split):
    (tmp_path / "a.fasta").write_bytes(FASTA.encode())
    rows = seqfiles.read_fasta_pieces(spark, str(tmp_path / "a.fasta"), 3, split).collect()
    records = [("one", "ACGTACGTTT"), ("two more of two", "ACG"), ("three still three", "AAAACC")]
    assert whole(rows) == records
    for r in rows:
        seq = dict(records)[r.name]
        assert r.seq == seq[r.base : r.base + r.valid + 3] or r.seq == seq[r.base : r.base + r.valid] and split > 5


def test_one_long_line_is_read_by_many_tasks(spark, tmp_path):
    seq = "".join(random.Random(3).choice("ACGT") for _ in range(300_000))
    (tmp_path / "long.fa").write_text(f">chr\n{seq}\n>next\nACGT\n")
    df = seqfiles.read_fasta_pieces(spark, str(tmp_path / "long.fa"), 20, 10_000)
    rows = df.collect()
    assert whole(rows) == [("chr", seq), ("next", "ACGT")] and max(len(r.seq) for r in rows) <= 10_020 and len(rows) > 29
    assert generate.kmers(df, 21, keep=("base",)).count() == 300_000 - 20


def test_written_files_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGTACGT", "IIIIIIII"), ("b", "", ""), ("c", "A", "#")], "name string, seq string, qual string")
    rows = seqfiles.read(spark, seqfiles.write_fastq(df, str(tmp_path / "q"))).collect()
    assert sorted((r.name, r.seq, r.qual) for r in rows) == [("a", "ACGTACGT", "IIIIIIII"), ("b", "", ""), ("c", "A", "#")]
    rows = seqfiles.read(spark, seqfiles.write_fasta(df, str(tmp_path / "f"), 3)).collect()
    assert sorted((r.name, r.seq, len(r.lines)) for r in rows) == [("a", "ACGTACGT", 3), ("b", "", 0), ("c", "A", 1)]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        seqfiles.read(spark, str(tmp_path / "none"))
