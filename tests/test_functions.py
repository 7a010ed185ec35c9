"""Scalar functions, generators and combinators against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import ids, kmer as km
from kmerloom.functions.alphabet import ALPHABETS, DNA, DNA6, DNA16, DNA_IUPAC, RNA
from kmerloom.functions.quality import ILLUMINA13, ILLUMINA15, ILLUMINA18, window_quality
from kmerloom.operators import aggregate, generate, graph, ranges, streams
from kmerloom.sources.random import random_reads, random_records
from kmerloom.operators.index import Index, bimolecule_counts, bimolecule_map, strand


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_unknown_characters(spark):
    got = one(spark, *[a.normalise(F.lit("acgtuNn.-Xr?é")).alias(n) for n, a in ALPHABETS.items()])
    assert got.DNA == "ACGTAAAAAAAAA" and got.RNA == "ACGAUAAAAAAAA"
    assert got.DNA6 == "ACGT?NN..N???" and got.RNA6 == "ACG?UNN..N???"
    assert got.DNA16 == "ACGTTNN..NRNN" and got.DNA_IUPAC == "ACGTUNNNNNRNN"
    assert [a.bits for a in ALPHABETS.values()] == [2, 2, 3, 3, 4, 4]


def test_complements(spark):
    got = one(spark, DNA.reverse_complement(F.lit("AACGT")).alias("d"), RNA.reverse_complement(F.lit("AACGU")).alias("r"), DNA6.complement_of(F.lit(".ACTGN")).alias("x"), DNA16.complement_of(F.lit(".ACMGRSVTWYHKDBN")).alias("y"), DNA_IUPAC.complement_of(F.lit("UAT")).alias("z"))
    assert tuple(got) == ("ACGTT", "ACGUU", ".TGACN", ".TGKCYSBAWRDMHVN", "ATA")


def test_order_is_by_code(spark):
    got = one(spark, DNA6.canonical(F.lit("T")).alias("t"), DNA6.canonical(F.lit("G")).alias("g"), km.compare(F.lit("T"), F.lit("G"), DNA6).alias("c"), km.compare(F.lit("T"), F.lit("G"), DNA).alias("d"))
    assert tuple(got) == ("A", "C", -1, 1)


def test_packing(spark):
    rng = random.Random(0)
    for a, k in ((DNA, 31), (DNA6, 20), (DNA16, 15)):
        letters = [c for c in a.symbols if c != "?"]
        s = ["".join(rng.choice(letters) for _ in range(k)) for _ in range(50)]
        df = spark.createDataFrame([(x,) for x in s], "s string").withColumn("c", a.pack(F.col("s"))).withColumn("u", a.unpack(F.col("c"), k))
        for r in df.collect():
            want = 0
            for ch in r.s:
                want = (want << a.bits) | a.symbols.index(ch)
            assert r.c == want and r.u == r.s


def test_masks_codes_and_places(spark):
    a, b = DNA.pack(F.lit("ACGT")), DNA.pack(F.lit("ACGA"))
    got = one(spark, km.masked_equal(a, b, 0b11111100).alias("m"), km.masked_equal(a, b, 3).alias("n"), km.codes(F.lit("ACGT"), DNA).alias("c"), km.place(F.lit("ACGT"), 7).alias("p"), km.from_string(F.lit("ACGTT"), 3).alias("f"))
    assert got.m and not got.n and got.c == "0 1 2 3" and 0 <= got.p < 7 and got.f == "ACG"


@pytest.mark.parametrize("codec", [ILLUMINA18, ILLUMINA13, ILLUMINA15])
def test_quality_codecs(spark, codec):
    rows = spark.range(33, 127).select(F.col("id"), F.char("id").alias("c")).withColumn("x", codec.decode(F.col("c"))).withColumn("back", codec.encode(F.col("x")))
    for r in rows.collect():
        q = r.id - codec.first
        if q < max(codec.least, 1):
            assert r.x is None
        else:
            assert math.isclose(r.x, math.log2(1 - 10 ** (-q / 10)), rel_tol=1e-12) and r.back == r.c


def test_window_quality(spark):
    got = one(spark, window_quality(F.lit("I5")).alias("a"), window_quality(F.lit("I!")).alias("b"))
    assert math.isclose(got.a, (1 - 10**-4) * (1 - 10**-2), rel_tol=1e-12) and got.b == 0


def test_ids(spark):
    got = one(spark, ids.unpack_short(ids.pack_short(F.lit(3), F.lit(2**39), F.lit(65535))).alias("s"), ids.unpack_long(ids.pack_long(F.lit(1), F.lit(9), F.lit(77))).alias("l"))
    assert tuple(got.s) == (3, 2**39, 65535) and tuple(got.l) == (1, 9, 77)
    with pytest.raises(Exception, match="16 bits"):
        one(spark, ids.pack_short(F.lit(0), F.lit(0), F.lit(65536)))


def test_kmers_of_short_and_long_records(spark):
    rng = random.Random(3)
    texts = ["", "AC", "ACG", "ACGT", "".join(rng.choice("ACGT") for _ in range(1000)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    want = sorted((i, p, t[p : p + 3]) for i, t in enumerate(texts) if t for p in range(len(t) - 2))
    assert sorted(map(tuple, generate.kmers(df, 3, keep=("id",)).collect())) == want
    assert generate.kmer_counts_of_one(df, 3).count() == len(want)
    edges = generate.kmers_with_edges(df, 3, keep=("id",)).collect()
    assert sorted((r.id, r.pos, r.kmer, r.left, r.right) for r in edges) == sorted((i, p, k, texts[i][p - 1 : p] if p else "", texts[i][p + 3 : p + 4]) for i, p, k in want)
    for k, model in ((3, "single"), (5, "canonical"), (31, "canonical")):
        plain = generate.kmers(df, k)
        plain = plain.select((DNA.canonical(F.col("kmer")) if model == "canonical" else F.col("kmer")).alias("kmer")).groupBy("kmer").count()
        assert sorted(map(tuple, generate.count_packed(df, k, model).collect())) == sorted(map(tuple, plain.collect()))
    with pytest.raises(ValueError):
        generate.count_packed(df, 32)
    rows = generate.kmers(df, 5, keep=("id",))
    order = F.struct("id", "pos")
    both = generate.bimolecule_packed(df, 5, "id")
    assert sorted(map(tuple, bimolecule_counts(rows, order=order).collect())) == sorted((r.kmer, r["count"]) for r in both.collect())
    assert sorted(map(tuple, bimolecule_map(rows, "id", order).collect())) == sorted((r.kmer, r.id) for r in both.collect())


def test_kmer_qualities_match_the_column_form(spark):
    df = spark.createDataFrame([(1, "ACGTACG", "I5!I5II"), (2, "AC", "II"), (3, "ACGTT", "IIII"), (4, None, None), (5, "aé日c", "5555")], "id int, seq string, qual string")
    rows = generate.kmers_with_quality(df, 3, keep=("id",)).collect()
    assert [(r.id, r.pos, r.kmer) for r in rows] == [(1, i, "ACGTACG"[i : i + 3]) for i in range(5)] + [(3, 0, "ACG"), (3, 1, "CGT"), (5, 0, "aé日"), (5, 1, "é日c")]
    quals = {1: "I5!I5II", 3: "IIII", 5: "5555"}
    want = spark.createDataFrame([(i, quals[r.id][r.pos : r.pos + 3]) for i, r in enumerate(rows)], "i int, q string").select("i", window_quality(F.col("q")).alias("x")).orderBy("i").collect()
    assert all(math.isclose(a.quality, b.x, rel_tol=1e-12) for a, b in zip(rows, want))


def test_edges_turn_with_the_strand(spark):
    df = spark.createDataFrame([(0, "TTCGA"), (1, "TCGAA")], "id int, seq string")
    nodes = {r.kmer: r for r in graph.count_nodes(graph.edge_tuples(df, 3)).collect()}
    assert nodes["CGA"].self == 4 and nodes["GAA"].self == 2
    assert nodes["GAA"].in_c == 2 and nodes["CGA"].out_a == 2 and nodes["CGA"].in_t == 4
    for k in (1, 3, 4):
        slow, fast = graph.edge_tuples(df, k), graph.count_nodes_packed(df, k)
        assert sorted(map(tuple, graph.count_nodes(slow).collect())) == sorted(map(tuple, fast.collect()))
        assert sorted(map(tuple, graph.mask_nodes(slow).collect())) == sorted(map(tuple, graph.counts_to_masks(fast).collect()))
        assert sorted(map(tuple, graph.count_nodes(slow, 2).collect())) == sorted(map(tuple, graph.count_nodes_packed(df, k, most=2).collect()))
    masks = graph.mask_to_nodes(graph.mask_nodes(graph.edge_tuples(df, 3)))
    assert sorted(r.neighbour for r in graph.out_neighbours(masks).where("kmer = 'CGA'").collect()) == ["GAA"]
    e = one(spark, graph.edge_code(F.lit("A"), F.lit("N")).alias("a"), graph.edge_code(F.lit(""), F.lit("")).alias("b"), graph.reverse_complement_edges(graph.edge_code(F.lit("A"), F.lit("C"))).alias("c"), graph.edge_code(F.lit("G"), F.lit("T")).alias("d"))
    assert e.a == 31 and e.b == 0 and e.c == e.d


def test_indices(spark):
    df = spark.createDataFrame([("ACG", 1), ("CGT", 2), ("AAA", 3)], "kmer string, value int")
    i = Index.build(df, ["kmer"], kind="counting", transform=strand("canonical"), value="n")
    assert {r.kmer: r.n for r in i.rows.collect()} == {"ACG": 2, "AAA": 1}
    assert i.count(spark.createDataFrame([("CGT",), ("CCC",), ("CCC",)], "kmer string")).collect().__len__() == 2
    assert i.erase_scan().rows.count() == 0 and i.keys_only().count() == 2
    assert {r.kmer: r.n for r in i.insert(df.select("kmer")).rows.collect()} == {"ACG": 4, "AAA": 2}
    with pytest.raises(ValueError):
        Index.build(df, ["kmer"], kind="other")
    empty = Index.build(df.limit(0), ["kmer"]).sizes().first()
    assert (empty.size, empty.unique_size, empty.multiplicity, empty.is_empty) == (0, 0, None, True)


def test_streams_and_ranges(spark):
    df = spark.range(10).withColumn("key", F.lit(1))
    assert [r.t for r in streams.sliding(df, ["key"], ["id"], 4, t=F.sum("id")).orderBy("id").collect()] == [6, 10, 14, 18, 22, 26, 30]
    assert sorted(r.s for r in streams.many_to_one(df, ["key"], "id", 4, F.sum("id").alias("s")).collect()) == [6, 17, 22]
    assert ranges.blocks(10, 3) == [(0, 4), (4, 7), (7, 10)]
    got = one(spark, ranges.hull(F.lit(1), F.lit(3), F.lit(5), F.lit(6)).alias("h"), ranges.overlaps(F.lit(1), F.lit(3), F.lit(3), F.lit(4)).alias("o"), ranges.adjacent(F.lit(1), F.lit(3), F.lit(3), F.lit(4)).alias("a"), ranges.contains(F.lit(1), F.lit(9), F.lit(3), F.lit(4)).alias("c"), ranges.shifted(F.lit(1), F.lit(2), F.lit(5)).alias("s"), ranges.intersection(F.lit(1), F.lit(2), F.lit(2), F.lit(3)).alias("i"))
    assert tuple(got.h) == (1, 6) and not got.o and got.a and got.c and tuple(got.s) == (6, 7) and got.i is None
    assert aggregate.rebalanced(df, 3).rdd.getNumPartitions() == 3 and aggregate.sampled(df, 1.0, 1).count() == 10


def test_bits_and_wide_packing(spark):
    got = one(spark, km.bit_and(F.lit(12), F.lit(10)).alias("a"), km.bit_or(F.lit(12), F.lit(10)).alias("o"), km.bit_xor(F.lit(12), F.lit(10)).alias("x"), km.shift_bits(F.lit(3), 2).alias("l"), km.shift_bits(F.lit(12), -2).alias("r"), km.from_hex(F.lit("1B")).alias("h"))
    assert tuple(got) == (8, 14, 6, 12, 3, 27)
    rng = random.Random(8)
    s = ["".join(rng.choice("ACGTN") for _ in range(41)) for _ in range(60)]
    rows = spark.createDataFrame([(x,) for x in s], "s string").withColumn("p", km.pack_wide(F.col("s"), DNA6)).withColumn("u", km.unpack_wide(F.col("p"), 41, DNA6)).collect()
    code = {c: i for i, c in enumerate(".A?CT?GN") if c != "?"}
    assert all(r.u == r.s for r in rows)
    assert sorted(rows, key=lambda r: bytes(r.p)) == sorted(rows, key=lambda r: [code[c] for c in r.s])


def test_random_records(spark):
    a, b = (random_records(spark, 50, 40, seed=2).collect() for _ in range(2))
    assert a == b and len({r.seq for r in a}) == 50 and set("".join(r.seq for r in a)) == set("ACGT") and {len(r.seq) for r in a} == {40}
    r = random_reads(spark, 5, 10).first()
    assert len(r.qual) == 10 and all(33 <= ord(c) <= 126 for c in r.qual)


def test_murmur3_known_values(spark):
    from kmerloom.functions import hashing

    low, high = hashing.murmur3_of([b"hello", b"", b"The quick brown fox jumps over the lazy dog"], 0)
    assert (int(low[0]), int(high[0])) == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert (int(low[1]), int(high[1])) == (0, 0)
    assert (int(low[2]), int(high[2])) == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)
    df = spark.createDataFrame([("hello",), ("ACGT" * 8,), ("",)], "k string")
    got = df.select("k", hashing.murmur3("k", 1, 0).alias("h"), hashing.murmur_place("k", 7).alias("p")).collect()
    for r in got:
        words = hashing.murmur3_of([r.k.encode()], 0)
        assert r.h % 2**64 == int(words[1][0]) and r.p == int(hashing.murmur3_of([r.k.encode()])[1][0]) % 7
