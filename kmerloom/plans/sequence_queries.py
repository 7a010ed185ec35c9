"""Queries on sequences: generation, strands, positions, qualities, splits, graphs, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, kmer as km
from ..functions.hashing import murmur3
from ..functions.alphabet import ALPHABETS, DNA, DNA6, DNA16, RNA
from ..functions.quality import ILLUMINA15, ILLUMINA18
from ..operators import filters, generate, graph
from ..operators.aggregate import saturated, sizes
from .common import TEXT, canonical_sql, kmers_sql, raw_texts, rc_sql, registered, sequences, sequences_sql

QUERIES: dict = {}
query = registered(QUERIES)


@query(f"WITH {kmers_sql(5)} SELECT kmer, count(*) AS count FROM k GROUP BY kmer")
def kmer_count_single(spark, sf_dir) -> DataFrame:
    return generate.count_packed(raw_texts(spark, sf_dir), 5)


@query(f"WITH {kmers_sql(5)} SELECT {canonical_sql('kmer')} AS kmer, count(*) AS count FROM k GROUP BY 1")
def kmer_count_canonical(spark, sf_dir) -> DataFrame:
    return generate.count_packed(raw_texts(spark, sf_dir), 5, "canonical")


@query(f"WITH {kmers_sql(21)} SELECT {canonical_sql('kmer')} AS kmer, count(*) AS count FROM k GROUP BY 1")
def kmer_count_canonical_21(spark, sf_dir) -> DataFrame:
    return generate.count_packed(raw_texts(spark, sf_dir), 21, "canonical")


@query(f"WITH {kmers_sql(31)} SELECT {canonical_sql('kmer')} AS kmer, count(*) AS count FROM k GROUP BY 1")
def kmer_count_canonical_31(spark, sf_dir) -> DataFrame:
    return generate.count_packed(raw_texts(spark, sf_dir), 31, "canonical")


@query(f"WITH {kmers_sql(7)}, o AS (SELECT kmer, doc_id, pos, {canonical_sql('kmer')} AS c FROM k) SELECT arg_min(kmer, (doc_id, pos)) AS kmer, count(*) AS count FROM o GROUP BY c")
def kmer_count_bimolecule(spark, sf_dir) -> DataFrame:
    return generate.bimolecule_packed(raw_texts(spark, sf_dir), 7, "doc_id").select("kmer", "count")


@query(f"WITH {kmers_sql(6, RNA)} SELECT kmer, count(*) AS count FROM k GROUP BY kmer")
def kmer_count_rna(spark, sf_dir) -> DataFrame:
    return generate.count_packed(raw_texts(spark, sf_dir), 6, "single", RNA)


@query(f"WITH {kmers_sql(63)} SELECT kmer, count(*) AS count FROM k GROUP BY kmer")
def kmer_count_63(spark, sf_dir) -> DataFrame:
    """All counts, those of 1 too; windows are shuffled as runs of neighbours."""
    return generate.count_runs(raw_texts(spark, sf_dir), 63)


@query(f"WITH {kmers_sql(62)} SELECT kmer, count(*) AS count FROM k GROUP BY kmer")
def kmer_count_62(spark, sf_dir) -> DataFrame:
    """Packed in two numbers."""
    return generate.count_wide(raw_texts(spark, sf_dir), 62)


@query(f"WITH {kmers_sql(63)} SELECT kmer, count(*) AS count FROM k GROUP BY kmer HAVING count(*) > 1")
def kmer_repeated_63(spark, sf_dir) -> DataFrame:
    return generate.count_runs(raw_texts(spark, sf_dir), 63, least=2)


def _wide_canonical(alphabet, digits: str) -> str:
    s = alphabet._unique()
    rc = f"reverse(translate(kmer, '{s}', '{''.join(s[i] for i in alphabet.complement)}'))"
    key = lambda x: f"translate({x}, '{s}', '{digits}')"
    return f"CASE WHEN {key('kmer')} <= {key(rc)} THEN kmer ELSE {rc} END"


@query(f"WITH {kmers_sql(4, DNA6)} SELECT {_wide_canonical(DNA6, '01234567')} AS kmer, count(*) AS count FROM k GROUP BY 1")
def kmer_count_dna6(spark, sf_dir) -> DataFrame:
    rows = generate.kmers(sequences(spark, sf_dir, DNA6), 4)
    return rows.groupBy(DNA6.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("count"))


@query(f"WITH {kmers_sql(3, DNA16)} SELECT {_wide_canonical(DNA16, '0123456789ABCDEF')} AS kmer, count(*) AS count FROM k GROUP BY 1")
def kmer_count_dna16(spark, sf_dir) -> DataFrame:
    rows = generate.kmers(sequences(spark, sf_dir, DNA16), 3)
    return rows.groupBy(DNA16.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("count"))


_SYMBOLS = " UNION ALL ".join(
    f"SELECT '{n}' AS alphabet, c AS symbol, count(*) AS count FROM (SELECT unnest(string_split({a.normalise_sql(TEXT)}, '')) AS c FROM documents) WHERE c <> '' GROUP BY c" for n, a in ALPHABETS.items()
)


@query(_SYMBOLS)
def alphabet_symbols(spark, sf_dir) -> DataFrame:
    """How often each alphabet reads each of its symbols."""
    texts = raw_texts(spark, sf_dir)
    chars = texts.select(F.explode(F.split("seq", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    parts = [chars.groupBy(F.lit(n).alias("alphabet"), a.normalise(F.col("c")).alias("symbol")).agg(F.sum("n").alias("count")) for n, a in ALPHABETS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {kmers_sql(9)} SELECT kmer, count(*) AS count, min(pos) AS first_pos, max(pos) AS last_pos, sum(pos)::BIGINT AS sum_pos FROM k GROUP BY kmer")
def kmer_positions(spark, sf_dir) -> DataFrame:
    return generate.position_sums(raw_texts(spark, sf_dir), 9)


@query(f"WITH {kmers_sql(13)} SELECT kmer, doc_id, pos::BIGINT AS pos FROM k WHERE kmer IN (SELECT kmer FROM k GROUP BY kmer HAVING count(*) BETWEEN 2 AND 5)")
def kmer_position_tuples(spark, sf_dir) -> DataFrame:
    """Tuples of k-mer and position; those of k-mers that occur two to five times."""
    records = sequences(spark, sf_dir).withColumn("file_id", F.lit(0)).withColumnRenamed("doc_id", "record_start")
    rows = generate.kmer_positions(records, 13)
    some = rows.groupBy("kmer").agg(F.count("*").alias("n")).where("n between 2 and 5").select("kmer")
    return rows.join(some, "kmer").select("kmer", F.col("position.record_start").alias("doc_id"), F.col("position.offset").alias("pos"))


@query(f"WITH {kmers_sql(12)} SELECT doc_id, pos, kmer FROM k WHERE kmer LIKE 'GATT%'")
def kmer_position_index_find(spark, sf_dir) -> DataFrame:
    return generate.kmers_with_prefix(sequences(spark, sf_dir), 12, "GATT", keep=("doc_id",))


# Phred characters made from the text: place and base give a score from 0 to 40.
_Q_SQL = "chr(33 + ((7 * (i - 1) + ascii(substr(s, i, 1))) % 41)::INT)"


def _with_quality(records: DataFrame, first: int = 33) -> DataFrame:
    chars = F.transform(F.split("seq", ""), lambda c, i: F.char((F.lit(7) * i + F.ascii(c)) % 41 + first))
    return records.where(F.length("seq") > 0).withColumn("qual", F.array_join(chars, ""))


def _quality_sql(k: int, least: int) -> str:
    return f"""WITH {sequences_sql()}, b AS (SELECT doc_id, s, i - 1 AS pos, ((7 * (i - 1) + ascii(substr(s, i, 1))) % 41)::INT AS q FROM (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM d)),
l AS (SELECT doc_id, s, pos, q < {max(least, 1)} AS bad, CASE WHEN q >= {max(least, 1)} THEN log2(1 - pow(10, -q / 10.0)) ELSE 0 END AS lg FROM b),
w AS (SELECT doc_id, pos, substr(s, pos + 1, {k}) AS kmer, sum(lg) OVER x AS lg, sum(bad::INT) OVER x AS bad, count(*) OVER x AS n FROM l WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING))
SELECT kmer, count(*) AS count, round(max(CASE WHEN bad > 0 THEN 0.0 ELSE pow(2, lg) END), 6) AS best, count(*) FILTER (bad > 0) AS unusable FROM w WHERE n = {k} GROUP BY kmer"""


def _quality(spark, sf_dir, k, codec):
    return generate.best_quality(_with_quality(sequences(spark, sf_dir), codec.first), k, codec).withColumn("best", F.round("best", 6))


@query(_quality_sql(6, 0))
def kmer_quality(spark, sf_dir) -> DataFrame:
    return _quality(spark, sf_dir, 6, ILLUMINA18)


@query(_quality_sql(4, 3))
def kmer_quality_illumina15(spark, sf_dir) -> DataFrame:
    return _quality(spark, sf_dir, 4, ILLUMINA15)


@query("SELECT q::INT AS q, chr(33 + q::INT) AS symbol, CASE WHEN q > 0 THEN round(log2(1 - pow(10, -q / 10.0)), 12) END AS log2_p FROM range(0, 94) t(q)")
def quality_codec(spark, sf_dir) -> DataFrame:
    """Every score decoded, and encoded again from that."""
    rows = spark.range(94).select(F.col("id").cast("int").alias("q")).withColumn("c", F.char(F.col("q") + 33))
    rows = rows.withColumn("log2_p", ILLUMINA18.decode(F.col("c")))
    return rows.select("q", ILLUMINA18.encode(F.col("log2_p")).alias("symbol"), F.round("log2_p", 12).alias("log2_p"))


@query("SELECT doc_id, length(coalesce(text, ''))::BIGINT AS size FROM documents WHERE NOT contains(coalesce(text, ''), 'N')")
def nfilter_reads(spark, sf_dir) -> DataFrame:
    return filters.without_n(raw_texts(spark, sf_dir)).select("doc_id", F.char_length("seq").cast("long").alias("size"))


@query(
    "WITH r AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '([Nn]+|[^Nn]+)') AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS run, generate_subscripts(a, 1) AS i FROM r), "
    "o AS (SELECT doc_id, run, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM u) SELECT doc_id, x AS \"offset\", run AS piece FROM o WHERE NOT regexp_matches(run, '^[Nn]')"
)
def nsplit_reads(spark, sf_dir) -> DataFrame:
    rows = filters.split_on(raw_texts(spark, sf_dir))
    return rows.select("doc_id", "offset", F.col("seq").alias("piece"))


@query(f"WITH {kmers_sql(15)} SELECT doc_id, (pos // 1000)::BIGINT AS block, count(*) AS windows FROM k GROUP BY 1, 2")
def owned_windows(spark, sf_dir) -> DataFrame:
    return filters.owned_windows(sequences(spark, sf_dir), 15, 1000, keep=("doc_id",))


@query("SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\\r\\n]', '', 'g')) AS seq_md5 FROM documents")
def line_end_removal(spark, sf_dir) -> DataFrame:
    return filters.without_line_ends(raw_texts(spark, sf_dir)).select("doc_id", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query(f"WITH {kmers_sql(8)} SELECT reverse(kmer) AS kmer, count(*) AS count FROM k GROUP BY 1")
def kmer_reverse_stream(spark, sf_dir) -> DataFrame:
    rows = generate.count_packed(raw_texts(spark, sf_dir), 8)
    return rows.select(F.reverse("kmer").alias("kmer"), "count")


@query(f"WITH {kmers_sql(8)}, c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT kmer, least(n, 255)::BIGINT AS count FROM c")
def kmer_saturating_count(spark, sf_dir) -> DataFrame:
    return saturated(generate.kmers(sequences(spark, sf_dir), 8), ["kmer"], 255)


@query(f"WITH {kmers_sql(10)} SELECT count(*) AS size, count(DISTINCT kmer) AS unique_size, count(*) / count(DISTINCT kmer)::DOUBLE AS multiplicity, count(*) = 0 AS is_empty FROM k")
def kmer_multiplicity(spark, sf_dir) -> DataFrame:
    return sizes(generate.kmers(sequences(spark, sf_dir), 10), ["kmer"])


@query(f"WITH {kmers_sql(10)} SELECT DISTINCT kmer FROM k")
def kmer_unique(spark, sf_dir) -> DataFrame:
    return generate.count_packed(raw_texts(spark, sf_dir), 10).select("kmer")


@query(f"WITH {kmers_sql(10)} SELECT count(DISTINCT kmer) AS kmers, count(DISTINCT kmer) AS hashes, count(DISTINCT kmer) AS murmurs, 64 AS places, true AS even FROM k")
def kmer_hash_distinct(spark, sf_dir) -> DataFrame:
    """Placement hashes tell all different k-mers apart, fill all of 64 places, and none of these holds twice the mean (of 30 k-mers or more)."""
    rows = generate.count_packed(raw_texts(spark, sf_dir), 10).select("kmer")
    hashed = rows.select("kmer", F.xxhash64("kmer").alias("h"), murmur3("kmer").alias("m"), km.place(F.col("kmer"), 64).alias("p"))
    per = hashed.groupBy("p").agg(F.count("*").alias("n")).agg(F.count("*").cast("int").alias("places"), (F.max("n") < 2 * F.avg("n")).alias("even"))
    sums = hashed.agg(F.count("*").alias("kmers"), F.countDistinct("h").alias("hashes"), F.countDistinct("m").alias("murmurs"))
    return sums.join(F.broadcast(per), F.lit(True))


@query(f"WITH {kmers_sql(10)} SELECT left(kmer, 3) AS part, count(*) AS count FROM k GROUP BY 1")
def kmer_prefix_placement(spark, sf_dir) -> DataFrame:
    rows = generate.count_packed(raw_texts(spark, sf_dir), 10)
    return rows.groupBy(km.place_by_prefix(F.col("kmer"), 3).alias("part")).agg(F.sum("count").alias("count"))


_PACK = "list_sum(list_transform(range(1, 9), lambda i: (strpos('ACGT', substr({x}, i, 1)) - 1) * pow(4, 8 - i)::BIGINT))::BIGINT"


@query(
    f"WITH {kmers_sql(8)}, u AS (SELECT DISTINCT kmer FROM k), p AS (SELECT kmer, {rc_sql('kmer')} AS rc, {_PACK.format(x='kmer')} AS code, {_PACK.format(x=rc_sql('kmer'))} AS rc_code FROM u) "
    "SELECT kmer, rc, code, xor(code, rc_code) AS xor_rc, least(kmer, rc) AS lesser, greatest(kmer, rc) AS greater, kmer AS unpacked, printf('%X', code) AS code_hex, bit_count(code)::INT AS ones FROM p"
)
def scalar_strands(spark, sf_dir) -> DataFrame:
    rows = generate.count_packed(raw_texts(spark, sf_dir), 8).select("kmer")
    x = F.col("kmer")
    code = DNA.pack(x)
    return rows.select("kmer", DNA.reverse_complement(x).alias("rc"), code.alias("code"), km.xor_reverse_complement(x, DNA).alias("xor_rc"), DNA.canonical(x).alias("lesser"), DNA.greater(x).alias("greater"), DNA.unpack(code, 8).alias("unpacked"), km.to_hex(code).alias("code_hex"), F.bit_count(code).alias("ones"))


@query(
    f"WITH {kmers_sql(8)}, u AS (SELECT DISTINCT kmer FROM k), p AS (SELECT kmer, {rc_sql('kmer')} AS rc, {_PACK.format(x='kmer')} AS code FROM u) SELECT kmer, substr(kmer, 2) || 'T' AS appended, 'G' || left(kmer, 7) AS prepended, left(kmer, 3) AS head, substr(kmer, 3, 4) AS middle, right(kmer, 3) AS tail, "
    "substr(kmer, 5, 2) AS at_2, substr(kmer, 1, 5) || 'C' || substr(kmer, 7) AS set_2, ((code << 4) & 65535)::BIGINT AS moved_left, (code >> 4)::BIGINT AS moved_right, CASE WHEN kmer < rc THEN -1 WHEN kmer > rc THEN 1 ELSE 0 END::INT AS compared, "
    "left(kmer, 7) = left(rc, 7) AS same_head, substr(kmer, 2) = substr(rc, 2) AS same_tail FROM p"
)
def scalar_kmers(spark, sf_dir) -> DataFrame:
    rows = generate.count_packed(raw_texts(spark, sf_dir), 8).select("kmer")
    x, rc, code = F.col("kmer"), DNA.reverse_complement(F.col("kmer")), DNA.pack(F.col("kmer"))
    return rows.select(
        "kmer", km.append(x, F.lit("T")).alias("appended"), km.prepend(x, F.lit("G"), 8).alias("prepended"), km.prefix(x, 3).alias("head"), km.infix(x, 4, 2).alias("middle"), km.suffix(x, 3).alias("tail"),
        km.chars_at(x, 8, 2, 2).alias("at_2"), km.set_char_at(x, 8, 2, F.lit("C")).alias("set_2"), km.shift_left(code, 2, 8, DNA).alias("moved_left"), km.shift_right(code, 2, DNA).alias("moved_right"),
        km.compare(x, rc, DNA).alias("compared"), km.same_but_last(x, rc, 8).alias("same_head"), km.same_but_first(x, rc).alias("same_tail"),
    )


@query("SELECT doc_id, (doc_id % 100 << 56) | (doc_id << 16) | (coalesce(n_chars, 0) % 65536) AS short_id, (doc_id % 100 << 56) | (doc_id % 65536 << 40) | coalesce(n_chars, 0) AS long_id, doc_id % 100 AS file_id, doc_id AS record_start, coalesce(n_chars, 0) % 65536 AS \"offset\" FROM documents")
def record_ids(spark, sf_dir) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    file_id = F.col("doc_id") % 100
    rows = rows.withColumn("short_id", ids.pack_short(file_id, F.col("doc_id"), F.col("n") % 65536)).withColumn("long_id", ids.pack_long(file_id, F.col("doc_id") % 65536, F.col("n"))).withColumn("u", ids.unpack_short(F.col("short_id")))
    return rows.select("doc_id", "short_id", "long_id", F.col("u.file_id").cast("long").alias("file_id"), "u.record_start", "u.offset")


@query(
    "WITH r AS (SELECT o_orderkey, ((o_orderkey % 100) << 16) | (o_custkey % 1000) AS id, ((o_orderkey % 100) << 16) | 500 AS other FROM orders) "
    "SELECT o_orderkey, id + (id & 65535) AS further, id + o_orderkey % 7 AS moved, (id & 65535) - 500 AS places, CASE WHEN o_orderkey % 100 = 3 THEN (id & 65535) - 500 END AS from_3 FROM r"
)
def record_id_arithmetic(spark, sf_dir) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 1000).alias("n"), (F.col("o_orderkey") % 100).alias("r"))
    own, other, third = (ids.pack_short(F.lit(0), r, n) for r, n in ((F.col("r"), F.col("n")), (F.col("r"), F.lit(500)), (F.lit(3), F.lit(500))))
    return rows.select("o_orderkey", ids.advanced(own, F.col("n")).alias("further"), ids.advanced(own, F.col("o_orderkey") % 7).alias("moved"), ids.distance(own, other).alias("places"), ids.distance(own, third).alias("from_3"))


@query(
    f"WITH {kmers_sql(8)}, u AS (SELECT DISTINCT kmer FROM k), p AS (SELECT kmer, {_PACK.format(x='kmer')} AS code FROM u) SELECT kmer, left(kmer, 5) AS filled, reverse(left(kmer, 5)) AS filled_back, (code & 13107)::BIGINT AS anded, (code | 13107)::BIGINT AS ored, xor(code, 13107)::BIGINT AS xored, "
    "(code << 3)::BIGINT AS bits_left, (code >> 3)::BIGINT AS bits_right, code AS from_hex, lower(printf('%04X', code)) AS wide, kmer AS unwide, ((code >> 10) & 3)::BIGINT AS third, (((code << 2) & 65535) | 2)::BIGINT AS next_code, (code & 255) = (code & 240) AS same_masked FROM p"
)
def scalar_bits(spark, sf_dir) -> DataFrame:
    """Filling, bitwise functions, raw words, packed sequences and access to their characters."""
    rows = generate.count_packed(raw_texts(spark, sf_dir), 8).select("kmer")
    x, code, m = F.col("kmer"), DNA.pack(F.col("kmer")), F.lit(13107).cast("long")
    wide = F.translate(DNA.order_key(x), "0123", "0123")
    packed = F.unhex(F.lpad(km.to_hex(code), 4, "0"))
    return rows.select(
        "kmer", km.from_string(x, 5).alias("filled"), km.from_string_reversed(x, 5).alias("filled_back"), km.bit_and(code, m).alias("anded"), km.bit_or(code, m).alias("ored"), km.bit_xor(code, m).alias("xored"), km.shift_bits(code, 3).alias("bits_left"),
        km.shift_bits(code, -3).alias("bits_right"), km.from_hex(km.to_hex(code)).alias("from_hex"), F.lower(F.hex(packed)).alias("wide"), km.unpack_wide(km.pack_wide(x, DNA), 8, DNA).alias("unwide"), km.code_at(code, 8, 2, DNA).alias("third"),
        km.next_codes(code, F.lit(2).cast("long"), 8, DNA).alias("next_code"), km.masked_equal(code, code.bitwiseAND(F.lit(240)), 255).alias("same_masked"),
    ).where(wide.isNotNull())


def _edges_sql(k: int) -> str:
    """e: (kmer, l, r) on the lesser strand, where l and r are the neighbours' letters, or nothing."""
    return f"""WITH {kmers_sql(k)}, e0 AS (SELECT k.doc_id, kmer, CASE WHEN pos > 0 THEN substr(s, pos, 1) ELSE '' END AS l, substr(s, pos + {k} + 1, 1) AS r FROM (SELECT doc_id, s, i - 1 AS pos, substr(s, i, {k}) AS kmer FROM (SELECT doc_id, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM d)) k),
e AS (SELECT {canonical_sql('kmer')} AS kmer, CASE WHEN kmer <= {rc_sql('kmer')} THEN l ELSE translate(r, 'ACGT', 'TGCA') END AS l, CASE WHEN kmer <= {rc_sql('kmer')} THEN r ELSE translate(l, 'ACGT', 'TGCA') END AS r FROM e0),
n AS (SELECT kmer, {', '.join(f"count(*) FILTER (r = '{b}') AS out_{b.lower()}" for b in 'ACGT')}, {', '.join(f"count(*) FILTER (l = '{b}') AS in_{b.lower()}" for b in 'ACGT')}, count(*) AS self FROM e GROUP BY kmer)"""


def _nodes(spark, sf_dir, k, most=None):
    return graph.count_nodes_packed(raw_texts(spark, sf_dir), k, most=most)


@query(_edges_sql(7) + " SELECT * FROM n")
def dbg_edge_counts(spark, sf_dir) -> DataFrame:
    return _nodes(spark, sf_dir, 7)


@query(_edges_sql(7) + " SELECT kmer, " + ", ".join(f"least({c}, 255)::BIGINT AS {c}" for c in (*graph.OUT, *graph.IN, "self")) + " FROM n")
def dbg_saturated_counts(spark, sf_dir) -> DataFrame:
    return _nodes(spark, sf_dir, 7, 255)


@query(_edges_sql(9) + " SELECT kmer, (" + " + ".join(f"CASE WHEN {c} > 0 THEN {1 << i} ELSE 0 END" for i, c in enumerate((*graph.OUT, *graph.IN))) + ")::INT AS mask FROM n")
def dbg_edge_exists(spark, sf_dir) -> DataFrame:
    return graph.counts_to_masks(_nodes(spark, sf_dir, 9))


def _neighbour_sql(columns, made) -> str:
    return _edges_sql(7) + " " + " UNION ALL ".join(f"SELECT kmer, {made(b)} AS neighbour, {c} AS frequency FROM n WHERE {c} > 0" for b, c in zip("ACGT", columns, strict=True))


@query(_neighbour_sql(graph.OUT, lambda b: f"substr(kmer, 2) || '{b}'"))
def dbg_out_neighbours(spark, sf_dir) -> DataFrame:
    return graph.out_neighbours(_nodes(spark, sf_dir, 7))


@query(_neighbour_sql(graph.IN, lambda b: f"'{b}' || left(kmer, 6)"))
def dbg_in_neighbours(spark, sf_dir) -> DataFrame:
    return graph.in_neighbours(_nodes(spark, sf_dir, 7), 7)


@query(_edges_sql(7) + " SELECT kmer, out_a AS frequency FROM n")
def dbg_edge_frequency(spark, sf_dir) -> DataFrame:
    return graph.edge_frequency(_nodes(spark, sf_dir, 7), "out_a")


@query(_edges_sql(5) + ", q AS (SELECT count(*) AS tuples, sum((l <> '')::INT)::BIGINT AS with_left, sum((r <> '')::INT)::BIGINT AS with_right FROM e0) SELECT * FROM q")
def dbg_quality_tuples(spark, sf_dir) -> DataFrame:
    """k-mers with neighbours and quality side by side: both generators give the same windows."""
    records = _with_quality(sequences(spark, sf_dir))
    edges = generate.kmers_with_edges(records, 5, keep=("doc_id",))
    quality = generate.kmers_with_quality(records, 5, keep=("doc_id",)).drop("kmer")
    rows = edges.join(quality, ["doc_id", "pos"])
    return rows.agg(F.count("*").alias("tuples"), F.count_if(F.col("left") != "").alias("with_left"), F.count_if(F.col("right") != "").alias("with_right"))
