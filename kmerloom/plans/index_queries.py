"""Queries on keyed indices: every kind of index and every batch query, on k-mers and on the relational tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregate, generate, ranges
from ..operators.index import Index, in_order, strand
from ..session import checkpointed
from .common import canonical_sql, kmers_sql, raw_texts, registered, table, sequences

QUERIES: dict = {}
query = registered(QUERIES)


def _lines(spark, sf_dir) -> DataFrame:
    """Lines by part. Of lines with one order and number, the one that comes first in the files is first, as in the SQL."""
    at = F.struct("l_orderkey", "l_linenumber", "_metadata.file_path", "_metadata.row_index")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("value"), at.alias("at"))


def _multimap(spark, sf_dir, **options) -> Index:
    return Index.build(_lines(spark, sf_dir), ["key"], kind="multimap", **options)


def _asked(spark, sf_dir) -> DataFrame:
    """Keys asked for, with repeats and with some that aren't there: the sizes of parts, and their keys past the end."""
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_size").cast("long").alias("key")).unionByName(parts.select((F.col("p_partkey") * 3).alias("key")))


_ASKED = "a AS (SELECT p_size::BIGINT AS key FROM part UNION ALL SELECT p_partkey * 3 FROM part)"
_LINES = "l AS (SELECT l_partkey AS key, l_quantity AS value, l_orderkey, l_linenumber FROM lineitem)"


@query(f"WITH {_LINES} SELECT key, arg_min(value, (l_orderkey, l_linenumber)) AS value FROM l GROUP BY key")
def map_first_wins(spark, sf_dir) -> DataFrame:
    return Index.build(_lines(spark, sf_dir), ["key"], order=F.col("at")).rows.select("key", "value")


@query(f"WITH {_LINES}, {_ASKED}, m AS (SELECT key, arg_min(value, (l_orderkey, l_linenumber)) AS value FROM l GROUP BY key) SELECT DISTINCT key, value FROM a JOIN m USING (key)")
def map_find(spark, sf_dir) -> DataFrame:
    return Index.build(_lines(spark, sf_dir), ["key"], order=F.col("at")).find(_asked(spark, sf_dir)).select("key", "value")


@query(f"WITH {_LINES}, {_ASKED} SELECT key, value, l_orderkey, l_linenumber FROM (SELECT DISTINCT key FROM a) JOIN l USING (key)")
def multimap_find(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).find(_asked(spark, sf_dir)).select("key", "value", "at.l_orderkey", "at.l_linenumber")


@query(f"WITH {_LINES}, {_ASKED} SELECT key, value, l_orderkey, l_linenumber FROM a JOIN l USING (key)")
def multimap_find_all_queries(spark, sf_dir) -> DataFrame:
    """Each repeated query is answered again."""
    return _multimap(spark, sf_dir, dedupe=False).find(_asked(spark, sf_dir)).select("key", "value", "at.l_orderkey", "at.l_linenumber")


@query(f"WITH {_LINES}, {_ASKED} SELECT key, value, l_orderkey, l_linenumber FROM (SELECT DISTINCT key FROM a) JOIN l USING (key)")
def sorted_multimap_find(spark, sf_dir) -> DataFrame:
    """The same on a stored index in key order: only the queries' range of it is read."""
    return _multimap(spark, sf_dir, sorted_by_range=True).saved().find(_asked(spark, sf_dir)).select("key", "value", "at.l_orderkey", "at.l_linenumber")


@query(f"WITH {_LINES}, m AS (SELECT key, arg_min(value, (l_orderkey, l_linenumber)) AS value FROM l GROUP BY key) SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS place FROM m")
def sorted_map_order(spark, sf_dir) -> DataFrame:
    """A sorted map: partitions and rows in them come in key order, so places number the keys."""
    rows = Index.build(_lines(spark, sf_dir), ["key"], order=F.col("at"), sorted_by_range=True).rows
    rows = rows.select("key", "value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    rows = checkpointed(rows)
    sizes = rows.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("p"), F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    return rows.join(F.broadcast(before), "p").select("key", "value", (F.col("i").bitwiseAND(F.lit(2**33 - 1)) + F.col("o")).alias("place"))


@query(f"WITH {_LINES}, {_ASKED} SELECT key, value, l_orderkey, l_linenumber FROM (SELECT DISTINCT key FROM a) JOIN l USING (key) WHERE value > 25")
def find_if(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).find(_asked(spark, sf_dir), F.col("value") > 25).select("key", "value", "at.l_orderkey", "at.l_linenumber")


@query(f"WITH {_LINES} SELECT key, value FROM l WHERE value >= 49")
def find_if_scan(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).scan(F.col("value") >= 49).select("key", "value")


@query(f"WITH {_LINES}, {_ASKED} SELECT key * 10 AS moved, value / 2 AS half FROM (SELECT DISTINCT key FROM a) JOIN l USING (key) WHERE value > 40")
def find_transform(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).find_transform(_asked(spark, sf_dir), F.col("value") > 40, (F.col("key") * 10).alias("moved"), (F.col("value") / 2).alias("half"))


@query(f"WITH {_LINES}, {_ASKED} SELECT key, count(value) AS count FROM (SELECT DISTINCT key FROM a) LEFT JOIN l USING (key) GROUP BY key")
def count_queries(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).count(_asked(spark, sf_dir))


@query(f"WITH {_LINES}, {_ASKED} SELECT key, count(*) FILTER (value < 10) AS count FROM (SELECT DISTINCT key FROM a) LEFT JOIN l USING (key) GROUP BY key")
def count_if(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).count(_asked(spark, sf_dir), F.col("value") < 10)


@query(f"WITH {_LINES} SELECT key, count(*) FILTER (value > 45) AS count FROM l GROUP BY key")
def count_if_scan(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).count_scan(F.col("value") > 45)


@query(f"WITH {_LINES}, {_ASKED} SELECT key AS asked, count(value) * 2 AS twice FROM (SELECT DISTINCT key FROM a) LEFT JOIN l USING (key) GROUP BY key")
def count_transform(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).count_transform(_asked(spark, sf_dir), F.col("key").alias("asked"), (F.col("count") * 2).alias("twice"))


@query(f"WITH {_LINES}, {_ASKED} SELECT key, (count(value) > 0)::INT AS exists FROM (SELECT DISTINCT key FROM a) LEFT JOIN l USING (key) GROUP BY key")
def exists_queries(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).exists(_asked(spark, sf_dir))


@query(f"WITH {_LINES}, {_ASKED} SELECT key, (count(*) FILTER (value = 50) > 0)::INT AS exists FROM (SELECT DISTINCT key FROM a) LEFT JOIN l USING (key) GROUP BY key")
def exists_if(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).exists(_asked(spark, sf_dir), F.col("value") == 50)


@query(f"WITH {_LINES}, {_ASKED} SELECT key, value FROM l WHERE key NOT IN (SELECT key FROM a)")
def erase_queries(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).erase(_asked(spark, sf_dir)).rows.select("key", "value")


@query(f"WITH {_LINES}, {_ASKED} SELECT key, value FROM l WHERE NOT (key IN (SELECT key FROM a) AND value < 30)")
def erase_if(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).erase(_asked(spark, sf_dir), F.col("value") < 30).rows.select("key", "value")


@query(f"WITH {_LINES} SELECT key, value FROM l WHERE NOT value BETWEEN 10 AND 40")
def erase_if_scan(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).erase_scan(F.col("value").between(10, 40)).rows.select("key", "value")


@query(f"WITH {_LINES}, {_ASKED}, m AS (SELECT key, sum(value) AS value FROM l GROUP BY key), u AS (SELECT key, count(*) AS n FROM a GROUP BY key) SELECT key, CASE WHEN n IS NULL THEN value ELSE value + n END AS value FROM m LEFT JOIN u USING (key)")
def update_queries(spark, sf_dir) -> DataFrame:
    """Stored sums grow by the number of updates that their key has."""
    stored = Index.build(_lines(spark, sf_dir), ["key"], kind="reduction")
    return stored.update(_asked(spark, sf_dir).withColumn("one", F.lit(1.0)), "one", lambda old, new: old + new).rows


@query(f"WITH {_LINES} SELECT key, CASE WHEN key % 2 = 0 THEN -value ELSE value END AS value FROM l")
def update_if_scan(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).update_scan(F.col("key") % 2 == 0, -F.col("value")).rows.select("key", "value")


@query(f"WITH {_LINES}, r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS request, o_orderkey, o_custkey AS key FROM orders), s AS (SELECT key, sum(value) AS answer FROM l GROUP BY key) SELECT request, o_orderkey, key, answer FROM r LEFT JOIN s USING (key)")
def scatter_compute_gather(spark, sf_dir) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    answers = aggregate.reduced(_lines(spark, sf_dir), ["key"], answer=F.sum("value"))
    return in_order(requests, ["o_orderkey"], ["key"], answers).select("request", "o_orderkey", "key", "answer")


@query(f"WITH {_LINES} SELECT key, value FROM l WHERE value > 20 AND key IN (SELECT key FROM l WHERE value > 20 GROUP BY key HAVING count(*) >= 18)")
def group_predicate(spark, sf_dir) -> DataFrame:
    """Insert with a predicate; then entries of groups that satisfy one on the whole group."""
    some = Index.build(_lines(spark, sf_dir), ["key"], kind="multimap", where=F.col("value") > 20)
    return some.with_group_predicate(lambda value: F.count(value) >= 18).select("key", "value")


@query("SELECT o_custkey AS key, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) AS n, bit_or(o_orderkey) AS bits FROM orders GROUP BY 1")
def reduction_folds(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    return aggregate.reduced(o, ["key"], total=F.round(F.sum("o_totalprice"), 2), least=F.min("o_totalprice"), most=F.max("o_totalprice"), n=F.count("*"), bits=F.bit_or("o_orderkey"))


@query("SELECT user_id, bit_xor(event_id) AS value FROM events GROUP BY 1")
def reduction_by_function(spark, sf_dir) -> DataFrame:
    return aggregate.reduced(table(spark, sf_dir, "events"), ["user_id"], value=F.bit_xor("event_id"))


@query("WITH e AS (SELECT user_id AS key, event_id AS value FROM events) SELECT key, sum(v)::BIGINT AS value FROM (SELECT key, count(*) AS v FROM e GROUP BY key UNION ALL SELECT key, count(*) FROM e WHERE value % 2 = 0 GROUP BY key) GROUP BY key")
def insert_merges_counts(spark, sf_dir) -> DataFrame:
    """A fold whose results merge by another one: counts that later entries are added to."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"))
    return Index.build(rows, ["key"], kind="reduction", fold=F.count, merge=F.sum).insert(rows, F.col("value") % 2 == 0).rows


@query("SELECT user_id AS key, count(*) AS value FROM events GROUP BY 1")
def counting_map(spark, sf_dir) -> DataFrame:
    return Index.build(table(spark, sf_dir, "events").select(F.col("user_id").alias("key")), ["key"], kind="counting").rows


@query("SELECT l_partkey AS key, least(count(*), 20)::BIGINT AS value FROM lineitem GROUP BY 1")
def saturating_map(spark, sf_dir) -> DataFrame:
    return Index.build(_lines(spark, sf_dir).select("key"), ["key"], kind="saturating", most=20).rows


@query("WITH c AS (SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT s_suppkey, count(*) FROM supplier GROUP BY 1) SELECT key, sum(n)::BIGINT AS value FROM c GROUP BY key")
def insert_accumulates(spark, sf_dir) -> DataFrame:
    first = Index.build(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key")), ["key"], kind="counting")
    return first.insert(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))).rows


@query("WITH m AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer), n AS (SELECT o_custkey + 10 AS key, min(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT * FROM m UNION ALL SELECT * FROM n WHERE key NOT IN (SELECT key FROM m)")
def insert_keeps_first(spark, sf_dir) -> DataFrame:
    """A map keeps its entry when the key is inserted again, and only what satisfies the predicate goes in."""
    stored = Index.build(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")), ["key"])
    more = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 10).alias("key"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    return stored.insert(more, F.col("o_orderstatus") == "F").rows


@query("SELECT count(*) AS size, count(DISTINCT l_partkey) AS unique_size, count(*) / count(DISTINCT l_partkey)::DOUBLE AS multiplicity, count(*) = 0 AS is_empty FROM lineitem")
def index_sizes(spark, sf_dir) -> DataFrame:
    return _multimap(spark, sf_dir).sizes()


@query("SELECT DISTINCT l_suppkey AS key FROM lineitem")
def index_keys(spark, sf_dir) -> DataFrame:
    return aggregate.distinct_keys(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key")), ["key"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000")
def sorted_range_scan(spark, sf_dir) -> DataFrame:
    rows = aggregate.range_sorted(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return ranges.between(rows, "o_orderkey", 100, 5000)


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS number FROM orders")
def sorted_numbers(spark, sf_dir) -> DataFrame:
    from ..operators.numbering import numbered

    return numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY 1")
def sorted_unique_keep_first(spark, sf_dir) -> DataFrame:
    return aggregate.first_wins(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderkey"), F.struct("o_orderdate", "o_orderkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 100 = 0")
def sample_keys(spark, sf_dir) -> DataFrame:
    return aggregate.sampled_by_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 100)


@query(f"WITH {kmers_sql(11)}, i AS (SELECT {canonical_sql('kmer')} AS kmer, count(*) AS n FROM k GROUP BY 1), b AS (SELECT upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', 'A', 'g')) AS s FROM benchmark), q0 AS (SELECT DISTINCT {canonical_sql('x')} AS kmer FROM (SELECT substr(s, j, 11) AS x FROM (SELECT s, unnest(range(1, length(s) - 9)) AS j FROM b))) SELECT q0.kmer, coalesce(n, 0)::BIGINT AS count FROM q0 LEFT JOIN i USING (kmer)")
def kmer_count_query(spark, sf_dir) -> DataFrame:
    """The benchmark's k-mers, asked of a canonical count index of the documents."""
    stored = generate.count_packed(raw_texts(spark, sf_dir), 11, "canonical").withColumnRenamed("count", "value")
    i = Index(stored, ("kmer",), kind="counting", transform=strand("canonical"))
    q = table(spark, sf_dir, "benchmark").select(F.coalesce("text", F.lit("")).alias("seq"))
    asked = generate.count_packed(q, 11).select("kmer")
    found = i.find(asked).withColumnRenamed("value", "count")
    missing = i.transform(asked).select("kmer").distinct().join(found, "kmer", "left_anti").withColumn("count", F.lit(0).cast("long"))
    return found.select("kmer", "count").unionByName(missing)


@query(f"WITH {kmers_sql(12)}, b AS (SELECT upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', 'A', 'g')) AS s FROM benchmark), q0 AS (SELECT DISTINCT substr(s, j, 12) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 10)) AS j FROM b)) SELECT kmer, doc_id, pos FROM q0 JOIN k USING (kmer)")
def kmer_position_index_query(spark, sf_dir) -> DataFrame:
    """The benchmark's k-mers, asked of a multimap of all positions of the documents."""
    stored = generate.kmers(sequences(spark, sf_dir), 12, keep=("doc_id",)).select("kmer", F.struct("doc_id", "pos").alias("at"))
    i = Index.build(stored, ["kmer"], "at", "multimap")
    q = table(spark, sf_dir, "benchmark").select(F.coalesce("text", F.lit("")).alias("seq"))
    return i.find(generate.count_packed(q, 12).select("kmer")).select("kmer", "at.doc_id", "at.pos")


@query(f"WITH {kmers_sql(8)}, o AS (SELECT kmer, doc_id, pos, {canonical_sql('kmer')} AS c FROM k) SELECT arg_min(kmer, (doc_id, pos)) AS kmer, min(doc_id) AS doc_id FROM o GROUP BY c")
def kmer_bimolecule_map(spark, sf_dir) -> DataFrame:
    return generate.bimolecule_packed(raw_texts(spark, sf_dir), 8, "doc_id").select("kmer", "doc_id")


@query("WITH i AS (SELECT user_id, event_id AS s, event_id + 20 AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i), g AS (SELECT *, sum((r IS NULL OR s > r)::INT) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY user_id, g")
def interval_merge(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 20).alias("end"))
    return ranges.merged(rows, ["user_id"])


@query("SELECT l_orderkey, l_linenumber, greatest(l_partkey, l_suppkey) AS low, least(l_partkey + 50, l_suppkey + 100) AS high FROM lineitem WHERE greatest(l_partkey, l_suppkey) < least(l_partkey + 50, l_suppkey + 100)")
def interval_intersection(spark, sf_dir) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("x", ranges.intersection(p, p + 50, s, s + 100)).where("x is not null")
    return rows.select("l_orderkey", "l_linenumber", F.col("x.start").alias("low"), F.col("x.end").alias("high"))
