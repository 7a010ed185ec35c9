"""Queries on the stream combinators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranges, streams
from .common import registered, table

QUERIES: dict = {}
query = registered(QUERIES)


@query("SELECT event_id, user_id, round(sum(value) OVER w, 6) AS total, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) QUALIFY count(*) OVER w = 4")
def sliding_window(spark, sf_dir) -> DataFrame:
    out = streams.sliding(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 4, total=F.sum("value"), most=F.max("value"))
    return out.select("event_id", "user_id", F.round("total", 6).alias("total"), "most")


@query("WITH x AS (SELECT user_id, event_id, min(value) OVER w AS low, max(value) OVER w AS high, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT event_id, 0 AS pos, low AS value FROM x WHERE n = 3 UNION ALL SELECT event_id, 1, high FROM x WHERE n = 3")
def sliding_one_to_many(spark, sf_dir) -> DataFrame:
    """Each window gives two elements."""
    out = streams.sliding(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 3, low=F.min("value"), high=F.max("value"))
    return streams.one_to_many(out, F.array("low", "high"), "element").select("event_id", "pos", F.col("element").alias("value"))


@query("SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS part FROM orders")
def block_partition(spark, sf_dir) -> DataFrame:
    from ..operators.numbering import numbered

    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return ranges.in_blocks(numbered(orders, ["o_orderkey"]), "number", orders.count(), 7).select("o_orderkey", "part")


@query("SELECT o_orderkey, o_custkey FROM orders")
def rebalanced_rows(spark, sf_dir) -> DataFrame:
    from ..operators.aggregate import rebalanced

    return rebalanced(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 5)


@query("SELECT p_partkey, p_retailprice * 2 AS twice FROM part WHERE p_size > 25")
def filter_transform(spark, sf_dir) -> DataFrame:
    out = streams.filter_transform(table(spark, sf_dir, "part"), F.col("p_size") > 25, twice=F.col("p_retailprice") * 2)
    return out.select("p_partkey", "twice")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal * 1.5 ELSE c_acctbal - 1 END AS moved, CASE WHEN c_acctbal > 0 THEN 'up' ELSE 'down' END AS way FROM customer")
def conditional_transform(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    b = F.col("c_acctbal")
    return streams.conditional(c, b > 0, lambda d: d.select("c_custkey", (b * 1.5).alias("moved"), F.lit("up").alias("way")), lambda d: d.select("c_custkey", (b - 1).alias("moved"), F.lit("down").alias("way")))


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey * 10 + n_regionkey AS both FROM nation")
def zip_unzip(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumns({"a": F.array("n_nationkey"), "b": F.array("n_regionkey")})
    z = streams.zipped(rows, "a", "b").withColumn("z", F.element_at("zipped", 1))
    z = streams.unzipped(streams.unzipped(z, "z", "a", "x"), "z", "b", "y")
    return z.select("n_nationkey", "n_name", "n_regionkey", (F.col("x") * 10 + F.col("y")).alias("both"))


@query("SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part")
def concatenated_streams(spark, sf_dir) -> DataFrame:
    part = lambda t, k, n, kind: streams.constant(table(spark, sf_dir, t).select(F.col(k).alias("key"), F.col(n).alias("name")), "kind", kind)
    return streams.concatenated(part("customer", "c_custkey", "c_name", "customer"), part("supplier", "s_suppkey", "s_name", "supplier"), part("part", "p_partkey", "p_name", "part"))


@query("WITH a AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT pos::INT AS pos, count(*) AS n, round(sum(x::DOUBLE), 4) AS total FROM a GROUP BY 1")
def one_to_many(spark, sf_dir) -> DataFrame:
    rows = streams.one_to_many(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("embedding"), "x")
    return rows.groupBy("pos").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@query("SELECT conv_id, (turn // 3)::BIGINT AS chunk, count(*) AS turns, sum(length(text))::BIGINT AS size FROM conversations GROUP BY 1, 2")
def many_to_one(spark, sf_dir) -> DataFrame:
    return streams.many_to_one(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3, F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("size"))


@query("SELECT o_orderkey, unnest(range(o_orderkey, o_orderkey + 5 * (o_custkey % 4), 5)) AS x FROM orders WHERE o_custkey % 4 > 0")
def counting_stream(spark, sf_dir) -> DataFrame:
    return streams.counting(table(spark, sf_dir, "orders"), "x", F.col("o_orderkey"), 5, F.col("o_custkey") % 4).select("o_orderkey", "x")


@query("SELECT o_orderkey, (o_orderkey % 7)::INT AS part FROM orders")
def cyclic_partition(spark, sf_dir) -> DataFrame:
    return ranges.cyclic(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)
