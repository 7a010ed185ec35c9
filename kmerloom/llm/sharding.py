"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, prepare, text_or_empty

#: The ring is cut into this many equal arcs; an arc moves as one. It bounds what the driver holds.
ARCS = 65536


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in ring order, and the shard of each."""
    named = ((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(vnodes))
    at = sorted(named)
    return np.array([p for p, _ in at], np.uint64), np.array([s for _, s in at], np.int64)


def place(weights: np.ndarray, shards: int, vnodes: int = 128, slack: float = 0.002) -> np.ndarray:
    """The shard of each arc.

    Arcs arrive by falling weight, so that light ones fill the gaps. Each goes to the first virtual
    node clockwise whose shard still has room; a shard has room up to (1 + slack) times the mean.
    Where an arc fits nowhere, all shards get more room, by ``slack`` of the mean each time, until it does; so it, too, goes on clockwise.
    """
    at, owner = ring(shards, vnodes)
    n = len(weights)
    first = np.searchsorted(at, (np.arange(n, dtype=np.uint64) * np.uint64(2**64 // n)) + np.uint64(2**63 // n)) % len(owner)
    mean = float(weights.sum()) / shards
    room, more = np.full(shards, int(np.ceil(mean * (1 + slack))), np.int64), max(1, int(mean * slack))
    owners, out = owner.tolist(), np.full(n, -1, np.int64)
    for arc in np.lexsort((np.arange(n), -weights)):
        w, i = int(weights[arc]), int(first[arc])
        short = w - int(room.max())
        if short > 0:
            room += -(-short // more) * more
        while room[owners[i]] < w:
            i = (i + 1) % len(owners)
        out[arc] = owners[i]
        room[out[arc]] -= w
    return out


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 128, slack: float = 0.002, copies: int = 256) -> DataFrame:
    """Deals documents to shards of near equal bytes; returns a row for each document.

    Columns: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (0, 1, ... in each shard).
    A null text has no bytes; a null doc_id is a key like any other; other columns are ignored;
    no rows give no rows. Repeated rows (same doc_id, size and checksum) are counted before
    they are dealt and split into runs of at most ``copies`` and 64 KB (or one row), each with a place of its own on the
    ring, so a row repeated without end still spreads over all shards. A key is doc_id, size and checksum: ids
    that repeat with other texts, null ones too, have places of their own. Texts are never shuffled.
    """
    spark = prepare(docs.sparkSession)
    text = text_or_empty()
    runs = (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
        .withColumn("each", F.expr(f"greatest(1L, least({copies}L, 65536 div size))"))
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div each"))))
        .withColumn("n", F.least(F.col("each"), F.col("n") - F.col("run") * F.col("each"))).drop("each")
        .withColumn("at", F.xxhash64("doc_id", "size", "text_crc32", "run"))
        .withColumn("arc", F.shiftrightunsigned("at", 64 - ARCS.bit_length() + 1).cast("int"))
        .checkpoint()
    )
    seen = runs.groupBy("arc").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")).toPandas()  # ARCS rows at most
    weight, rows = np.zeros(ARCS, np.int64), np.zeros(ARCS, np.int64)
    weight[seen["arc"]], rows[seen["arc"]] = seen["bytes"], seen["rows"]
    owner = np.full(ARCS, -1, np.int64)
    if len(seen):
        owner = place(weight, shards, vnodes, slack)
    slot0 = np.zeros(ARCS, np.int64)
    for s in range(shards):
        own = owner == s
        slot0[own] = np.cumsum(rows[own]) - rows[own]
    where = spark.createDataFrame(pd.DataFrame({"arc": np.arange(ARCS, dtype=np.int32), "shard": owner.astype(np.int32), "slot0": slot0}))
    before = Window.partitionBy("arc").orderBy("at", "doc_id", "size", "text_crc32", "run").rowsBetween(Window.unboundedPreceding, -1)
    return (
        runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(F.broadcast(where), "arc")
        .withColumn("slot", F.explode(F.sequence(F.col("slot0") + F.col("before"), F.col("slot0") + F.col("before") + F.col("n") - 1)))
        .select("doc_id", "size", "text_crc32", "shard", "slot")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """shard() of the whole table documents by the law ``bytes``."""
    out = shard(documents(spark, sf_dir).select("doc_id", "text"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
