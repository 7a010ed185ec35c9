"""Streams give what a batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerloom.operators.generate import kmers
from kmerloom.streaming import counts


def test_running_counts_and_index(spark, tmp_path):
    batch = spark.createDataFrame([(i, "ACGTACGGT"[i % 3 :]) for i in range(20)], "id int, seq string")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, kmers(batch, 4).groupBy("kmer").count().collect()))
    q = counts.kmer_counts(read(), 4).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == want
    q = counts.append_batches(read(), str(tmp_path / "index"), 4, str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, counts.read_index(spark, str(tmp_path / "index")).collect())) == want


def test_event_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    q = counts.windowed_events(stream, "ts", "1 day", "1 hour", "1 hour", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("events_by_hour").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert spark.table("events_by_hour").agg(F.sum("n")).first()[0] == events.count() and spark.table("events_by_hour").count() == want.count()


def test_windowed_kmers(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{i}:00:00", "ACGT") for i in range(5)], "t string, seq string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "w"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "w"))
    q = counts.windowed_kmer_counts(s, 3, "t", "2 hours", "1 hour").writeStream.outputMode("complete").format("memory").queryName("wk").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wk").agg(F.sum("count")).first()[0] == 10
