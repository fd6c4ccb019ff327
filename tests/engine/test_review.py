from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import review
from vellum.streaming import queue


def test_annotations_and_sessions(spark):
    blocks = spark.createDataFrame([(1, "a", 0, 10.0), (1, "b", 1, 50.0), (1, "c", 2, 30.0)], "page_id long, uid string, block_idx int, y0 double")
    items = spark.createDataFrame([(1, 1, "i", "b", 0.0), (1, 2, "j", "gone", 40.0), (1, 3, "k", None, 5.0), (2, 1, "l", "x", 5.0)], "page_id long, place long, item_id string, own_uid string, y double")
    assert sorted(tuple(r) for r in review.annotations(items, blocks).collect()) == [(1, 1, "i", "b"), (1, 2, "j", "c"), (1, 3, "k", "a")]
    hashes = review.block_hashes(spark.createDataFrame([(1, 0, "a", "A"), (2, 0, "a", "B")], "page_id long, place int, uid string, markdown string"))
    now = {r.page_id: r.hash for r in hashes.collect()}
    sessions = spark.createDataFrame([(1, now[1], 1), (2, "stale", 0)], "page_id long, base_hash string, undone int")
    events = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "page_id long, seq long")
    assert [tuple(r) for r in review.session_events(events, sessions, hashes).select("page_id", "seq").collect()] == [(1, 1)]


def test_swapped_reading(spark):
    rows = spark.createDataFrame([("dose 12 mg", "12", "21"), ("dose 112 mg", "12", "21"), ("12 and 12", "12", "21"), ("a.b", ".", "-")], "m string, a string, b string")
    assert [r[0] for r in rows.select(review.swapped_reading(F.col("m"), F.col("a"), F.col("b"))).collect()] == ["dose 21 mg", None, None, "a-b"]


def test_status_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "queued"), (1, "2024-01-01 10:05:00", "done"), (2, "2024-01-01 11:00:00", "processing"), (2, "2024-01-01 10:00:00", "noise")], "page_id long, at string, status string").select("page_id", F.to_timestamp("at").alias("ts"), "status")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    running = queue.page_status_stream(stream).writeStream.format("memory").queryName("page_status").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert sorted((r.page_id, r.status) for r in spark.table("page_status").collect()) == [(1, "done"), (2, "processing")]
