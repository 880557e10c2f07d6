"""Queries of rate limits and conversation logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.tables import shared_path
from quillstone.plans.registry import query, table
from quillstone.streaming import limits

DAY = 86_400


@query("rate_window", "SELECT event_id, n, n > 5 AS rejected, CASE WHEN n > 5 THEN w + 86400 - s END AS retry_after FROM (SELECT event_id, s, s - s % 86400 AS w, row_number() OVER (PARTITION BY user_id, s // 86400 ORDER BY ts, event_id) AS n FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events))")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = limits.limited(table(spark, sf_dir, "events"), "user_id", limit=5, seconds=DAY)
    return out.select("event_id", F.col("n").cast("long").alias("n"), "rejected", "retry_after")


_COUNTS = "SELECT user_id, s - s % 86400 AS window_start, count(*) AS requests, greatest(0, count(*) - 5) AS rejected FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events) GROUP BY user_id, window_start"


@query("rate_counts", _COUNTS)
def rate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = limits.window_counts(table(spark, sf_dir, "events"), "user_id", seconds=DAY)
    return out.withColumn("rejected", F.greatest(F.lit(0), F.col("requests") - 5))


@query("rate_stream", _COUNTS)
def rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream of the events table's files."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    name = "rates_" + uuid.uuid4().hex
    path = shared_path(spark, name)
    q = limits.run_counts(stream, "user_id", path, shared_path(spark, name), limit=5, seconds=DAY)
    q.awaitTermination()
    return limits.read_counts(spark, path, "user_id", schema["user_id"].dataType.simpleString())


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("event_index"), F.concat_ws(":", "role", "text").alias("event"), F.timestamp_seconds(F.col("turn") * 60).alias("at"))


@query("event_append", "SELECT conv_id AS chat_id, turn AS event_index, CASE WHEN turn % 2 = 0 THEN 'edited' ELSE role || ':' || text END AS event FROM conversations UNION ALL SELECT DISTINCT conv_id, 1000, 'edited' FROM conversations WHERE turn = 0")
def event_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = log(spark, sf_dir)
    new = old.where("event_index % 2 = 0").withColumn("event", F.lit("edited"))
    new = new.unionByName(new.where("event_index = 0").withColumn("event_index", F.lit(1000).cast("long")))
    return limits.append_events(old, new).select("chat_id", "event_index", "event")


@query("event_snapshot", "SELECT conv_id AS chat_id, turn AS event_index, CASE WHEN conv_id % 3 = 0 THEN 'snapshot' ELSE role || ':' || text END AS event FROM conversations WHERE conv_id % 3 <> 0 OR turn < 2")
def event_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = log(spark, sf_dir)
    snapshot = old.where("chat_id % 3 = 0 and event_index < 2").withColumn("event", F.lit("snapshot"))
    return limits.snapshot_events(old, snapshot).select("chat_id", "event_index", "event")


@query("event_batch", "WITH l AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id) SELECT conv_id AS chat_id, turn AS event_index, 'old' AS event FROM conversations UNION ALL SELECT conv_id, m + 1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, 'new' FROM conversations JOIN l USING (conv_id) WHERE turn < 3")
def event_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = log(spark, sf_dir).withColumn("event", F.lit("old"))
    batch = old.where("event_index < 3").select("chat_id", F.lit("new").alias("event"), "at")
    return limits.append_batch(old, batch).select("chat_id", "event_index", "event")


@query("chat_load", """WITH e AS (SELECT conv_id, count(*) AS events, max(turn * 60) FILTER (role = 'assistant') AS settled, string_agg(turn::VARCHAR || role, ',' ORDER BY turn) AS log FROM conversations GROUP BY conv_id)
SELECT conv_id AS chat_id, events, log, CASE WHEN settled >= 60 * (conv_id % 4) THEN NULL ELSE 'waiting' END AS pending FROM e""")
def chat_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    log_ = c.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("event_index"), F.concat(F.col("turn").cast("string"), "role").alias("event"), F.timestamp_seconds(F.col("turn") * 60).alias("at"), "role")
    chats = c.select(F.col("conv_id").alias("chat_id")).distinct().withColumns({"pending": F.lit("waiting"), "pending_at": F.timestamp_seconds(F.col("chat_id") % 4 * 60)})
    out = limits.load_chats(chats, log_, F.col("role") == "assistant")
    return out.select("chat_id", "events", F.array_join(F.transform("log", lambda x: x.event), ",").alias("log"), "pending")
