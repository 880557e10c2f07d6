"""Fixed-window rate limits and event logs, over tables and over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quillstone.operators.tables import running

LIMIT, SECONDS = 25, 3600


def window_start(ts: Column, seconds: int = SECONDS) -> Column:
    """Start of the tumbling window that holds a time, in seconds since 1970."""
    s = F.unix_seconds(ts.cast("timestamp"))
    return s - F.pmod(s, F.lit(seconds))


def limited(requests: DataFrame, key: str, ts: str = "ts", tie: str = "event_id", limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """requests with their number n in the key's window, whether rejected, and then after how many
    seconds to try again. Numbers are counted over range partitions: one key may send most requests."""
    rows = requests.withColumn("window_start", window_start(F.col(ts), seconds))
    numbered = running(rows, [key, "window_start"], [F.col(ts).asc(), F.col(tie).asc()], F.lit(1), "n").withColumn("n", F.col("n") + 1)
    over = F.col("n") > limit
    return numbered.withColumn("rejected", over).withColumn("retry_after", F.when(over, F.col("window_start") + seconds - F.unix_seconds(F.col(ts).cast("timestamp"))))


def window_counts(requests: DataFrame, key: str, ts: str = "ts", seconds: int = SECONDS, watermark: str | None = None) -> DataFrame:
    """Requests by key and window. Works on streams; with a watermark late rows are dropped and closed
    windows forgotten. The time is cast first: a watermark needs a timestamp with a time zone."""
    rows = requests.withColumn("at", F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("at", watermark)
    counts = rows.groupBy(key, F.window("at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    return counts.select(key, F.unix_seconds(F.col("w.start")).alias("window_start"), "requests")


def run_counts(stream: DataFrame, key: str, path: str, checkpoint: str, limit: int = LIMIT, seconds: int = SECONDS, mode: str = "update", watermark: str | None = None) -> StreamingQuery:
    """A streaming query of window counts with how many requests are over the limit, to Parquet at path.

    Each batch is a folder of its own, overwritten if the batch is repeated: what changed (`update`) or
    what is closed (`append`). read_counts() gives the present state.
    """
    counts = window_counts(stream, key, seconds=seconds, watermark=watermark).withColumn("rejected", F.greatest(F.lit(0), F.col("requests") - limit))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return counts.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str, key: str, kind: str = "long") -> DataFrame:
    """(key, window_start, requests, rejected) as of the last batch at path; none if there was no batch. kind: the key's type."""
    schema = f"`{key}` {kind}, window_start long, requests long, rejected long, batch long"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path):
        return spark.createDataFrame([], schema).drop("batch")
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy(key, "window_start").agg(F.max_by(F.struct("requests", "rejected"), "batch").alias("c")).select(key, "window_start", "c.*")


# event logs of conversations: (chat_id, event_index, event, at)


def append_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (chat_id, event_index): the later write wins."""
    both = log.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy("chat_id", "event_index").agg(F.max_by(F.struct("event", "at"), F.struct("__new", "at")).alias("e")).select("chat_id", "event_index", "e.*")


def snapshot_events(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The snapshot's chats hold what the snapshot holds, and nothing after it."""
    chats = snapshot.select("chat_id").distinct()
    return log.join(chats, "chat_id", "left_anti").unionByName(snapshot)


def append_batch(log: DataFrame, batch: DataFrame, order: str = "at") -> DataFrame:
    """The batch (chat_id, event, at) numbered after each chat's last event."""
    last = log.groupBy("chat_id").agg(F.max("event_index").alias("last"))
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy(order))
    new = batch.join(last, "chat_id", "left").withColumn("event_index", F.coalesce(F.col("last") + 1, F.lit(0)) + n - 1)
    return log.unionByName(new.select("chat_id", F.col("event_index").cast(log.schema["event_index"].dataType), "event", "at"))


def load_chats(chats: DataFrame, log: DataFrame, settled: Column) -> DataFrame:
    """chats (chat_id, pending, pending_at) with their events in order; a pending message is cleared by an
    event that settles it at its time or later."""
    done = F.max(F.when(settled, F.col("at"))).alias("settled_at")
    events = log.groupBy("chat_id").agg(F.count("*").alias("events"), F.sort_array(F.collect_list(F.struct("event_index", "event"))).alias("log"), done)
    out = chats.join(events, "chat_id", "left")
    return out.withColumn("pending", F.when(F.col("settled_at") >= F.col("pending_at"), None).otherwise(F.col("pending"))).drop("settled_at")
