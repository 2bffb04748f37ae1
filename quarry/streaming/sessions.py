"""I1 idle sessions and I2 running counters, batch and streaming.

A session of a key closes after more than ``gap`` of inactivity (the
reference expires an idle chat session only when idle time is *more*
than the timeout; Spark's session windows merge a gap of exactly ``gap``,
so both agree).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def idle_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts",
                  gap_seconds: int = 7200, value: str | None = "value",
                  bucket_seconds: int = 86400) -> DataFrame:
    """I1 batch: (key, session_start, last_event, n_events, total_value).

    Two phases so that one busy key never lands whole in one task:
    1. gaps-and-islands inside (key, time bucket) with ``lag`` windows;
    2. the per-bucket session summaries (far fewer rows) are merged per key
       when the next one starts within ``gap`` of the previous end.
    The result equals plain gaps-and-islands per key."""
    gap = gap_seconds * 1_000_000
    us = _micros(ts)
    v = F.col(value).cast("double") if value else F.lit(None).cast("double")
    e = events.select(F.col(key).alias("_k"), us.alias("_us"), F.col(ts).alias("_ts"), v.alias("_v")) \
        .where(F.col("_us").isNotNull())
    e = e.withColumn("_b", F.floor(F.col("_us") / F.lit(bucket_seconds * 1_000_000)))
    w1 = Window.partitionBy("_k", "_b").orderBy("_us")
    prev = F.lag("_us").over(w1)
    e = e.withColumn("_new", F.when(prev.isNull() | (F.col("_us") - prev > gap), 1).otherwise(0))
    e = e.withColumn("_sid", F.sum("_new").over(w1.rowsBetween(Window.unboundedPreceding, 0)))
    local = e.groupBy("_k", "_b", "_sid").agg(
        F.min("_us").alias("_s"), F.max("_us").alias("_e"), F.min("_ts").alias("_start"),
        F.max("_ts").alias("_last"), F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_tv"))
    w2 = Window.partitionBy("_k").orderBy("_s")
    prev_end = F.lag("_e").over(w2)
    local = local.withColumn("_new", F.when(prev_end.isNull() | (F.col("_s") - prev_end > gap), 1).otherwise(0))
    local = local.withColumn("_gid", F.sum("_new").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
    out = local.groupBy("_k", "_gid").agg(
        F.min("_start").alias("session_start"), F.max("_last").alias("last_event"),
        F.sum("_n").alias("n_events"), F.sum("_tv").alias("total_value"))
    return out.select(F.col("_k").alias(key), "session_start", "last_event", "n_events", "total_value")


def idle_sessions_stream(stream: DataFrame, key: str = "user_id", ts: str = "ts",
                         gap: str = "2 hours", watermark: str = "10 minutes",
                         value: str = "value") -> DataFrame:
    """I1 streaming: ``session_window`` with a watermark (append mode
    emits a session once the watermark passes its end; rows later than
    the watermark are dropped).  NTZ timestamps are cast first because
    watermarks need TIMESTAMP."""
    s = stream.withColumn("_ets", F.col(ts).cast("timestamp")).withWatermark("_ets", watermark)
    g = s.groupBy(F.col(key), F.session_window("_ets", gap).alias("sw")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.col(value).cast("double")).alias("total_value"),
        F.max("_ets").alias("_last"))
    return g.select(key, F.col("sw.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("_last").cast("timestamp_ntz").alias("last_event"), "n_events", "total_value")


def stream_counters(stream: DataFrame, key: str = "user_id", kind: str = "event_type") -> DataFrame:
    """I2 streaming: running count per (key, kind); use update mode."""
    return stream.groupBy(key, kind).agg(F.count(F.lit(1)).alias("events"))


def run_to_parquet(query_df: DataFrame, out_path: str, checkpoint: str,
                   mode: str = "append") -> None:
    """Drive a streaming DataFrame over all available input
    (``availableNow``) into parquet.  Append mode uses the exactly-once file
    sink; update-mode output is written per micro-batch into
    ``batch_id=<n>`` folders (see ``latest_per_key``)."""
    w = query_df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out_path).start()
    else:
        def sink(batch: DataFrame, batch_id: int) -> None:
            # one folder per micro-batch, overwritten on replay: a batch
            # re-run after a failure replaces its own output (idempotent)
            batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
        q = w.outputMode(mode).foreachBatch(sink).start()
    q.awaitTermination()


def latest_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Resolve update-mode output: the row of the latest batch per key
    (``max_by`` combines map-side)."""
    vals = [c for c in updates.columns if c not in keys and c != "batch_id"]
    # one max_by per value column keeps scalar buffers (hash aggregate)
    return updates.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in vals])
