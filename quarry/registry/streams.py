"""Checked queries for I1, I2 (batch and Structured Streaming)."""

from __future__ import annotations

from quarry.registry import register, rounded
from quarry.session import read_table, scratch_path
from quarry.streaming import sessions as S

_GAPS = """WITH e AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, ts, value, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > CAST(7200000000 AS BIGINT)
        THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM e),
ss AS (SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n_events,
        round(sum(value), 6) AS total_value FROM s GROUP BY user_id, g)"""


@register("idle_sessions", _GAPS + "\nSELECT * FROM ss")
def idle_sessions(spark, sf):
    return rounded(S.idle_sessions(read_table(spark, sf, "events")))


def _events_stream(spark, sf):
    schema = read_table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@register("idle_sessions_stream", _GAPS + """
SELECT * FROM ss WHERE epoch_us(last_event) + CAST(7200000000 AS BIGINT)
  < (SELECT epoch_us(max(ts)) FROM events) - CAST(600000000 AS BIGINT)""")
def idle_sessions_stream(spark, sf):
    """Append mode: sessions closed by the 10-minute watermark."""
    out, ck = scratch_path(spark, "sessions"), scratch_path(spark, "sessions-ck")
    S.run_to_parquet(S.idle_sessions_stream(_events_stream(spark, sf)), out, ck, "append")
    return rounded(spark.read.parquet(out))


@register("stream_counters", """SELECT user_id, event_type, count(*) AS events FROM events
GROUP BY user_id, event_type""")
def stream_counters(spark, sf):
    out, ck = scratch_path(spark, "counters"), scratch_path(spark, "counters-ck")
    S.run_to_parquet(S.stream_counters(_events_stream(spark, sf)), out, ck, "update")
    return S.latest_per_key(spark.read.parquet(out), ["user_id", "event_type"])
