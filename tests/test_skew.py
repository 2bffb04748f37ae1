"""Hot-key inputs (one key holds a third of the rows): the skew-safe code
paths must give the same answers as the direct formulations."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import chat as H
from quarry.operators import clean as CL
from quarry.operators import duplicates as D
from quarry.streaming import sessions as S


def test_hot_conversation_history(spark):
    rows = [(0, t, "user", f"hot {t}") for t in range(300)] + \
           [(c, t, "assistant", f"m{c}.{t}") for c in range(1, 101) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["history"] for r in H.chat_history(df).collect()}
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    ref = df.select("conv_id", "turn", F.coalesce(F.nullif(F.array_join(F.collect_list(
        F.concat(F.upper("role"), F.lit(": "), "text")).over(w), "\n"), F.lit("")),
        F.lit("No history")).alias("h"))
    assert got == {(r["conv_id"], r["turn"]): r["h"] for r in ref.collect()}


def test_hot_user_sessions(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(minutes=7 * i), 1.0) for i in range(3000)]
    rows += [(u, base + dt.timedelta(hours=3 * i + u), 2.0) for u in range(2, 60) for i in range(100)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double")
    got = sorted((r["user_id"], r["session_start"], r["n_events"])
                 for r in S.idle_sessions(df, bucket_seconds=3600).collect())
    w = Window.partitionBy("user_id").orderBy("ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = df.withColumn("p", F.lag(us).over(w)).withColumn(
        "new", F.when(F.col("p").isNull() | (us - F.col("p") > 7200 * 10 ** 6), 1).otherwise(0)) \
        .withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = sorted((r["user_id"], r["s"], r["n"]) for r in g.groupBy("user_id", "g").agg(
        F.min("ts").alias("s"), F.count("*").alias("n")).collect())
    assert got == want


def test_hot_duplicate_group(spark):
    rows = [("hot", 1)] * 2000 + [(f"k{i}", i) for i in range(1000)] + [("k1", 1)]
    df = spark.createDataFrame(rows, "k string, v long")
    r = D.duplicate_count(df).first()
    assert (r["rows"], r["distinct_rows"], r["duplicates"]) == (3001, 1001, 2000)
    assert D.duplicate_rows(df).count() == 2002
    kept = D.drop_duplicates(df.withColumn("t", F.monotonically_increasing_id()), ["k"], ["t"])
    assert kept.count() == 1001


def test_forward_fill_hot_block(spark):
    rows = [(i, float(i) if i % 100 == 0 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r["k"]: r["v"] for r in CL.forward_fill(df, ["v"], ["k"]).collect()}
    assert all(got[i] == float(i - i % 100) for i in range(5000))
