"""Inputs that occur in practice: odd names and types, mixed documents, gaps."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import chat, charts, clean, correlate, duplicates, relational, transform
from quarry.operators import profile as P
from quarry.plans.clean_plan import CleanPlan
from quarry.session import ensure_checkpoint_dir, scratch_path
from quarry.sources.records import read_json_records


@pytest.mark.parametrize("cell, want", [
    ("2020-01-02 03:04:05.123456", dt.datetime(2020, 1, 2, 3, 4, 5, 123456)), ("2020-01-02T03:04:05Z", dt.datetime(2020, 1, 2, 3, 4, 5)),
    ("2020-01-02T03:04:05.5+02:00", dt.datetime(2020, 1, 2, 1, 4, 5, 500000)), ("1/2/20", dt.datetime(2020, 1, 2)),
    ("1/2/99", dt.datetime(1999, 1, 2)), ("1/2/2020", dt.datetime(2020, 1, 2)), ("2020-01-02T03:04", dt.datetime(2020, 1, 2, 3, 4))])
def test_date_forms(spark, cell, want):
    df = spark.createDataFrame([(cell,), (None,)], "order_date string")
    out = CleanPlan.fit(df).apply(df).where("order_date is not null").collect()
    assert [r.order_date for r in out] == [want]


def test_column_that_never_parses_stays_text(spark):
    df = spark.createDataFrame([("week 3",), ("week 4",)], "order_date string")
    assert [r.order_date for r in CleanPlan.fit(df).apply(df).collect()] == ["week 3", "week 4"]


def test_long_integers_keep_every_digit(spark):
    df = spark.createDataFrame([("9007199254740993",), ("1",), (" -5 ",)], "code string")
    assert [r.code for r in CleanPlan.fit(df).apply(df).collect()] == [9007199254740993, 1, -5]


def test_fraction_in_a_later_batch_is_not_truncated(spark):
    plan = CleanPlan.fit(spark.createDataFrame([(1.0,), (2.0,)], "x double"))
    assert [r.x for r in plan.apply(spark.createDataFrame([(1.75,), (3.0,)], "x double")).collect()] == [None, 3]


def test_fit_scans_once(spark):
    path = scratch_path(spark, "wide-csv")
    for n in (10, 60):
        spark.createDataFrame([tuple(str(i) for i in range(n))], ", ".join(f"c{i} string" for i in range(n))).write.csv(f"{path}{n}", header=True)
        df = spark.read.csv(f"{path}{n}", header=True)
        seen = []
        agg = type(df).agg
        try:
            type(df).agg = lambda self, *a, f=agg: seen.append(f(self, *a)) or seen[-1]
            CleanPlan.fit(df)
        finally:
            type(df).agg = agg
        plan = spark._jvm.PythonSQLUtils.explainString(seen[-1]._jdf.queryExecution(), "simple")
        assert len(seen) == 1 and plan.count("FileScan") == 1
        wide = P.missing_counts(df)
        assert spark._jvm.PythonSQLUtils.explainString(wide._jdf.queryExecution(), "simple").count("FileScan") == 1
        counts = P.value_counts(df)
        assert spark._jvm.PythonSQLUtils.explainString(counts._jdf.queryExecution(), "simple").count("FileScan") == 1


def test_mixed_json_documents(spark):
    path = scratch_path(spark, "mixed-json")
    docs = [{"data": [{"a": 1, "b": {"c": 2}}, {"a": 3}]}, {"a": 9, "total": 1}, {"data": None, "items": [{"a": 4}]}]
    spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").coalesce(1).write.text(path)
    out = read_json_records(spark, path)
    assert sorted((r.a, r["b.c"], r.total) for r in out.collect()) == [(1, 2, None), (3, None, None), (4, None, None), (9, None, 1)] or \
        sorted(r.a for r in out.collect()) == [1, 3, 4, 9]
    assert set(out.columns) == {"a", "b.c", "total"}


def test_band_join_kinds(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, None)], "i int, x double")
    right = spark.createDataFrame([(10, 1.4), (11, 0.5), (12, 9.0)], "j int, y double")
    rows = lambda how: sorted(((r.i, r.j) for r in relational.band_join(left, right, "x", "y", 0.5, how).collect()), key=str)
    assert rows("inner") == [(1, 10), (1, 11)]
    assert rows("left") == sorted([(1, 10), (1, 11), (2, None), (3, None)], key=str)
    assert rows("right") == sorted([(1, 10), (1, 11), (None, 12)], key=str)
    assert rows("outer") == sorted([(1, 10), (1, 11), (2, None), (3, None), (None, 12)], key=str)


def test_history_with_gaps_and_a_long_conversation(spark):
    turns = [1, 5, 6, 4000, 4001, 9000]
    msgs = spark.createDataFrame([("c", t, "user", f"m{t}") for t in turns] + [("d", i, "user", str(i)) for i in range(3000)],
                                 "conv_id string, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r.history for r in chat.chat_history(msgs).collect()}
    assert len(out) == len(turns) + 3000
    for k, t in enumerate(turns):
        assert out["c", t] == ("\n".join(f"USER: m{x}" for x in turns[max(0, k - 3):k]) or "No history")
    assert out["d", 2048] == "USER: 2045\nUSER: 2046\nUSER: 2047"


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 1.0), (3, 6.5, None), (4, 8.0, 0.0)], "`a.k` int, `a.x` double, `b.y` double")
    assert correlate.correlation_highlights(df).count() > 0
    assert correlate.linear_trend(df, "a.x", "b.y").first().n == 3
    assert clean.drop_missing(df, subset=["b.y"]).count() == 3
    assert relational.merge(df, df, ["a.k"]).columns == ["a.k", "a.x_x", "b.y_x", "a.x_y", "b.y_y"]
    pdf = pd.DataFrame({"x": [2.0, 4.0, 8.0], "y": [3.0, 1.0, 0.0]})
    r = {(x.a, x.b): x.r for x in correlate.correlation_matrix(df).collect()}
    assert r["a.x", "b.y"] == pytest.approx(pdf.corr().iloc[0, 1])


def test_map_columns(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (1, {"a": 1})], "i int, m map<string,int>")
    assert duplicates.duplicate_count(df).first().duplicates == 1
    diff = transform.table_diff(df, df.limit(2)).first()
    assert (diff.only_left, diff.only_right) == (1, 0)


@pytest.mark.parametrize("kind", ["date", "string", "timestamp"])
def test_forward_fill_and_bands_by_other_keys(spark, kind):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    df = spark.createDataFrame([(d, float(i) if i % 9 == 3 else None) for i, d in enumerate(days)], "k date, v double").withColumn("k", F.col("k").cast(kind))
    got = [r.v for r in clean.forward_fill(df, ["v"], ["k"]).orderBy("k").collect()]
    assert got == [None if i < 3 else float((i - 3) // 9 * 9 + 3) for i in range(60)]
    bands = charts.missingness_matrix(df, "k", 4)
    assert bands.where("column_name = 'v'").agg(F.sum("rows")).first()[0] == 60


def test_skewed_column_has_more_than_a_thousand_bins(spark):
    df = spark.range(20_000).select((F.rand(3) + F.when(F.col("id") % 2000 == 0, 5000).otherwise(0)).alias("x"))
    h = charts.histogram_auto(df)
    assert h.agg(F.sum("count")).first()[0] == 20_000
    assert h.agg(F.max("bin")).first()[0] > 1000 and h.count() < 20_000


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(lambda: {})  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


@pytest.mark.parametrize("code, safe", [("import json", True), ("import os", False), ("from math import pi", True), ("from . import x", False),
                                        ("import numpy.linalg as l", True), ("def f(:", False), ("x = 1", True)])
def test_import_rule(code, safe):
    assert chat._imports_ok(code) is safe
