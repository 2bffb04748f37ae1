"""Cleaning semantics (B1-B16) on tiny frames."""

import math

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions.parsing import to_numeric
from quarry.operators import clean as CL
from quarry.plans.clean_plan import CleanPlan, smart_clean


def test_numeric_grammar(spark):
    cases = {"1d": None, "1f": None, "1,000": None, "$5": None, "12%": None, "0x1A": None,
             "1_000": None, "1e3": 1000.0, "inf": math.inf, " 12 ": 12.0, ".5": 0.5, "+3": 3.0,
             "-2.5E-1": -0.25, "Infinity": math.inf}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["v"] for r in df.select("s", to_numeric(F.col("s")).alias("v")).collect()}
    assert got == cases


def test_tokens_become_null_and_trim(spark):
    toks = ["na", "N/A", "none", "NULL", "nan", "missing", "Unknown", "", "  ", "\tok "]
    df = spark.createDataFrame([(t,) for t in toks], "s string")
    out = [r["s"] for r in CL.trim_strings(CL.nullify_tokens(df)).collect()]
    assert out == [None] * 9 + ["ok"]


def test_numeric_share_boundary(spark):
    eight = [str(i) for i in range(8)] + ["x", "y"]          # exactly 0.8 -> stays text
    nine = [str(i) for i in range(9)] + ["x"]                # 0.9 -> converted
    df = spark.createDataFrame(list(zip(eight, nine)), "a string, b string")
    plan = CleanPlan.fit(df)
    assert plan.numeric_from_text == ["b"]
    out = plan.apply(df)
    assert dict(out.dtypes) == {"a": "string", "b": "bigint"}
    assert sorted([r["b"] for r in out.collect()], key=lambda v: (v is None, v)) == list(range(9)) + [None]


def test_all_null_dropped_before_tokens(spark):
    df = spark.createDataFrame([(None, "unknown", "1"), (None, "unknown", "2")],
                               "empty string, tok string, Unnamed_x string")
    plan = CleanPlan.fit(df)
    assert plan.dropped_all_null == ["empty"]
    out = plan.apply(df)
    assert "tok" in out.columns and out.where("tok IS NOT NULL").count() == 0


def test_unnamed_columns_dropped(spark):
    df = spark.createDataFrame([("a", "b")], "`Unnamed: 1` string, keep string")
    assert CleanPlan.fit(df).apply(df).columns == ["keep"]


def test_dates_by_name_and_width_rule(spark):
    df = spark.createDataFrame([("2020-01-02", "wide"), ("x", "narrow")],
                               "order_date string, width string")
    out = CleanPlan.fit(df).apply(df).collect()
    assert str(out[0]["order_date"]) == "2020-01-02 00:00:00" and out[1]["order_date"] is None
    assert out[0]["width"] == "wide" and out[1]["width"] == "narrow"   # "dt" in "width", but no cell is a date


def test_month_first_format(spark):
    df = spark.createDataFrame([("03/04/2020",), ("12/31/2020",)], "day string")
    out = CleanPlan.fit(df).apply(df).collect()
    assert str(out[0]["day"]) == "2020-03-04 00:00:00"


def test_narrow_integral_doubles(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, None)], "a double, b double")
    out = CleanPlan.fit(df).apply(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double"}


def test_plan_is_reusable_and_idempotent(spark):
    df = spark.createDataFrame([(" 1 ", "na"), ("2", "x")], "n string, t string")
    plan = CleanPlan.fit(df)
    again = CleanPlan.from_json(plan.to_json())
    assert again == plan
    once = plan.apply(df)
    assert CleanPlan.fit(once).apply(once).collect() == once.collect()


def test_display_range(spark):
    df = spark.createDataFrame([tuple(range(8))], ", ".join(f"c{i} int" for i in range(8)))
    _, disp, _ = smart_clean(df, max_display_cols=5)
    assert disp.columns == ["c0", "c1", "c2", "c3", "c4"]


def test_clean_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, `a-b` int, `  X ` int")
    assert CL.clean_column_names(df).columns == ["a_b", "a_b_1", "x"]


def test_fill_mode_smallest_of_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "s string")
    out = CL.fill_missing(df, "mode", ["s"])
    assert sorted(r["s"] for r in out.collect()) == ["a", "a", "a", "b", "b"]


def test_fill_mode_numeric_order(spark):
    df = spark.createDataFrame([(10,), (9,), (None,)], "n bigint")
    assert sorted(r["n"] for r in CL.fill_missing(df, "mode", ["n"]).collect()) == [9, 9, 10]


def test_mean_fill_of_integers_becomes_double(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n bigint")
    out = CL.fill_missing(df, "mean", ["n"])
    assert sorted(r["n"] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_forward_fill_blocks_match_pandas(spark):
    pdf = pd.DataFrame({"k": range(200), "v": [float(i) if i % 7 == 0 else None for i in range(200)]})
    pdf.loc[0, "v"] = None
    df = spark.createDataFrame(pdf)
    got = CL.forward_fill(df, ["v"], ["k"]).orderBy("k").toPandas()
    want = pdf.assign(v=pdf["v"].ffill())
    assert got["v"].isna().tolist() == want["v"].isna().tolist()
    assert got["v"].fillna(-1).tolist() == want["v"].fillna(-1).tolist()


def test_drop_sparse_and_flag(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, 3)], "a int, b int")
    assert CL.drop_sparse_columns(df, 0.5).columns == ["a"]
    assert CL.flag_missing(df).columns == ["a", "b", "a_missing", "b_missing"]
