"""Profiling, correlation, outliers, duplicates, charts vs pandas/NumPy."""

import numpy as np
import pandas as pd
import pytest

from quarry.operators import charts as CH
from quarry.operators.density import error_bound
from quarry.operators import correlate as C
from quarry.operators import duplicates as D
from quarry.operators import outliers as O
from quarry.operators import profile as P


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"x": rng.normal(size=300), "y": rng.integers(0, 20, 300).astype("int64"),
                        "s": rng.choice(["a", "b", "c", None], 300)})
    pdf.loc[::17, "x"] = np.nan
    return pdf


def test_describe_matches_pandas(spark, frame):
    got = {r["column_name"]: r for r in P.describe_numeric(spark.createDataFrame(frame)).collect()}
    want = frame[["x", "y"]].describe().T
    for c in ("x", "y"):
        for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert got[c][ours] == pytest.approx(want.loc[c, theirs], rel=1e-9)


def test_missing_counts_nan_is_missing(spark, frame):
    got = {r["column_name"]: r["missing"] for r in P.missing_counts(spark.createDataFrame(frame)).collect()}
    assert got == {c: int(frame[c].isna().sum()) for c in frame.columns}


def test_value_counts_and_top(spark, frame):
    df = spark.createDataFrame(frame)
    got = {r["value"]: r["count"] for r in P.value_counts(df, ["s"]).collect()}
    assert got == frame["s"].value_counts().to_dict()
    top = P.top_values(df, 2, ["s"]).orderBy("rank").collect()
    vc = frame["s"].value_counts()
    assert top[0]["value"] == vc.index[0]
    assert top[0]["pct"] == round(vc.iloc[0] * 100 / len(frame), 1)
    assert top[0]["remaining"] == 1


def test_mode_smallest_wins(spark):
    df = spark.createDataFrame([("Sales",), ("Engineering",), ("Sales",), ("Engineering",),
                                ("Marketing",)], "department string")
    assert P.top_category(df).first()["value"] == "Engineering"


def test_constant_column_correlation_and_zscore(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, k double")
    r = C.correlation_matrix(df).first()
    assert r["r"] is None
    z = {x["column_name"]: x["outliers"] for x in O.outliers_zscore(df).collect()}
    assert z == {"a": 0, "k": 0}


def test_correlation_matches_pandas(spark, frame):
    got = C.correlation_matrix(spark.createDataFrame(frame), ["x", "y"]).first()["r"]
    assert got == pytest.approx(frame["x"].corr(frame["y"]), rel=1e-9)


def test_iqr_matches_pandas(spark, frame):
    got = {r["column_name"]: r["outliers"] for r in O.outliers_iqr(spark.createDataFrame(frame)).collect()}
    for c in ("x", "y"):
        s = frame[c]
        q1, q3 = s.quantile(.25), s.quantile(.75)
        assert got[c] == int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())


def test_zscore_matches_numpy(spark):
    vals = list(range(50)) + [1000]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    a = np.array(vals, float)
    want = int((np.abs((a - a.mean()) / a.std()) > 3).sum())
    assert O.outliers_zscore(df).first()["outliers"] == want


def test_duplicates_null_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a"), (3, "b")], "k int, s string")
    r = D.duplicate_count(df).first()
    assert (r["rows"], r["distinct_rows"], r["duplicates"]) == (6, 3, 3)
    assert D.duplicate_rows(df).count() == 5
    pdf = df.toPandas()
    assert r["duplicates"] == int(pdf.duplicated().sum())


def test_drop_duplicates_keep_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "x")], "k int, t int, v string")
    got = sorted((r["k"], r["v"]) for r in D.drop_duplicates(df, ["k"], ["t"]).collect())
    assert got == [(1, "a"), (2, "x")]


def test_histogram_right_edge_and_sum(spark, frame):
    df = spark.createDataFrame(frame)
    h = CH.histogram_fixed(df, ["x"], 10).orderBy("bin").collect()
    assert len(h) == 10
    assert sum(r["count"] for r in h) == int(frame["x"].notna().sum())
    np_counts, _ = np.histogram(frame["x"].dropna(), bins=10)
    assert [r["count"] for r in h] == np_counts.tolist()


def test_histogram_auto_matches_numpy(spark, frame):
    df = spark.createDataFrame(frame[["x"]])
    h = CH.histogram_auto(df).orderBy("bin").collect()
    counts, _ = np.histogram(frame["x"].dropna(), bins="auto")
    assert [r["count"] for r in h] == counts.tolist()


def test_constant_histogram_one_bin(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "v double")
    h = CH.histogram_fixed(df, ["v"], 10).collect()
    assert len(h) == 1 and h[0]["count"] == 4


def test_kde_matches_formula(spark):
    vals = np.array([0.0, 1.0, 1.5, 4.0])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = CH.kde_curve(df, "v", points=5).orderBy("point").collect()
    h = vals.std(ddof=1) * len(vals) ** -0.2
    for r in got:
        want = np.exp(-0.5 * ((r["x"] - vals) / h) ** 2).sum() / (len(vals) * h * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want, rel=1e-9)


def test_sample_rows_exact_and_deterministic(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = [r["k"] for r in CH.sample_rows(df, 123, ["k"]).collect()]
    b = [r["k"] for r in CH.sample_rows(df, 123, ["k"]).collect()]
    assert len(a) == 123 and len(set(a)) == 123 and a == b


def test_category_bars_colors(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",), ("c",)], "s string")
    got = {r["value"]: r["color"] for r in CH.category_bars(df).collect()}
    assert got == {"c": "green", "a": "yellow", "b": "red"}


def test_wide_profile_job_count_is_fixed(spark):
    """One scan per chunk of columns: 150 columns still run as few jobs."""
    cols = ", ".join(f"c{i} double" for i in range(150))
    df = spark.createDataFrame([tuple(float(i + j) for i in range(150)) for j in range(5)], cols)
    out = P.describe_numeric(df)
    assert out.count() == 150


def _density(vals, x):
    h = vals.std(ddof=1) * len(vals) ** -0.2
    return np.exp(-0.5 * ((x - vals) / h) ** 2).sum() / (len(vals) * h * np.sqrt(2 * np.pi)), h


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e6])
def test_curves_within_the_error_bound(spark, scale):
    rng = np.random.default_rng(12)
    groups = {"a": rng.normal(size=3000), "b": rng.gamma(2.0, size=2000), "far": np.concatenate([rng.normal(size=400), [500.0, -90.0]])}
    rows = [(g, float(v) * scale) for g, vs in groups.items() for v in vs]
    rows += [("flat", 3.0), ("flat", 3.0), ("one", 1.0), (None, 1.0), ("a", None), ("a", float("inf")), ("b", float("-inf"))]
    df = spark.createDataFrame(rows, "`g.x` string, v double").repartition(4)
    got = CH.kde_by_group(df, "v", "g.x").collect()
    assert len(got) == 600
    for r in got:
        want, h = _density(groups[r["g.x"]] * scale, r["x"])
        assert abs(r["density"] - want) <= error_bound(h) + 1e-14 / h
        assert error_bound(h) * h < 1e-13


def test_curve_rows_are_cells_not_rows(spark):
    df = spark.range(200_000).selectExpr("sin(id) * 10 as v")
    vals = np.sin(np.arange(200_000)) * 10
    got = CH.kde_curve(df, "v", points=50).collect()
    assert all(abs(r["density"] - _density(vals, r["x"])[0]) < 1e-9 for r in got)
    plan = CH.kde_curve(df, "v", points=50)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan
    assert CH.kde_curve(spark.createDataFrame([(1.0,), (None,)], "v double"), "v").count() == 0


def test_infinite_values_have_bins_of_their_own(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, inf, 7.0), (2.0, -inf, inf), (5.0, inf, None), (inf, None, 7.0), (-inf, None, -inf)], "v double, w double, c double")
    rows = {(r["column_name"], r["bin"]): tuple(r)[3:] for r in CH.histogram_fixed(df, bins=4).collect()}
    assert {k[1]: v for k, v in rows.items() if k[0] == "v"} == {
        -1: (-inf, -inf, 1), 0: (1.0, 2.0, 1), 1: (2.0, 3.0, 1), 2: (3.0, 4.0, 0), 3: (4.0, 5.0, 1), 4: (inf, inf, 1)}
    assert {k[1]: v[2] for k, v in rows.items() if k[0] == "w"} == {-1: 1, 0: 0, 1: 2}
    assert {k[1]: v for k, v in rows.items() if k[0] == "c"} == {-1: (-inf, -inf, 1), 0: (6.5, 7.5, 2), 1: (inf, inf, 1)}
    auto = CH.histogram_auto(df).collect()
    assert sum(r["count"] for r in auto if r["column_name"] == "v") == 5
    assert {r["bin"] for r in auto if r["column_name"] == "w"} == {-1, 1}
    pairs = {(r["a"], r["b"], r["bin_x"], r["bin_y"]): r["count"] for r in CH.pair_bins(df, bins=4).collect()}
    assert pairs == {("v", "w", 0, 1): 1, ("v", "w", 1, -1): 1, ("v", "w", 3, 1): 1, ("v", "c", 0, 0): 1, ("v", "c", 1, 1): 1, ("v", "c", 4, 0): 1,
                     ("v", "c", -1, -1): 1, ("w", "c", 1, 0): 1, ("w", "c", -1, 1): 1}


def test_duplicates_narrow_rows_direct_path(spark):
    rows = [(1, 2.0), (1, 2.0), (None, 1.0), (None, 1.0), (3, None)]
    df = spark.createDataFrame(rows, "a long, b double")
    r = D.duplicate_count(df).first()
    assert (r["rows"], r["distinct_rows"], r["duplicates"]) == (5, 3, 2)
    assert D.duplicate_rows(df).count() == 4


def test_sampled_histogram_and_approx_distinct(spark):
    from quarry.operators import relational as R
    df = spark.range(20000).withColumnRenamed("id", "k").withColumn("v", (F_col("k") % 997).cast("double"))
    h = CH.histogram_auto(df, ["v"], sample=3000, key=["k"]).collect()
    assert sum(r["count"] for r in h) == 3000
    exact = R.distinct_counts(df, ["v"]).first()["v"]
    approx = R.distinct_counts(df, ["v"], approx=True).first()["v"]
    # rsd is a relative standard deviation: allow 4 sigma
    assert exact == 997 and abs(approx - 997) < 4 * 0.05 * 997


def F_col(name):
    from pyspark.sql import functions as F
    return F.col(name)
