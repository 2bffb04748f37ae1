"""Quantiles per group against NumPy."""

import math

import numpy as np
import pytest

from quarry.operators.group_quantiles import group_quantiles

SHARES = {"p0": 0.0, "p10": 0.1, "med": 0.5, "p99": 0.99, "p100": 1.0}


def check(df, rows, keys=("g",)):
    got = {r["g"]: r for r in group_quantiles(df, list(keys), "v", SHARES).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([] if v is None or math.isnan(v) else [v])
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        for name, p in SHARES.items():
            assert got[g][name] == (pytest.approx(np.quantile(vs, p), rel=1e-12) if vs else None), (g, name)


def test_groups_of_all_kinds(spark):
    rng = np.random.default_rng(11)
    rows = [("hot", float(v)) for v in rng.normal(100, 1e-6, 6000)] + [("wide", float(v)) for v in np.exp(rng.normal(0, 40, 3000))]
    rows += [("ties", float(v)) for v in rng.integers(0, 3, 2000)] + [("mixed", float(v)) for v in rng.normal(0, 1e300, 500)]
    rows += [(None, float(v)) for v in rng.uniform(-1, 1, 900)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), ("none", float("nan"))]
    rows += [(f"g{i}", float(v)) for i in range(60) for v in rng.exponential(3, i % 7 + 1)]
    check(spark.createDataFrame(rows, "g string, v double").repartition(7), rows)


def test_infinite_values(spark):
    rows = [("a", -math.inf), ("a", 1.0), ("a", math.inf), ("b", math.inf), ("b", math.inf)]
    got = {r["g"]: r for r in group_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"lo": 0.0, "med": 0.5, "hi": 1.0}).collect()}
    assert tuple(got["a"])[2:] == (-math.inf, 1.0, math.inf)
    assert tuple(got["b"])[2:] == (math.inf, math.inf, math.inf)


def test_whole_numbers_and_two_keys(spark):
    df = spark.range(4000).selectExpr("id % 2 as `a.b`", "id % 3 = 0 as c", "id as v")
    for r in group_quantiles(df, ["a.b", "c"], "v", {"med": 0.5}).collect():
        vs = [i for i in range(4000) if i % 2 == r["a.b"] and (i % 3 == 0) == r["c"]]
        assert (r["n"], r["med"]) == (len(vs), float(np.median(vs)))


def test_no_value_map_and_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert group_quantiles(df, ["g"], "v", {"med": 0.5}).count() == 0
    plan = group_quantiles(spark.range(50).selectExpr("id % 2 as g", "id as v"), ["g"], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan
