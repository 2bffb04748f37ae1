"""Sketch brackets against NumPy: skew, ties, infinities, empty columns, brackets that miss."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import quantiles as Q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    rows = [(rng.gauss(0, 1), rng.choice([1.0, 1.0, 1.0, 2.0, 7.0]), float(10 ** rng.randint(-300, 300)) * rng.choice([-1, 1]),
             rng.choice([None, 3.5]), 5.0 if rng.random() < 0.34 else rng.random(), None, rng.choice([-1e308, 1e308, 0.0, -0.0, 1.0]))
            for _ in range(20_000)]
    names = ["normal", "ties", "wide", "one", "hot", "empty", "huge"]
    return names, rows, spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(6).cache()


def check(names, rows, got):
    for j, name in enumerate(names):
        xs = sorted(r[j] for r in rows if r[j] is not None)
        assert got[name]["count"] == len(xs)
        for p in PROBS:
            if not xs:
                assert got[name]["q"][p] is None
                continue
            lo, hi, share = Q._ranks(len(xs), p)
            assert got[name]["q"][p] == (xs[lo] + (xs[hi] - xs[lo]) * share if lo != hi else xs[lo]), (name, p)


def test_every_rank(table):
    names, rows, df = table
    got = Q.column_profile(df, {n: F.col(n) for n in names}, PROBS)
    check(names, rows, got)
    xs = np.array([r[0] for r in rows])
    assert got["normal"]["std"] == pytest.approx(xs.std(ddof=1)) and got["normal"]["min"] == xs.min()


def test_brackets_that_miss(table, monkeypatch):
    names, rows, df = table
    cut = Q._disjoint
    monkeypatch.setattr(Q, "_disjoint", lambda spans: [(lo, lo) for lo, _ in cut(spans)][:1])
    check(names, rows, Q.column_profile(df, {n: F.col(n) for n in names}, PROBS))


def test_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in [-inf] * 30 + [inf] * 40 + [float(i) for i in range(50)]], "x double")
    q = Q.exact_quantiles(df, {"x": F.col("x")}, [0.1, 0.5, 0.9])
    want = sorted([-inf] * 30 + [inf] * 40 + [float(i) for i in range(50)])
    assert q[("x", 0.1)] == -inf and q[("x", 0.9)] == inf
    assert q[("x", 0.5)] == (want[59] + want[60]) / 2


def test_two_scans_and_what_is_kept(spark):
    df = spark.range(400_000).select(F.xxhash64("id").cast("double").alias("x"))
    values = {"x": F.col("x")}
    kept = []
    real = Q.materialize

    def once(d, name):
        t = real(d, name)
        kept.append(t.where("zone % 2 = 1").count())
        return t

    Q.materialize = once
    try:
        got = Q.exact_quantiles(df, values, [0.25, 0.5, 0.75])
    finally:
        Q.materialize = real
    assert len(kept) == 1 and kept[0] < 400_000 * 0.06
    want = df.agg(F.percentile("x", F.array(F.lit(.25), F.lit(.5), F.lit(.75)))).first()[0]
    assert [got[("x", p)] for p in (0.25, 0.5, 0.75)] == pytest.approx(want, rel=1e-12)
