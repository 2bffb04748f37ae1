"""Frequent values with proof against plain counts."""

import random
from collections import Counter

import pytest

from quarry.operators.heavy import heavy_hitters


def top(values, k):
    found = Counter(v for v in values if v is not None)
    return sorted(found.items(), key=lambda e: (-e[1], e[0]))[:k]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        hot = "hot" if rng.random() < 0.34 else f"u{i}"
        rows.append((hot, f"unique {i} " + "x" * 300, rng.choice(["a", "b", None, ""]), f"v{i // 2}", None))
    names = ["hot.key", "text", "few", "twice", "empty"]
    return names, rows, spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)).repartition(5)


@pytest.mark.parametrize("k,counters", [(1, 20), (3, 20), (3, 100_000)])
def test_same_as_counts(table, k, counters):
    names, rows, df = table
    got = {}
    for r in heavy_hitters(df, k, counters=counters).orderBy("ord", "rank").collect():
        got.setdefault(r["column_name"], []).append((r["value"], r["count"]))
        if counters > 6000 or (k == 1 and r["column_name"] == "hot.key"):
            assert r["proof"] == "counters"
        elif r["column_name"] in ("text", "twice"):
            assert r["proof"] == "hashes"
    for j, name in enumerate(names):
        assert got.get(name, []) == top([r[j] for r in rows], k), name


def test_no_rows(spark):
    assert heavy_hitters(spark.createDataFrame([], "s string")).count() == 0
    assert heavy_hitters(spark.range(3)).count() == 0
