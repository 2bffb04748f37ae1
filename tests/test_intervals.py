"""Interval joins and bitmap counts against the plain definitions."""

import random

import pytest

from quarry.operators.intervals import interval_join
from quarry.operators.relational import distinct_counts_bitmap


def rows(rng, n):
    out = []
    for i in range(n):
        s = rng.uniform(-50, 50) if rng.random() < 0.7 else float(rng.randrange(-5, 5))
        size = rng.choice([0.0, 0.0, 1e-6, 0.3, 1.0, 7.0, 1e3, 1e9, -1.0])
        out.append((i, rng.choice(["a", "a", "b", None]), None if rng.random() < 0.05 else s, s + size))
    out += [(n, "a", 0.0, float("inf")), (n + 1, "a", float("nan"), 1.0), (n + 2, "a", 0.0, None)] + out[:3]
    return out


def meets(x, y, closed):
    ends = [x[2], x[3], y[2], y[3]]
    if any(e is None or e != e or abs(e) == float("inf") for e in ends) or None in (x[1], y[1]) or x[1] != y[1]:
        return False
    a, b, c, d = ends
    if closed:
        return a <= b and c <= d and a <= d and c <= b
    return a < b and c < d and a < d and c < b


@pytest.mark.parametrize("closed", [True, False])
def test_all_kinds_equal_the_definition(spark, closed):
    rng = random.Random(4)
    ls, rs = rows(rng, 90), rows(rng, 70)
    left = spark.createDataFrame(ls, "i long, k string, ls double, le double")
    right = spark.createDataFrame(rs, "j long, k string, rs double, re double")
    join = lambda how: interval_join(left, right, ("ls", "le"), ("rs", "re"), ["k"], how, closed)
    pairs = sorted((x[0], y[0]) for x in ls for y in rs if meets(x, y, closed))
    alone = sorted(x[0] for x in ls if not any(meets(x, y, closed) for y in rs))
    assert len(pairs) > 200 and sorted((r.i, r.j) for r in join("inner").collect()) == pairs
    got = join("left")
    assert got.columns == ["i", "k", "ls", "le", "j", "rs", "re"]
    assert sorted((r.i, r.j) for r in got.where("j is not null").collect()) == pairs
    assert sorted(r.i for r in got.where("j is null").collect()) == alone
    assert sorted(r.i for r in join("anti").collect()) == alone
    assert sorted(r.i for r in join("semi").collect()) == sorted(x[0] for x in ls if x[0] not in alone)


def test_empty_sides_points_and_names(spark):
    schema = "i long, a timestamp_ntz, b timestamp_ntz"
    left = spark.sql("select 1L i, timestamp_ntz'2020-01-01' a, timestamp_ntz'2020-01-01' b")
    right = left.selectExpr("i j", "a c", "b d")
    assert interval_join(left, right, ("a", "b"), ("c", "d")).count() == 1
    assert interval_join(left, right, ("a", "b"), ("c", "d"), closed=False).count() == 0
    none = spark.createDataFrame([], schema).selectExpr("i j", "a c", "b d")
    assert [interval_join(left, none, ("a", "b"), ("c", "d"), how=h).count() for h in ("inner", "left", "semi", "anti")] == [0, 1, 0, 1]
    with pytest.raises(ValueError, match="both sides"):
        interval_join(left, left, ("a", "b"), ("a", "b"))


def test_one_interval_over_everything_is_no_multiplied_row(spark):
    """A third of the left rows span the whole axis; the number of posted rows doesn't follow their length."""
    from quarry.operators import intervals as I
    left = spark.range(300).selectExpr("id i", "if(id % 3 = 0, 0D, id * 1e6) ls", "if(id % 3 = 0, 1e12, id * 1e6 + 2) le")
    right = spark.range(300).selectExpr("id j", "id * 1e6 rs", "id * 1e6 + 1 re")
    got = interval_join(left, right, ("ls", "le"), ("rs", "re"))
    assert got.count() == 100 * 300 + 200
    a = I._measured(left, "ls", "le", [], True, "l")
    assert I._posted(a, [0, 1, 40], False, False, "_lf").count() <= 300 * 2 * 3
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_pairs_of_one_cell_are_dealt_to_several_tasks(spark):
    """All rows share one cell, and no two are equal; before, one task had all pairs."""
    from pyspark.sql import functions as F
    left = spark.range(8000).selectExpr("id i", "0D ls", "1D le").unionByName(spark.sql("select -1L i, 5D ls, 6D le"))
    right = spark.range(6000).selectExpr("id j", "0.25D rs", "0.5D re")
    pairs = interval_join(left, right, ("ls", "le"), ("rs", "re"), how="left").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in pairs) == 8000 * 6000 + 1
    assert max(r["count"] for r in pairs) <= 8000 * 6000 / 2


@pytest.mark.parametrize("closed", [True, False])
def test_grids_of_chunks_give_every_pair_once(spark, closed, monkeypatch):
    from quarry.operators import intervals as I
    monkeypatch.setattr(I, "CHUNK", 9)
    monkeypatch.setattr(I, "PER_TASK", 50)
    rng = random.Random(8)
    ls, rs = rows(rng, 80), rows(rng, 60)
    ls += [(200, "a", 0.0, 1.0)] * 9
    rs += [(200, "a", 0.0, 1.0)] * 7
    left = spark.createDataFrame(ls, "i long, k string, ls double, le double")
    right = spark.createDataFrame(rs, "j long, k string, rs double, re double")
    got = interval_join(left, right, ("ls", "le"), ("rs", "re"), ["k"], "inner", closed)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[0], y[0]) for x in ls for y in rs if meets(x, y, closed))


def test_whether_a_row_meets_anything_across_ranges(spark):
    """One interval from the first range reaches rows in the last one, per key and without keys."""
    left = spark.range(400).selectExpr("id i", "id % 2 k", "id * 10D ls", "id * 10D + 2 le")
    right = spark.createDataFrame([(0, 1.0, 3000.0), (1, 5.0, 6.0), (0, 3902.0, 3902.5)], "k long, rs double, re double")
    for closed, touching in ((True, 1), (False, 0)):
        assert interval_join(left, right, ("ls", "le"), ("rs", "re"), ["k"], "semi", closed).count() == 150 + touching + touching
        anti = interval_join(left.drop("k"), right.drop("k"), ("ls", "le"), ("rs", "re"), how="anti", closed=closed)
        assert anti.count() == 400 - 300 - touching - touching


def test_bitmap_counts(spark):
    df = spark.createDataFrame([(1, -5), (1, 40000), (None, -40000), (2**40, -5), (2**62, None)], "a long, b int")
    assert tuple(distinct_counts_bitmap(df, ["a", "b"]).first()) == (3, 3)
    assert tuple(distinct_counts_bitmap(df.limit(0), ["a", "b"]).first()) == (0, 0)
    with pytest.raises(ValueError, match="whole numbers"):
        distinct_counts_bitmap(df.selectExpr("cast(a as double) a"), ["a"])
