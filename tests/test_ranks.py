"""Windows over ranges against Spark's own windows on small tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import ranks as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(i, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "c"]), rng.choice([None, 1, 2, 3, 5]),
             rng.choice([None, -4, 10, 25])) for i in range(1500)]
    return spark.createDataFrame(data, "id long, `k.x` string, v int, amount int").repartition(5)


def both(df, got, names):
    key = lambda r: r["id"]
    a, b = sorted(got.collect(), key=key), sorted(df.collect(), key=key)
    assert [[r[n] for n in ["id", *names]] for r in a] == [[r[n] for n in ["id", *names]] for r in b]


def test_windows_of_keys(rows):
    w = Window.partitionBy("`k.x`").orderBy(F.desc("v"), "id")
    want = rows.select("*", F.row_number().over(w).alias("rn"), F.ntile(7).over(w).alias("t7"), F.ntile(900).over(w).alias("t900"),
                       F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
                       F.count("*").over(Window.partitionBy("`k.x`")).alias("n"))
    got = R.arrange(rows, [("v", "desc"), "id"], ["k.x"], ranges=9).with_windows("rn", {"t7": 7, "t900": 900}, {"run": "amount"}, "n")
    assert got.columns == [*rows.columns, "rn", "t7", "t900", "run", "n"]
    both(want, got, ["k.x", "v", "amount", "rn", "t7", "t900", "run", "n"])


def test_windows_of_the_whole_table(rows):
    w = Window.orderBy("v", "id")
    want = rows.select("*", F.row_number().over(w).alias("rn"), F.ntile(11).over(w).alias("t"),
                       F.sum("amount").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    got = R.arrange(rows, ["v", "id"], ranges=6).with_windows("rn", {"t": 11}, {"run": "amount"})
    both(want, got, ["v", "rn", "t", "run"])
    plan = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("keys", [[], ["k.x"]])
def test_ranks_of_ties(rows, keys):
    w = (Window.partitionBy("`k.x`") if keys else Window.partitionBy()).orderBy(F.desc("v"))
    want = rows.select("*", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"))
    both(want, R.tie_ranks(rows, [("v", "desc")], keys, ranges=4), ["k.x", "v", "rank", "dense_rank"])


def test_pages_of_any_depth(rows):
    arranged = R.arrange(rows, ["v", "id"], ranges=7)
    want = [r["id"] for r in rows.orderBy("v", "id").collect()]
    for no, size in ((0, 10), (3, 400), (149, 10), (2, 1000), (0, 5000)):
        assert [r["id"] for r in arranged.page(no, size).collect()] == want[no * size:no * size + size]
    assert R.page_at(rows, 9, 1000, ["id"]).count() == 0
    with pytest.raises(ValueError, match="without keys"):
        R.arrange(rows, ["id"], ["k.x"]).page(0, 1)
    with pytest.raises(ValueError, match="neither"):
        R.arrange(rows, [("id", "up")])


def test_empty_table(rows):
    none = R.arrange(rows.limit(0), ["id"])
    assert none.with_windows("rn", {"t": 3}, {"s": "amount"}).count() == 0
    assert none.page(0, 5).count() == 0
    assert R.arrange(rows.limit(0), ["id"], ["k.x"]).with_windows("rn", total="n").count() == 0
