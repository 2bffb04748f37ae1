"""Fingerprints: order-free, exact on copies, nulls and swapped cells; only unequal buckets are compared."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import fingerprint as FP
from quarry.operators.transform import table_diff

SCHEMA = "id int, `a.b` string, b string, x double, d date, tags array<string>, m map<string,int>"


def rows(n=200):
    return [(i, None if i % 7 == 0 else f"s{i % 5}", f"t{i % 3}", float(i) if i % 4 else -0.0, dt.date(2020, 1, 1 + i % 28),
             ["x", None] if i % 2 else None, {"k": i}) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4).cache()


def test_order_and_files_do_not_matter(table):
    again = table.orderBy(F.desc("x")).withColumn("x", F.when(F.col("x") == 0, 0.0).otherwise(F.col("x")))
    assert FP.equal_tables(table, again).first().asDict() == {
        "left_rows": 200, "right_rows": 200, "unequal_buckets": 0, "equal": True}
    assert FP.changed_rows(table, again, ["id"]).count() == 0
    plan = FP.equal_tables(table, again)._jdf.queryExecution().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("edit,only_left,only_right,columns", [
    (lambda r: r[:-1], 1, 0, None),                                                    # a row gone
    (lambda r: r + [r[5], r[5]], 0, 2, None),                                          # copies
    (lambda r: [(*t[:1], "new", *t[2:]) if t[0] == 14 else t for t in r], 1, 1, {"a.b"}),   # null to value
    (lambda r: [(t[0], t[2], t[1], *t[3:]) if t[0] == 8 else t for t in r], 1, 1, {"a.b", "b"}),   # cells swapped in a row
    (lambda r: [(t[0], *r[{3: 4, 4: 3}.get(t[0], t[0])][1:]) for t in r], 2, 2, {"a.b", "b", "x", "d", "tags", "m"}),  # rows swapped
])
def test_changes(spark, table, edit, only_left, only_right, columns):
    other = spark.createDataFrame(edit(rows()), SCHEMA)
    assert not FP.equal_tables(table, other).first()["equal"]
    for keys in (["id"], None, ["b"]):
        got = FP.changed_rows(table, other, keys, buckets=16).agg(F.sum("only_left"), F.sum("only_right")).first()
        assert tuple(got) == (only_left, only_right)
    if columns:
        found = FP.changed_columns(table, other, ["id"]).where("buckets > 0").collect()
        assert {r["column_name"] for r in found} == columns


def test_same_as_signed_aggregate(spark):
    a = spark.range(3000).select((F.col("id") % 50).alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    b = a.where("v <> '3' or k > 40").unionAll(a.where("k = 2"))
    want = table_diff(a, b).first()
    got = FP.changed_rows(a, b, ["k"]).agg(F.sum("only_left").alias("l"), F.sum("only_right").alias("r")).first()
    assert (got["l"], got["r"]) == (want["only_left"], want["only_right"])


def test_empty_and_different(spark, table):
    none = table.where("id < 0")
    assert FP.equal_tables(none, none).first()["equal"]
    assert FP.equal_tables(none, table).first().asDict()["left_rows"] == 0
    assert FP.changed_rows(none, table).count() == 200
    with pytest.raises(ValueError):
        FP.equal_tables(table, table.drop("b"))
