"""Checked queries for J1, J2."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.fingerprint import changed_columns, changed_rows, equal_tables
from quarry.operators.transform import apply_transform, table_diff
from quarry.session import read_table
from quarry.registry import register


def _fn(df):
    return df.where(F.col("o_totalprice") > 100000).withColumn(
        "o_totalprice", F.round(F.col("o_totalprice") * 1.1, 2))


@register("apply_transform", """SELECT count(*) AS rows, true AS changed FROM orders
WHERE o_totalprice > 100000""")
def apply_transform_q(spark, sf):
    _, _, summary = apply_transform(read_table(spark, sf, "orders"), _fn, ["o_orderkey"])
    return summary


@register("apply_transform_preview", """SELECT o_orderkey, o_custkey, o_orderstatus,
  round(o_totalprice * 1.1, 2) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 10""")
def apply_transform_preview(spark, sf):
    _, preview, _ = apply_transform(read_table(spark, sf, "orders"), _fn, ["o_orderkey"])
    return preview


@register("table_diff", """SELECT (SELECT count(*) FROM orders) AS left_rows,
  (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') + (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
    AS right_rows,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS only_left,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS only_right, false AS equal""")
def table_diff_q(spark, sf):
    o = read_table(spark, sf, "orders")
    b = o.where("o_orderstatus <> 'P'").unionAll(o.where("o_orderstatus = 'F'"))
    return table_diff(o, b)


@register("fingerprint_equal", """SELECT count(*) AS left_rows, count(*) AS right_rows,
  CAST(0 AS BIGINT) AS unequal_buckets, true AS equal FROM lineitem""")
def fingerprint_equal(spark, sf):
    """The same rows in another order and other files."""
    li = read_table(spark, sf, "lineitem")
    return equal_tables(li, li.where("l_quantity > 25").unionAll(li.where("l_quantity <= 25 OR l_quantity IS NULL")))


def _edited(orders):
    """Prices of some customers changed, cancelled orders gone, urgent ones twice."""
    price = F.when(F.col("o_custkey") == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = orders.withColumn("o_totalprice", price).where("o_orderstatus <> 'P'")
    return kept.unionAll(kept.where("o_orderpriority = '1-URGENT'"))


_EDITED = """kept AS (SELECT * REPLACE (CASE WHEN o_custkey = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
  FROM orders WHERE o_orderstatus <> 'P'),
edited AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE o_orderpriority = '1-URGENT')"""


@register("fingerprint_changes", f"""WITH {_EDITED},
both_sides AS (SELECT *, 1 AS l, 0 AS r FROM orders UNION ALL SELECT *, 0 AS l, 1 AS r FROM edited)
SELECT * EXCLUDE (l, r), CAST(greatest(sum(l) - sum(r), 0) AS BIGINT) AS only_left,
  CAST(greatest(sum(r) - sum(l), 0) AS BIGINT) AS only_right
FROM both_sides GROUP BY ALL HAVING sum(l) <> sum(r)""")
def fingerprint_changes(spark, sf):
    o = read_table(spark, sf, "orders")
    return changed_rows(o, _edited(o), ["o_orderkey"])


@register("fingerprint_columns", """SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS ord, column_name,
  column_name = 'o_totalprice' AND (SELECT count(*) > 0 FROM orders WHERE o_custkey = 7) AS changed
FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name)""")
def fingerprint_columns(spark, sf):
    """Only the edited column differs."""
    o = read_table(spark, sf, "orders")
    price = F.when(F.col("o_custkey") == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    found = changed_columns(o, o.withColumn("o_totalprice", price), ["o_orderkey"])
    return found.select("ord", "column_name", (F.col("buckets") > 0).alias("changed"))
