"""Checked queries for C1-C13 (profiling)."""

from __future__ import annotations


from quarry.operators import profile as P
from quarry.operators.heavy import heavy_hitters
from quarry.operators.ranks import page_at
from quarry.registry import register, rounded
from quarry.registry.sqlgen import categorical, lit, numeric, union_all
from quarry.registry.views import DIRTY_ORDERS_COLS, DIRTY_ORDERS_SQL, dirty_orders
from quarry.session import read_table


def _describe_sql(table: str) -> str:
    parts = []
    for i, c in enumerate(numeric(table)):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS ord, {lit(c)} AS column_name, count({x}) AS count, "
            f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, "
            f"round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS p25, "
            f"round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, "
            f"round(max({x}), 6) AS max FROM {table}")
    return union_all(parts)


@register("describe_lineitem", _describe_sql("lineitem"))
def describe_lineitem(spark, sf):
    return rounded(P.describe_numeric(read_table(spark, sf, "lineitem")))


@register("describe_documents", _describe_sql("documents"))
def describe_documents(spark, sf):
    return rounded(P.describe_numeric(read_table(spark, sf, "documents")))


def _ts_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        m = f"CAST(epoch_us({c}) AS DOUBLE)"

        def back(e):
            return f"make_timestamp(CAST(floor({e}) AS BIGINT))"
        parts.append(
            f"SELECT {i} AS ord, {lit(c)} AS column_name, count({m}) AS count, "
            f"{back(f'avg({m})')} AS mean, {back(f'min({m})')} AS min, "
            f"{back(f'quantile_cont({m}, 0.25)')} AS p25, {back(f'quantile_cont({m}, 0.5)')} AS p50, "
            f"{back(f'quantile_cont({m}, 0.75)')} AS p75, {back(f'max({m})')} AS max FROM {table}")
    return union_all(parts)


@register("describe_ts", _ts_sql("events", ["ts"]))
def describe_ts(spark, sf):
    return P.describe_datetime(read_table(spark, sf, "events"))


@register("shape_lineitem",
          "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def shape_lineitem(spark, sf):
    return P.shape(read_table(spark, sf, "lineitem"))


def _missing_sql() -> str:
    parts = [f"SELECT {i} AS ord, {lit(c)} AS column_name, count(*) - count({c}) AS missing, "
             f"count({c}) AS present FROM dirty_orders"
             for i, c in enumerate(DIRTY_ORDERS_COLS)]
    return f"WITH {DIRTY_ORDERS_SQL}\n" + union_all(parts)


@register("missing_counts", _missing_sql())
def missing_counts(spark, sf):
    return P.missing_counts(dirty_orders(spark, sf))


def _missing_only_sql() -> str:
    return union_all([f"SELECT {i} AS ord, {lit(c)} AS column_name, count(*) - count({c}) AS missing "
                      "FROM dirty_orders" for i, c in enumerate(DIRTY_ORDERS_COLS)])


@register("missing_summary", f"""WITH {DIRTY_ORDERS_SQL},
m AS ({_missing_only_sql()})
SELECT CAST(sum(missing) AS BIGINT) AS total_missing,
       CASE WHEN sum(missing) > 0 THEN
         string_agg(CASE WHEN missing > 0 THEN column_name || ': ' || CAST(missing AS VARCHAR) END,
                    ', ' ORDER BY ord)
       END AS summary
FROM m""")
def missing_summary(spark, sf):
    return P.missing_summary(dirty_orders(spark, sf))


def _vc_long(table: str, cols: list[str]) -> str:
    return union_all([f"SELECT {i} AS ord, {lit(c)} AS column_name, CAST({c} AS VARCHAR) AS value "
                      f"FROM {table}" for i, c in enumerate(cols)])


@register("value_counts_all", f"""SELECT ord, column_name, value, count(*) AS count
FROM ({_vc_long('lineitem', categorical('lineitem'))}) t
WHERE value IS NOT NULL GROUP BY ord, column_name, value""")
def value_counts_all(spark, sf):
    return P.value_counts(read_table(spark, sf, "lineitem"))


def _top_sql(table: str, cols: list[str], k: int) -> str:
    return f"""WITH vc AS (SELECT ord, column_name, value, count(*) AS count
  FROM ({_vc_long(table, cols)}) t GROUP BY ord, column_name, value),
per AS (SELECT ord, column_name, sum(count) AS total_rows, count(value) AS n_values
  FROM vc GROUP BY ord, column_name),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ord, column_name
  ORDER BY count DESC, value ASC) AS INTEGER) AS rank FROM vc WHERE value IS NOT NULL)
SELECT r.ord, r.column_name, r.rank, r.value, r.count,
  round(CAST(r.count AS DOUBLE) * 100 / CAST(per.total_rows AS DOUBLE), 1) AS pct,
  CAST(greatest(per.n_values - {k}, 0) AS BIGINT) AS remaining
FROM r JOIN per ON r.ord = per.ord AND r.column_name = per.column_name WHERE r.rank <= {k}"""


@register("top_values_pct", _top_sql("documents", categorical("documents"), 5))
def top_values_pct(spark, sf):
    return P.top_values(read_table(spark, sf, "documents"), 5)


@register("top_values_heavy", f"""WITH t AS ({_top_sql('documents', categorical('documents'), 5)})
SELECT ord, column_name, rank, value, count FROM t""")
def top_values_heavy(spark, sf):
    return heavy_hitters(read_table(spark, sf, "documents"), 5).drop("proof")


@register("top_category", f"""WITH t AS ({_top_sql('customer', categorical('customer'), 1)})
SELECT ord, column_name, value, count FROM t""")
def top_category(spark, sf):
    return P.top_category(read_table(spark, sf, "customer"))


def _numsum_sql(table: str) -> str:
    return union_all([
        f"SELECT {i} AS ord, {lit(c)} AS column_name, round(min(CAST({c} AS DOUBLE)), 6) AS min, "
        f"round(max(CAST({c} AS DOUBLE)), 6) AS max, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
        f"count({c}) AS count FROM {table}" for i, c in enumerate(numeric(table)[:12])])


@register("numeric_summary", _numsum_sql("lineitem"))
def numeric_summary(spark, sf):
    return rounded(P.numeric_summary(read_table(spark, sf, "lineitem")))


@register("head_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def head_sample(spark, sf):
    return P.head_sample(read_table(spark, sf, "orders"), 5, ["o_orderkey"])


@register("page_3", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 150")
def page_3(spark, sf):
    return P.page(read_table(spark, sf, "orders"), 3, 50, ["o_orderkey"])


@register("page_deep", """SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber
LIMIT 70 OFFSET 70 * 77""")
def page_deep(spark, sf):
    return page_at(read_table(spark, sf, "lineitem"), 77, 70, [("l_extendedprice", "desc"), "l_orderkey", "l_linenumber"])


@register("page_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM orders")
def page_count(spark, sf):
    return P.page_count(read_table(spark, sf, "orders"), 50)


@register("page_keyset", "SELECT * FROM orders WHERE o_orderkey > 7000 ORDER BY o_orderkey LIMIT 50")
def page_keyset(spark, sf):
    return P.page_after(read_table(spark, sf, "orders"), "o_orderkey", 7000, 50)
