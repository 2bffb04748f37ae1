"""Checked queries for D1-D3."""

from __future__ import annotations

from itertools import combinations

from quarry.operators import correlate as C
from quarry.registry import register, rounded
from quarry.registry.sqlgen import lit, numeric, union_all
from quarry.session import read_table


def _pairs_sql(table: str, cols: list[str], source: str) -> str:
    parts = []
    for i, j in combinations(range(len(cols)), 2):
        a, b = cols[i], cols[j]
        parts.append(
            f"SELECT {i} AS a_ord, {lit(a)} AS a, {j} AS b_ord, {lit(b)} AS b, "
            f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r, "
            f"count(CASE WHEN {b} IS NOT NULL THEN {a} END) AS n FROM {source}")
    return union_all(parts)


_LI = numeric("lineitem")


@register("corr_matrix", "SELECT a_ord, a, b_ord, b, round(r, 4) AS r, n FROM ("
          + _pairs_sql("lineitem", _LI, "lineitem") + ") t")
def corr_matrix(spark, sf):
    return rounded(C.correlation_matrix(read_table(spark, sf, "lineitem")), 4)


_COMPLETE = "(SELECT * FROM lineitem WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _LI) + ")"


@register("corr_highlights", f"""SELECT a, b, round(abs_r, 4) AS abs_r,
  printf('Corr: %s <-> %s (|r|=%.2f)', a, b, abs_r) AS text
FROM (SELECT *, abs(r) AS abs_r FROM ({_pairs_sql('lineitem', _LI, _COMPLETE)}) m
      WHERE abs(r) < 1.0 ORDER BY abs_r DESC, a_ord, b_ord LIMIT 5) t""")
def corr_highlights(spark, sf):
    return rounded(C.correlation_highlights(read_table(spark, sf, "lineitem")), 4)


def _trend_sql(table, x, y):
    xd, yd = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
    return (f"SELECT round(regr_slope({yd}, {xd}), 6) AS slope, "
            f"round(regr_intercept({yd}, {xd}), 6) AS intercept, "
            f"round(regr_r2({yd}, {xd}), 6) AS r2, CAST(regr_count({yd}, {xd}) AS BIGINT) AS n "
            f"FROM {table}")


@register("linear_trend", _trend_sql("lineitem", "l_quantity", "l_extendedprice"))
def linear_trend(spark, sf):
    return rounded(C.linear_trend(read_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@register("linear_trend_part", _trend_sql("part", "p_size", "p_retailprice"))
def linear_trend_part(spark, sf):
    return rounded(C.linear_trend(read_table(spark, sf, "part"), "p_size", "p_retailprice"))
