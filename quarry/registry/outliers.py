"""Checked queries for E1, E2, E4-E6 and B13."""

from __future__ import annotations


from quarry.operators import duplicates as D
from quarry.operators import outliers as O
from quarry.registry import register, rounded
from quarry.registry.sqlgen import TABLES, lit, numeric, union_all
from quarry.registry.views import (DUP_EVENTS_SQL, PLANTED_LINEITEM_SQL, dup_events,
                                   planted_lineitem)
from quarry.session import read_table


def _iqr_sql(source: str, cols: list[str], k: float = 1.5) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT {i} AS ord, {lit(c)} AS column_name, round(q1, 6) AS q1,
  round(q3, 6) AS q3, round(lo, 6) AS lower, round(hi, 6) AS upper,
  (SELECT count(*) FROM {source} WHERE {x} < b.lo OR {x} > b.hi) AS outliers
FROM (SELECT q1, q3, q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi
      FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3
            FROM {source}) s) b""")
    return union_all(parts)


@register("outliers_iqr_documents", _iqr_sql("documents", numeric("documents")))
def outliers_iqr_documents(spark, sf):
    return rounded(O.outliers_iqr(read_table(spark, sf, "documents")))


@register("outliers_iqr_events", _iqr_sql("events", numeric("events")))
def outliers_iqr_events(spark, sf):
    return rounded(O.outliers_iqr(read_table(spark, sf, "events")))


@register("outliers_iqr_planted",
          f"WITH {PLANTED_LINEITEM_SQL}\n" + _iqr_sql("planted_lineitem", numeric("lineitem")))
def outliers_iqr_planted(spark, sf):
    return rounded(O.outliers_iqr(planted_lineitem(spark, sf)))


def _z_sql(source: str, cols: list[str], t: float = 3.0) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT {i} AS ord, {lit(c)} AS column_name,
  CASE WHEN b.s IS NULL OR b.s = 0 THEN CAST(0 AS BIGINT) ELSE
  (SELECT count(*) FROM {source} WHERE abs(({x} - b.m) / b.s) > {t}) END AS outliers
FROM (SELECT avg({x}) AS m, stddev_pop({x}) AS s FROM {source}) b""")
    return union_all(parts)


@register("outliers_zscore_events", _z_sql("events", numeric("events")))
def outliers_zscore_events(spark, sf):
    return O.outliers_zscore(read_table(spark, sf, "events"))


@register("outliers_zscore_documents", _z_sql("documents", numeric("documents")))
def outliers_zscore_documents(spark, sf):
    return O.outliers_zscore(read_table(spark, sf, "documents"))


def _iqr_rows_sql(source: str, cols: list[str], k: float = 1.5) -> str:
    bnds = ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{i}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{i}"
        for i, c in enumerate(cols))
    flags = [f"CAST({c} AS DOUBLE) < q1_{i} - {k} * (q3_{i} - q1_{i}) OR "
             f"CAST({c} AS DOUBLE) > q3_{i} + {k} * (q3_{i} - q1_{i})" for i, c in enumerate(cols)]
    names = ", ".join(f"CASE WHEN {f} THEN {lit(c)} END" for f, c in zip(flags, cols))
    allcols = ", ".join(c for c, _ in TABLES["lineitem"])
    return f"""SELECT * FROM (
  SELECT {allcols}, concat_ws(',', {names}) AS outlier_columns
  FROM {source}, (SELECT {bnds} FROM {source}) b) t WHERE outlier_columns <> ''"""


@register("outlier_rows",
          f"WITH {PLANTED_LINEITEM_SQL}\n" + _iqr_rows_sql("planted_lineitem", numeric("lineitem")))
def outlier_rows(spark, sf):
    return O.outlier_rows(planted_lineitem(spark, sf), "iqr")


_DE = ["event_type", "user_id", "value", "props"]


@register("duplicate_count", f"""WITH {DUP_EVENTS_SQL}
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_events) d) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_events) d) AS duplicates
FROM dup_events""")
def duplicate_count(spark, sf):
    return D.duplicate_count(dup_events(spark, sf))


_DUP_JOIN = " AND ".join(f"d.{c} IS NOT DISTINCT FROM g.{c}" for c in _DE)
_DUP_ROWS = f"""WITH {DUP_EVENTS_SQL},
g AS (SELECT {', '.join(_DE)}, count(*) AS dup_count FROM dup_events
      GROUP BY {', '.join(_DE)} HAVING count(*) > 1)
SELECT d.*, g.dup_count FROM dup_events d JOIN g ON {_DUP_JOIN}"""


@register("duplicate_rows", _DUP_ROWS)
def duplicate_rows(spark, sf):
    return D.duplicate_rows(dup_events(spark, sf))


@register("duplicate_preview", _DUP_ROWS + f"\nORDER BY {', '.join(_DE)} LIMIT 10")
def duplicate_preview(spark, sf):
    return D.duplicate_preview(dup_events(spark, sf), _DE, 10)


@register("dedup_distinct", f"WITH {DUP_EVENTS_SQL}\nSELECT DISTINCT * FROM dup_events")
def dedup_distinct(spark, sf):
    return D.drop_duplicates(dup_events(spark, sf))


@register("dedup_keep_first", """SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
  FROM events) t WHERE rn = 1""")
def dedup_keep_first(spark, sf):
    return D.drop_duplicates(read_table(spark, sf, "events"), ["user_id", "event_type"],
                             ["ts", "event_id"])


def _z_rows_sql(source: str, cols: list[str], t: float = 3.0) -> str:
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{i}, stddev_pop(CAST({c} AS DOUBLE)) AS s{i}"
                      for i, c in enumerate(cols))
    names = ", ".join(f"CASE WHEN s{i} > 0 AND abs((CAST({c} AS DOUBLE) - m{i}) / s{i}) > {t} THEN {lit(c)} END"
                      for i, c in enumerate(cols))
    allcols = ", ".join(c for c, _ in TABLES[source])
    return f"""SELECT * FROM (SELECT {allcols}, concat_ws(',', {names}) AS outlier_columns
  FROM {source}, (SELECT {stats} FROM {source}) b) t WHERE outlier_columns <> ''"""


@register("outlier_rows_zscore", _z_rows_sql("documents", numeric("documents")))
def outlier_rows_zscore(spark, sf):
    return O.outlier_rows(read_table(spark, sf, "documents"), "zscore")
