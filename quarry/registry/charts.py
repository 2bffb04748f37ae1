"""Checked queries for F1-F9."""

from __future__ import annotations

from itertools import combinations

from quarry.operators import charts as CH
from quarry.registry import register, rounded
from quarry.registry.sqlgen import categorical, lit, numeric, union_all
from quarry.registry.views import DIRTY_ORDERS_COLS, DIRTY_ORDERS_SQL, dirty_orders
from quarry.session import read_table

_INT_COLS = {"event_id", "user_id", "doc_id", "n_chars", "l_orderkey", "l_partkey",
             "l_suppkey", "l_linenumber"}


def _hist_sql(source: str, cols: list[str], fixed_bins: int | None) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        if fixed_bins:
            nb = f"CAST({fixed_bins} AS BIGINT)"
        else:
            is_int = "TRUE" if c in _INT_COLS else "FALSE"
            nb = (f"CAST(greatest(1, ceil((mx - mn) / CASE WHEN {is_int} AND w0 < 1 "
                  f"THEN 1.0 ELSE w0 END)) AS BIGINT)")
        parts.append(f"""SELECT * FROM (
WITH s AS (SELECT count({x}) AS n, min({x}) AS mn, max({x}) AS mx,
                  quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {source}),
w AS (SELECT *, CASE WHEN fd > 0 THEN least(fd, st) ELSE st END AS w0 FROM (
        SELECT *, (mx - mn) / (log2(n) + 1.0) AS st, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd
        FROM s) z),
p AS (SELECT mn, mx, CASE WHEN mx = mn THEN CAST(1 AS BIGINT) ELSE {nb} END AS nb FROM w WHERE n > 0),
bins AS (SELECT p.*, r.range AS bin FROM p, range(p.nb) r),
cnt AS (SELECT CAST(CASE WHEN p.mx = p.mn THEN 0 ELSE
          least(floor(({x} - p.mn) * p.nb / (p.mx - p.mn)), p.nb - 1) END AS BIGINT) AS bin,
          count(*) AS c FROM {source}, p WHERE {x} IS NOT NULL GROUP BY 1)
SELECT {i} AS ord, {lit(c)} AS column_name, bins.bin,
  round(CASE WHEN mx = mn THEN mn - 0.5 ELSE mn + bins.bin * ((mx - mn) / nb) END, 6) AS lo,
  round(CASE WHEN mx = mn THEN mx + 0.5 WHEN bins.bin = nb - 1 THEN mx
             ELSE mn + (bins.bin + 1) * ((mx - mn) / nb) END, 6) AS hi,
  CAST(coalesce(cnt.c, 0) AS BIGINT) AS count
FROM bins {"LEFT JOIN" if fixed_bins else "JOIN"} cnt ON bins.bin = cnt.bin) t{i}""")
    return union_all(parts)


@register("hist_auto", _hist_sql("events", numeric("events"), None))
def hist_auto(spark, sf):
    return rounded(CH.histogram_auto(read_table(spark, sf, "events")))


@register("hist_auto_documents", _hist_sql("documents", numeric("documents"), None))
def hist_auto_documents(spark, sf):
    return rounded(CH.histogram_auto(read_table(spark, sf, "documents")))


@register("hist_10", _hist_sql("lineitem", numeric("lineitem"), 10))
def hist_10(spark, sf):
    return rounded(CH.histogram_fixed(read_table(spark, sf, "lineitem"), bins=10))


# finite values, with both infinities planted among them
_INF_SQL = """inf_events AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'inf'::double
  WHEN event_id % 89 = 0 THEN '-inf'::double ELSE value END AS v, user_id::double AS u FROM events)"""


def _inf_events(spark, sf):
    from pyspark.sql import functions as F
    k = F.col("event_id")
    return read_table(spark, sf, "events").select(
        F.when(k % 97 == 0, float("inf")).when(k % 89 == 0, float("-inf")).otherwise(F.col("value")).alias("v"), F.col("user_id").cast("double").alias("u"))


@register("hist_infinite", f"""WITH {_INF_SQL},
p AS (SELECT min(v) FILTER (isfinite(v)) AS mn, max(v) FILTER (isfinite(v)) AS mx FROM inf_events),
b AS (SELECT CASE WHEN v = 'inf' THEN 8 WHEN v = '-inf' THEN -1 ELSE least(floor((v - mn) * 8 / (mx - mn)), 7) END::bigint AS bin,
        count(*) AS c FROM inf_events, p GROUP BY 1),
every AS (SELECT bin, c FROM b UNION ALL SELECT range, 0 FROM range(8))
SELECT 0 AS ord, 'v' AS column_name, bin,
  CASE WHEN bin = -1 THEN '-inf'::double WHEN bin = 8 THEN 'inf'::double ELSE round(mn + bin * ((mx - mn) / 8), 6) END AS lo,
  CASE WHEN bin = -1 THEN '-inf'::double WHEN bin = 8 THEN 'inf'::double WHEN bin = 7 THEN round(mx, 6)
       ELSE round(mn + (bin + 1) * ((mx - mn) / 8), 6) END AS hi, sum(c)::bigint AS count
FROM every, p GROUP BY bin, mn, mx""")
def hist_infinite(spark, sf):
    return rounded(CH.histogram_fixed(_inf_events(spark, sf), ["v"], bins=8))


@register("hist_auto_infinite", f"""WITH {_INF_SQL}, fin AS (SELECT v FROM inf_events WHERE isfinite(v)),
s AS (SELECT count(*) AS n, min(v) AS mn, max(v) AS mx, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM fin),
w AS (SELECT *, (mx - mn) / (log2(n) + 1.0) AS st, 2.0 * iqr * pow(n, -1.0 / 3.0) AS fd FROM s),
p AS (SELECT mn, mx, greatest(1, ceil((mx - mn) / CASE WHEN fd > 0 THEN least(fd, st) ELSE st END))::bigint AS nb FROM w),
b AS (SELECT CASE WHEN v = 'inf' THEN nb WHEN v = '-inf' THEN -1 ELSE least(floor((v - mn) * nb / (mx - mn)), nb - 1) END::bigint AS bin,
        count(*) AS c FROM inf_events, p GROUP BY 1)
SELECT 0 AS ord, 'v' AS column_name, bin,
  CASE WHEN bin = -1 THEN '-inf'::double WHEN bin = nb THEN 'inf'::double ELSE round(mn + bin * ((mx - mn) / nb), 6) END AS lo,
  CASE WHEN bin = -1 THEN '-inf'::double WHEN bin = nb THEN 'inf'::double WHEN bin = nb - 1 THEN round(mx, 6)
       ELSE round(mn + (bin + 1) * ((mx - mn) / nb), 6) END AS hi, c AS count FROM b, p""")
def hist_auto_infinite(spark, sf):
    return rounded(CH.histogram_auto(_inf_events(spark, sf), ["v"]))


@register("pair_bins_infinite", f"""WITH {_INF_SQL},
p AS (SELECT min(v) FILTER (isfinite(v)) AS mn, max(v) FILTER (isfinite(v)) AS mx, min(u) AS un, max(u) AS ux FROM inf_events)
SELECT 0 AS a_ord, 'v' AS a, 1 AS b_ord, 'u' AS b,
  CASE WHEN v = 'inf' THEN 10 WHEN v = '-inf' THEN -1 ELSE least(floor((v - mn) * 10 / (mx - mn)), 9) END::int AS bin_x,
  least(floor((u - un) * 10 / (ux - un)), 9)::int AS bin_y, count(*) AS count FROM inf_events, p GROUP BY ALL""")
def pair_bins_infinite(spark, sf):
    return CH.pair_bins(_inf_events(spark, sf), ["v", "u"], 10)


@register("kde_curve", """WITH s AS (SELECT count(value) AS n, stddev_samp(value) AS sd,
  min(value) AS lo, max(value) AS hi FROM events),
p AS (SELECT *, sd * pow(n, -0.2) AS h, (hi - lo) / 199 AS step FROM s)
SELECT CAST(g.range AS INTEGER) AS point, round(lo + g.range * step, 6) AS x,
  round(sum(exp(-0.5 * pow(((lo + g.range * step) - e.value) / h, 2)))
        * (1.0 / (n * h * sqrt(2 * pi()))), 10) AS density, CAST(n AS BIGINT) AS n
FROM events e, p, range(200) g WHERE e.value IS NOT NULL
GROUP BY g.range, lo, step, n, h""")
def kde_curve(spark, sf):
    from pyspark.sql import functions as F
    k = CH.kde_curve(read_table(spark, sf, "events"), "value")
    return k.select("point", F.round("x", 6).alias("x"), F.round("density", 10).alias("density"), "n")


def _bar_sql() -> str:
    parts = [f"SELECT {i} AS ord, {lit(c)} AS column_name, count({c}) AS present, "
             f"round(count({c}) / count(*), 6) AS share FROM dirty_orders"
             for i, c in enumerate(DIRTY_ORDERS_COLS)]
    return f"WITH {DIRTY_ORDERS_SQL}\n" + union_all(parts)


@register("missing_bar", _bar_sql())
def missing_bar(spark, sf):
    return rounded(CH.missingness_bar(dirty_orders(spark, sf)))


def _matrix_sql() -> str:
    n = len(DIRTY_ORDERS_COLS)
    flags = [f"CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END" for c in DIRTY_ORDERS_COLS]
    complete = "(" + " + ".join(flags) + f") / {float(n)}"
    parts = [f"""SELECT band, {i} AS ord, {lit(c)} AS column_name, count(*) AS rows,
  round(avg({flags[i]}), 6) AS present_share, round(avg({complete}), 6) AS row_completeness
FROM b GROUP BY band""" for i, c in enumerate(DIRTY_ORDERS_COLS)]
    return f"""WITH {DIRTY_ORDERS_SQL},
k AS (SELECT min(CAST(o_orderkey AS DOUBLE)) AS lo, max(CAST(o_orderkey AS DOUBLE)) AS hi FROM dirty_orders),
b AS (SELECT d.*, CAST(least(floor((CAST(o_orderkey AS DOUBLE) - k.lo) * 20.0 / (k.hi - k.lo + 1.0)), 19)
      AS INTEGER) AS band FROM dirty_orders d, k)
""" + union_all(parts)


@register("missing_matrix", _matrix_sql())
def missing_matrix(spark, sf):
    return rounded(CH.missingness_matrix(dirty_orders(spark, sf), "o_orderkey", 20))


def _bars_sql() -> str:
    long = union_all([f"SELECT {i} AS ord, {lit(c)} AS column_name, CAST({c} AS VARCHAR) AS value "
                      "FROM orders" for i, c in enumerate(categorical("orders"))])
    return f"""WITH vc AS (SELECT ord, column_name, value, count(*) AS count FROM ({long}) t
  WHERE value IS NOT NULL GROUP BY ord, column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY count DESC, value ASC) AS rf,
             row_number() OVER (PARTITION BY ord ORDER BY count ASC, value DESC) AS rl FROM vc)
SELECT ord, column_name, value, count,
  CASE WHEN rf = 1 THEN 'green' WHEN rl = 1 THEN 'red' ELSE 'yellow' END AS color FROM r"""


@register("category_bars", _bars_sql())
def category_bars(spark, sf):
    return CH.category_bars(read_table(spark, sf, "orders"))


def _box_sql(source: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT {i} AS ord, {lit(c)} AS column_name, round(min({x}), 6) AS min,
  round(any_value(b.q1), 6) AS q1, round(quantile_cont({x}, 0.5), 6) AS median,
  round(any_value(b.q3), 6) AS q3, round(max({x}), 6) AS max,
  round(min(CASE WHEN {x} >= b.lo AND {x} <= b.hi THEN {x} END), 6) AS whisker_low,
  round(max(CASE WHEN {x} >= b.lo AND {x} <= b.hi THEN {x} END), 6) AS whisker_high,
  count(CASE WHEN {x} < b.lo OR {x} > b.hi THEN 1 END) AS fliers
FROM {source}, (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
  (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {source}) s) b""")
    return union_all(parts)


@register("box_stats", _box_sql("events", numeric("events")))
def box_stats(spark, sf):
    return rounded(CH.box_stats(read_table(spark, sf, "events")))


_PAIR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pair_sql() -> str:
    rng = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(_PAIR_COLS))

    def b(i):
        c = _PAIR_COLS[i]
        return (f"CAST(CASE WHEN hi{i} = lo{i} THEN 0 ELSE least(floor((CAST({c} AS DOUBLE) - lo{i}) "
                f"* 10.0 / (hi{i} - lo{i})), 9) END AS INTEGER)")
    parts = [f"SELECT {i} AS a_ord, {lit(_PAIR_COLS[i])} AS a, {j} AS b_ord, {lit(_PAIR_COLS[j])} AS b, "
             f"{b(i)} AS bin_x, {b(j)} AS bin_y FROM lineitem, r "
             f"WHERE {_PAIR_COLS[i]} IS NOT NULL AND {_PAIR_COLS[j]} IS NOT NULL"
             for i, j in combinations(range(len(_PAIR_COLS)), 2)]
    return (f"WITH r AS (SELECT {rng} FROM lineitem)\nSELECT a_ord, a, b_ord, b, bin_x, bin_y, count(*) AS count "
            f"FROM ({union_all(parts)}) t GROUP BY a_ord, a, b_ord, b, bin_x, bin_y")


@register("pair_bins", _pair_sql())
def pair_bins(spark, sf):
    return CH.pair_bins(read_table(spark, sf, "lineitem"), _PAIR_COLS, 10)


@register("sample_exact")
def sample_exact(spark, sf):
    """Rows-only: the hash order has no DuckDB twin; invariants in tests."""
    return CH.sample_rows(read_table(spark, sf, "orders"), 1000, ["o_orderkey"], seed=42)


@register("pair_sample")
def pair_sample(spark, sf):
    """Rows-only: seeded sample of the numeric lineitem columns."""
    return CH.pair_sample(read_table(spark, sf, "lineitem"), 500,
                          ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], _PAIR_COLS)


@register("violin_kde", """WITH s AS (SELECT event_type, count(value) AS n, stddev_samp(value) AS sd,
  min(value) AS lo, max(value) AS hi FROM events WHERE value IS NOT NULL GROUP BY event_type),
p AS (SELECT *, sd * pow(n, -0.2) AS h, (hi - lo) / 199 AS step FROM s WHERE sd > 0 AND hi > lo)
SELECT p.event_type, CAST(g.range AS INTEGER) AS point, round(lo + g.range * step, 6) AS x,
  round(sum(exp(-0.5 * pow(((lo + g.range * step) - e.value) / h, 2)))
        * (1.0 / (n * h * sqrt(2 * pi()))), 10) AS density, CAST(n AS BIGINT) AS n
FROM events e JOIN p ON e.event_type = p.event_type, range(200) g WHERE e.value IS NOT NULL
GROUP BY p.event_type, g.range, lo, step, n, h""")
def violin_kde(spark, sf):
    from pyspark.sql import functions as F
    k = CH.kde_by_group(read_table(spark, sf, "events"), "value", "event_type")
    return k.select("event_type", "point", F.round("x", 6).alias("x"),
                    F.round("density", 10).alias("density"), "n")


@register("hist_auto_sampled")
def hist_auto_sampled(spark, sf):
    """Rows-only: F1 on an exact seeded 5 000-row sample of lineitem (the
    hash order has no DuckDB twin)."""
    return CH.histogram_auto(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"],
                             sample=5000, key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
