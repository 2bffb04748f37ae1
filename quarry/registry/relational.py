"""Checked queries for G1-G21 (the SQL/pandas surface)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import ranks as K
from quarry.operators import relational as R
from quarry.operators.group_quantiles import group_quantiles
from quarry.operators.intervals import interval_join
from quarry.plans.clean_plan import smart_clean
from quarry.registry import register, rounded
from quarry.registry.views import dirty_orders
from quarry.session import materialize, read_table


def _t(spark, sf, name):
    return read_table(spark, sf, name)


def _views(spark, sf, names):
    for n in names:
        read_table(spark, sf, n).createOrReplaceTempView(n)


@register("sel_filter", """SELECT l_orderkey, l_linenumber,
  round(l_extendedprice * (1 - l_discount), 6) AS net,
  CAST(l_quantity AS INTEGER) AS qty,
  CASE WHEN l_quantity >= 25 THEN 'big' ELSE 'small' END AS size_class
FROM lineitem
WHERE l_returnflag IN ('R', 'A') AND l_discount BETWEEN 0.02 AND 0.06
  AND l_shipdate IS NOT NULL AND NOT isnan(l_tax) AND l_linestatus LIKE 'F%'""")
def sel_filter(spark, sf):
    li = _t(spark, sf, "lineitem")
    return rounded(li.where(F.col("l_returnflag").isin("R", "A")
                            & F.col("l_discount").between(0.02, 0.06)
                            & F.col("l_shipdate").isNotNull() & ~F.isnan("l_tax")
                            & F.col("l_linestatus").like("F%"))
                   .select("l_orderkey", "l_linenumber",
                           (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
                           F.col("l_quantity").cast("int").alias("qty"),
                           F.when(F.col("l_quantity") >= 25, "big").otherwise("small").alias("size_class")))


@register("join_inner", """SELECT o.o_orderkey, o.o_totalprice, c.c_name, n.n_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def join_inner(spark, sf):
    o, c, n = _t(spark, sf, "orders"), _t(spark, sf, "customer"), _t(spark, sf, "nation")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .select("o_orderkey", "o_totalprice", "c_name", "n_name"))


@register("join_left", """SELECT c.c_custkey, count(o.o_orderkey) AS n_orders,
  round(coalesce(sum(o.o_totalprice), 0), 6) AS spent
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def join_left(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return rounded(c.join(o, o.o_custkey == c.c_custkey, "left").groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("n_orders"),
        F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("spent")))


@register("join_full", """SELECT coalesce(s.s_nationkey, n.n_nationkey) AS nationkey,
  n.n_name, count(s.s_suppkey) AS suppliers
FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s
FULL OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY coalesce(s.s_nationkey, n.n_nationkey), n.n_name""")
def join_full(spark, sf):
    s = _t(spark, sf, "supplier").where("s_acctbal > 0")
    n = _t(spark, sf, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "full")
    return j.groupBy(F.coalesce("s_nationkey", "n_nationkey").alias("nationkey"), "n_name").agg(
        F.count("s_suppkey").alias("suppliers"))


@register("merge_suffixes", """SELECT c.c_custkey, c.c_name, c.c_nationkey,
  c.c_acctbal AS c_acctbal, c.c_mktsegment, s.s_suppkey, s.s_name, s.s_acctbal,
  n.n_name AS n_name_x, n2.n_name AS n_name_y
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN supplier s ON s.s_nationkey = c.c_nationkey
JOIN nation n2 ON s.s_nationkey = n2.n_nationkey
WHERE c.c_acctbal > 9000 AND s.s_acctbal > 9000""")
def merge_suffixes(spark, sf):
    n = _t(spark, sf, "nation").select("n_nationkey", "n_name")
    c = _t(spark, sf, "customer").where("c_acctbal > 9000")
    s = _t(spark, sf, "supplier").where("s_acctbal > 9000")
    left = c.join(n, c.c_nationkey == n.n_nationkey).drop("n_nationkey") \
        .withColumnRenamed("c_nationkey", "nationkey")
    right = s.join(n, s.s_nationkey == n.n_nationkey).drop("n_nationkey") \
        .withColumnRenamed("s_nationkey", "nationkey")
    m = R.merge(left, right, ["nationkey"], "inner")
    return m.withColumnRenamed("nationkey", "c_nationkey")


@register("merge_null_keys", """WITH d AS (SELECT o_orderkey,
  try_strptime(CASE WHEN o_orderkey % 19 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END,
               '%Y-%m-%d') AS order_date_txt FROM orders),
g AS (SELECT order_date_txt, count(*) AS same_day FROM d GROUP BY order_date_txt)
SELECT d.o_orderkey, d.order_date_txt, g.same_day
FROM d JOIN g ON d.order_date_txt IS NOT DISTINCT FROM g.order_date_txt""")
def merge_null_keys(spark, sf):
    full, _, _ = smart_clean(dirty_orders(spark, sf))
    d = full.select("o_orderkey", "order_date_txt")
    g = d.groupBy("order_date_txt").agg(F.count(F.lit(1)).alias("same_day"))
    return R.merge(d, g, ["order_date_txt"], "inner", null_equal=True)


@register("band_join", """SELECT c.c_custkey, s.s_suppkey
FROM customer c JOIN supplier s ON abs(c.c_acctbal - s.s_acctbal) <= 0.5""")
def band_join(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return R.band_join(c, s, "c_acctbal", "s_acctbal", 0.5).select("c_custkey", "s_suppkey")


_BAND = "abs(c.c_acctbal - s.s_acctbal) <= 0.5"


@register("band_join_left", f"SELECT c.c_custkey, s.s_suppkey FROM customer c LEFT JOIN supplier s ON {_BAND}")
def band_join_left(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return R.band_join(c, s, "c_acctbal", "s_acctbal", 0.5, "left").select("c_custkey", "s_suppkey")


@register("band_join_full", f"""SELECT c.c_custkey, s.s_suppkey FROM customer c LEFT JOIN supplier s ON {_BAND}
UNION ALL SELECT NULL, s.s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE {_BAND})""")
def band_join_full(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return R.band_join(c, s, "c_acctbal", "s_acctbal", 0.5, "full").select("c_custkey", "s_suppkey")


_PERIODS = """periods AS (SELECT o_orderkey, o_custkey, least(o_orderdate, min(l_shipdate)) AS opened,
  greatest(o_orderdate, max(l_shipdate)) AS closed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)"""


@register("interval_join", f"""WITH {_PERIODS} SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other
FROM periods a JOIN periods b ON a.o_custkey = b.o_custkey AND a.opened <= b.closed AND b.opened <= a.closed
WHERE a.o_orderkey < b.o_orderkey""")
def interval_join_(spark, sf):
    o, li = _t(spark, sf, "orders"), _t(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    p = o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(
        F.least("o_orderdate", F.min("l_shipdate")).alias("opened"), F.greatest("o_orderdate", F.max("l_shipdate")).alias("closed"))
    p = materialize(p.drop("o_orderdate"), "periods")  # read on both sides
    b = p.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("opened").alias("opened_b"), F.col("closed").alias("closed_b"))
    found = interval_join(p, b, ("opened", "closed"), ("opened_b", "closed_b"), ["o_custkey"])
    return found.where("o_orderkey < other").select("o_custkey", "o_orderkey", "other")


_RANGES = """c AS (SELECT c_custkey, c_acctbal AS c_lo, c_acctbal + c_nationkey * 2 AS c_hi FROM customer),
s AS (SELECT s_suppkey, s_acctbal AS s_lo, s_acctbal + s_suppkey % 7 * 10 AS s_hi FROM supplier)"""
_MEET = "c_lo < s_hi AND s_lo < c_hi AND s_lo < s_hi AND c_lo < c_hi"


def _ranges(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("c_lo"),
                                         (F.col("c_acctbal") + F.col("c_nationkey") * 2).alias("c_hi"))
    s = _t(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("s_lo"),
                                         (F.col("s_acctbal") + F.col("s_suppkey") % 7 * 10).alias("s_hi"))
    return c, s


@register("interval_join_left", f"WITH {_RANGES} SELECT c_custkey, s_suppkey FROM c LEFT JOIN s ON {_MEET}")
def interval_join_left(spark, sf):
    c, s = _ranges(spark, sf)
    return interval_join(c, s, ("c_lo", "c_hi"), ("s_lo", "s_hi"), how="left", closed=False).select("c_custkey", "s_suppkey")


@register("interval_join_anti", f"WITH {_RANGES} SELECT s_suppkey FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE {_MEET})")
def interval_join_anti(spark, sf):
    c, s = _ranges(spark, sf)
    return interval_join(s, c, ("s_lo", "s_hi"), ("c_lo", "c_hi"), how="anti", closed=False).select("s_suppkey")


@register("distinct_counts_bitmap", """SELECT count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_partkey) AS l_partkey,
  count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_linenumber) AS l_linenumber FROM lineitem""")
def distinct_counts_bitmap(spark, sf):
    return R.distinct_counts_bitmap(_t(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@register("dummies_long", """SELECT c_custkey, 'c_mktsegment' AS column_name, c_mktsegment AS category
FROM customer WHERE c_mktsegment IS NOT NULL""")
def dummies_long(spark, sf):
    return R.dummies_long(_t(spark, sf, "customer"), ["c_custkey"], ["c_mktsegment"])


@register("semi_join", """SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)""")
def semi_join(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders").where("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@register("anti_join", """SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def anti_join(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@register("groupby_having", """SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price,
  round(stddev_pop(o_totalprice), 4) AS std_pop, round(stddev_samp(o_totalprice), 4) AS std_samp,
  round(median(o_totalprice), 6) AS med
FROM orders GROUP BY o_custkey HAVING count(*) > 15""")
def groupby_having(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_totalprice")
    g = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"),
        F.round(F.stddev_pop("o_totalprice"), 4).alias("std_pop"),
        F.round(F.stddev_samp("o_totalprice"), 4).alias("std_samp"))
    med = group_quantiles(o, ["o_custkey"], "o_totalprice", {"med": 0.5}).select("o_custkey", F.round("med", 6).alias("med"))
    return g.where("n > 15").join(med, "o_custkey")


@register("group_quartiles", """SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS med,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999
FROM lineitem GROUP BY ALL""")
def group_quartiles(spark, sf):
    return rounded(group_quantiles(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
                                   {"q1": 0.25, "med": 0.5, "q3": 0.75, "p999": 0.999}))


@register("group_quantiles_nulls", """SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS user_key,
  count(CASE WHEN event_id % 10 <> 0 THEN value END) AS n,
  round(quantile_cont(CASE WHEN event_id % 10 <> 0 THEN value END, 0.1), 6) AS p10,
  round(median(CASE WHEN event_id % 10 <> 0 THEN value END), 6) AS med
FROM events GROUP BY 1""")
def group_quantiles_nulls(spark, sf):
    # the null key holds a third of the rows, among many small groups
    ev = _t(spark, sf, "events").select(F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_key"),
                                        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"))
    return rounded(group_quantiles(ev, ["user_key"], "value", {"p10": 0.1, "med": 0.5}))


@register("distinct_count", """SELECT count(DISTINCT o_custkey) AS customers,
  count(DISTINCT o_orderstatus) AS statuses, count(*) AS rows FROM orders""")
def distinct_count(spark, sf):
    return _t(spark, sf, "orders").agg(
        F.count_distinct("o_custkey").alias("customers"),
        F.count_distinct("o_orderstatus").alias("statuses"), F.count(F.lit(1)).alias("rows"))


@register("unique_sorted", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY p_brand")
def unique_sorted(spark, sf):
    return R.unique_sorted(_t(spark, sf, "part"), "p_brand")


@register("topk_offset", """SELECT o_orderkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5""")
def topk_offset(spark, sf):
    return (_t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
            .orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10))


@register("union_all", """SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer
UNION ALL SELECT s_nationkey, 'supplier' FROM supplier""")
def union_all(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"),
                                         F.lit("customer").alias("kind"))
    s = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"),
                                         F.lit("supplier").alias("kind"))
    return c.unionAll(s)


@register("union_distinct", """SELECT c_nationkey AS nationkey FROM customer
UNION SELECT s_nationkey FROM supplier""")
def union_distinct(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return c.union(s).distinct()


@register("intersect_except", """SELECT 'both' AS side, k FROM (
  SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') a
UNION ALL SELECT 'only_f', k FROM (
  SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') b""")
def intersect_except(spark, sf):
    o = _t(spark, sf, "orders")
    f = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    op = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    return (f.intersect(op).select(F.lit("both").alias("side"), "k")
            .unionAll(f.subtract(op).select(F.lit("only_f").alias("side"), "k")))


_CTE = """WITH nat AS (SELECT c_nationkey, avg(c_acctbal) AS avg_bal FROM customer GROUP BY c_nationkey)
SELECT c.c_custkey, c.c_nationkey,
  (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders
FROM customer c JOIN nat ON c.c_nationkey = nat.c_nationkey
WHERE c.c_acctbal > nat.avg_bal
  AND c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_mktsegment = c.c_mktsegment)"""


@register("cte_subquery", _CTE)
def cte_subquery(spark, sf):
    _views(spark, sf, ["customer", "orders"])
    return spark.sql(_CTE)


@register("window_rank", """SELECT c_custkey, c_nationkey,
  CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rnk,
  CAST(dense_rank() OVER w AS INTEGER) AS drnk, CAST(ntile(4) OVER w AS INTEGER) AS quartile
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)""")
def window_rank(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    order = [("c_acctbal", "desc"), "c_custkey"]
    numbered = K.arrange(c, order, ["c_nationkey"]).with_windows("rn", {"quartile": 4})
    return K.tie_ranks(numbered, order, ["c_nationkey"], "rnk", "drnk").select(
        "c_custkey", "c_nationkey", *[F.col(x).cast("int").alias(x) for x in ("rn", "rnk", "drnk", "quartile")])


@register("window_global", """SELECT l_orderkey, l_linenumber, row_number() OVER w AS rn, ntile(1000) OVER w AS tile,
  round(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running
FROM lineitem WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def window_global(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    out = K.arrange(_t(spark, sf, "lineitem").select(*order, "l_quantity"), order).with_windows("rn", {"tile": 1000}, {"running": "l_quantity"})
    return rounded(out.select("l_orderkey", "l_linenumber", "rn", "tile", "running"))


@register("window_hot_key", """SELECT event_id, event_type, row_number() OVER w AS rn, ntile(10) OVER w AS tile,
  count(*) OVER (PARTITION BY event_type) AS n,
  sum(user_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::bigint AS running
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts DESC, event_id)""")
def window_hot_key(spark, sf):
    ev = _t(spark, sf, "events").select("event_id", "event_type", "ts", "user_id")
    return K.arrange(ev, [("ts", "desc"), "event_id"], ["event_type"]).with_windows(
        "rn", {"tile": 10}, {"running": "user_id"}, "n").select("event_id", "event_type", "rn", "tile", "n", "running")


@register("rank_ties", """SELECT l_orderkey, l_linenumber, rank() OVER w AS rnk, dense_rank() OVER w AS drnk
FROM lineitem WINDOW w AS (ORDER BY l_shipdate DESC)""")
def rank_ties(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return K.tie_ranks(li, [("l_shipdate", "desc")], rank="rnk", dense_rank="drnk").drop("l_shipdate")


@register("window_lag_running", """SELECT event_id, user_id,
  lag(value) OVER w AS prev_value, lead(value) OVER w AS next_value,
  round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running,
  round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving3,
  first_value(event_type) OVER w AS first_type,
  last_value(event_type) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_lag_running(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rounded(_t(spark, sf, "events").select(
        "event_id", "user_id", F.lag("value").over(w).alias("prev_value"),
        F.lead("value").over(w).alias("next_value"),
        F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"),
        F.avg("value").over(w.rowsBetween(-2, 0)).alias("moving3"),
        F.first("event_type").over(w).alias("first_type"),
        F.last("event_type").over(w.rowsBetween(Window.unboundedPreceding,
                                                Window.unboundedFollowing)).alias("last_type")))


@register("concat_by_name", """SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal,
  c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def concat_by_name(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                         F.col("c_acctbal").alias("acctbal"),
                                         F.col("c_mktsegment").alias("segment"))
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                                         F.col("s_acctbal").alias("acctbal"))
    return R.concat_tables([c, s])


@register("pivot", """SELECT l_returnflag,
  round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS F,
  round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS O
FROM lineitem GROUP BY l_returnflag""")
def pivot(spark, sf):
    return rounded(R.pivot_table(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus",
                                 "l_quantity", "mean", ["F", "O"]))


@register("melt", """SELECT p_partkey, variable, value FROM (
  SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part
  UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part) t""")
def melt(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"),
                                     "p_retailprice")
    return R.melt(p, ["p_partkey"], ["p_size", "p_retailprice"])


@register("dummies", """SELECT c_custkey,
  CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS c_mktsegment_AUTOMOBILE,
  CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS c_mktsegment_BUILDING,
  CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS c_mktsegment_FURNITURE,
  CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS c_mktsegment_HOUSEHOLD,
  CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS c_mktsegment_MACHINERY
FROM customer""")
def dummies(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return R.get_dummies(c, ["c_mktsegment"])


@register("gen_linspace", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(g.range AS INTEGER) AS i,
  round(CASE WHEN g.range = 10 THEN hi ELSE lo + g.range * ((hi - lo) / 10.0) END, 6) AS x
FROM s, range(11) g""")
def gen_linspace(spark, sf):
    return rounded(R.linspace(_t(spark, sf, "lineitem"), "l_extendedprice", 11))


@register("gen_arange", """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(g.range AS INTEGER) AS i FROM c, range(c.n) g""")
def gen_arange(spark, sf):
    c = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return R.arange_per_group(c, "l_orderkey", "n")


@register("scalar_string", """SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low,
  substr(c_name, 1, 8) AS head, replace(c_name, '#', '-') AS repl, trim('  ' || c_mktsegment || ' ') AS trimmed,
  CAST(length(c_name) AS INTEGER) AS len, concat(c_mktsegment, '/', CAST(c_nationkey AS VARCHAR)) AS combo
FROM customer""")
def scalar_string(spark, sf):
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", F.upper("c_mktsegment").alias("up"), F.lower("c_name").alias("low"),
                    F.substring("c_name", 1, 8).alias("head"),
                    F.replace("c_name", F.lit("#"), F.lit("-")).alias("repl"),
                    F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("trimmed"),
                    F.length("c_name").alias("len"),
                    F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias("combo"))


@register("scalar_date", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym,
  CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon,
  CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow,
  CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_since,
  strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due
FROM orders""")
def scalar_date(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"),
                    F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mon"),
                    F.dayofweek("o_orderdate").alias("dow"),
                    F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("days_since"),
                    F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyy-MM-dd").alias("due"))


@register("scalar_math", """SELECT l_orderkey, l_linenumber, abs(l_extendedprice - 50000) AS dist,
  round(l_extendedprice / 7, 6) AS r6, greatest(l_tax, l_discount) AS hi, least(l_tax, l_discount) AS lo,
  round(pow(l_quantity, 2), 6) AS sq, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS k,
  round(sqrt(l_quantity), 6) AS root, CAST(l_orderkey % 7 AS BIGINT) AS m7
FROM lineitem""")
def scalar_math(spark, sf):
    li = _t(spark, sf, "lineitem")
    return rounded(li.select(
        "l_orderkey", "l_linenumber", F.abs(F.col("l_extendedprice") - 50000).alias("dist"),
        (F.col("l_extendedprice") / 7).alias("r6"), F.greatest("l_tax", "l_discount").alias("hi"),
        F.least("l_tax", "l_discount").alias("lo"), F.pow("l_quantity", 2).alias("sq"),
        F.floor(F.col("l_extendedprice") / 1000).cast("bigint").alias("k"),
        F.sqrt("l_quantity").alias("root"), (F.col("l_orderkey") % 7).alias("m7")))


@register("json_extract", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  json_extract_string(props, '$.missing') AS missing FROM events""")
def json_extract(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                    F.get_json_object("props", "$.missing").alias("missing"))


_REC = """WITH RECURSIVE r(n) AS (
  SELECT min(l_linenumber) FROM lineitem
  UNION ALL SELECT n + 1 FROM r WHERE n < (SELECT max(l_linenumber) FROM lineitem)),
c AS (SELECT l_linenumber, count(*) AS cnt FROM lineitem GROUP BY l_linenumber)
SELECT r.n AS linenumber,
  CAST(sum(coalesce(c.cnt, 0)) OVER (ORDER BY r.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
    AS lines_at_or_below
FROM r LEFT JOIN c ON c.l_linenumber = r.n"""


@register("cte_recursive", _REC)
def cte_recursive(spark, sf):
    """WITH RECURSIVE runs unchanged in Spark SQL."""
    _views(spark, sf, ["lineitem"])
    return spark.sql(_REC)


@register("distinct_counts", """SELECT count(DISTINCT l_orderkey) AS l_orderkey,
  count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem""")
def distinct_counts(spark, sf):
    return R.distinct_counts(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"])
