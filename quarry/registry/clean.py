"""Checked queries for B1-B16 on the dirty views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean as CL
from quarry.operators import profile as P
from quarry.plans.clean_plan import CleanPlan, smart_clean
from quarry.registry import register, rounded
from quarry.registry.sqlgen import TABLES, lit
from quarry.registry.views import DIRTY_ORDERS_SQL, dirty_orders
from quarry.session import read_table

@register("clean_zoned_dates", """SELECT o_orderkey, o_orderdate + INTERVAL 123456 MICROSECOND AS order_time,
  CAST(9007199254740993 + o_orderkey AS BIGINT) AS long_id FROM orders""")
def clean_zoned_dates(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123456Z")).alias("order_time"),
        (F.lit(9007199254740993) + F.col("o_orderkey")).cast("string").alias("long_id"))
    return CleanPlan.fit(o).apply(o)


_TOK = "('na', 'n/a', 'none', 'null', 'nan', 'missing', 'unknown', '')"
_NUM_RE = r"'^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$'"


def _tok(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN {_TOK} THEN NULL ELSE trim({c}) END"


def _num(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, {_NUM_RE}) THEN TRY_CAST({e} AS DOUBLE) END"


_TRIMMED = f"""trimmed AS (SELECT o_orderkey, {_tok('price_txt')} AS price_txt,
  {_tok('code_txt')} AS code_txt, {_tok('order_date_txt')} AS order_date_txt,
  {_tok('status')} AS status, {_tok('all_null')} AS all_null, int_like, amt,
  {_tok('o_orderpriority')} AS o_orderpriority FROM dirty_orders)"""

_CLEANED = f"""cleaned AS (SELECT o_orderkey, CAST({_num('price_txt')} AS BIGINT) AS price_txt,
  code_txt, try_strptime(order_date_txt, '%Y-%m-%d') AS order_date_txt, status,
  CAST(int_like AS BIGINT) AS int_like, amt, o_orderpriority FROM trimmed)"""

_WITH_CLEANED = f"WITH {DIRTY_ORDERS_SQL},\n{_TRIMMED},\n{_CLEANED}\n"


def _cleaned(spark, sf):
    full, _, _ = smart_clean(dirty_orders(spark, sf))
    return full


@register("clean_trim_tokens", f"WITH {DIRTY_ORDERS_SQL},\n{_TRIMMED}\nSELECT * FROM trimmed")
def clean_trim_tokens(spark, sf):
    return CL.trim_strings(CL.nullify_tokens(dirty_orders(spark, sf)))


@register("clean_drop_null_cols", f"WITH {DIRTY_ORDERS_SQL}\nSELECT * EXCLUDE (all_null) FROM dirty_orders")
def clean_drop_null_cols(spark, sf):
    return CL.drop_all_null_columns(dirty_orders(spark, sf))


@register("clean_infer_numeric", f"""WITH {DIRTY_ORDERS_SQL},\n{_TRIMMED}
SELECT o_orderkey, {_num('price_txt')} AS price_txt, code_txt, order_date_txt, status,
  int_like, amt, o_orderpriority FROM trimmed""")
def clean_infer_numeric(spark, sf):
    d = dirty_orders(spark, sf)
    return CleanPlan.fit(d, parse_dates=False, narrow=False).apply(d)


@register("clean_parse_dates", f"""WITH {DIRTY_ORDERS_SQL},\n{_TRIMMED}
SELECT o_orderkey, {_num('price_txt')} AS price_txt, code_txt,
  try_strptime(order_date_txt, '%Y-%m-%d') AS order_date_txt, status, int_like, amt,
  o_orderpriority FROM trimmed""")
def clean_parse_dates(spark, sf):
    d = dirty_orders(spark, sf)
    return CleanPlan.fit(d, narrow=False).apply(d)


_LI_COLS = [c for c, _ in TABLES["lineitem"]]


@register("clean_narrow", "SELECT " + ", ".join(
    "CAST(l_quantity AS BIGINT) AS l_quantity" if c == "l_quantity" else c for c in _LI_COLS)
    + " FROM lineitem")
def clean_narrow(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return CleanPlan.fit(li).apply(li)


@register("smart_clean_full", _WITH_CLEANED + "SELECT * FROM cleaned")
def smart_clean_full(spark, sf):
    return _cleaned(spark, sf)


@register("clean_display_5", _WITH_CLEANED
          + "SELECT o_orderkey, price_txt, code_txt, order_date_txt, status FROM cleaned")
def clean_display_5(spark, sf):
    _, display, _ = smart_clean(dirty_orders(spark, sf), max_display_cols=5)
    return display


@register("clean_preview_100", _WITH_CLEANED + "SELECT * FROM cleaned ORDER BY o_orderkey LIMIT 100")
def clean_preview_100(spark, sf):
    return CL.clean_preview(dirty_orders(spark, sf), ["o_orderkey"], 100)


_KINDS = [("o_orderkey", "numeric", "bigint", "Int64"), ("price_txt", "numeric", "bigint", "Int64"),
          ("code_txt", "categorical", "string", "string"),
          ("order_date_txt", "categorical", "timestamp_ntz", "datetime64[ns]"),
          ("status", "categorical", "string", "string"), ("int_like", "numeric", "bigint", "Int64"),
          ("amt", "numeric", "double", "Float64"),
          ("o_orderpriority", "categorical", "string", "string")]


@register("column_kinds", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {lit(c)}, {lit(k)})" for i, (c, k, _, _) in enumerate(_KINDS))
    + ") t(ord, column_name, kind)")
def column_kinds(spark, sf):
    return P.column_kinds(_cleaned(spark, sf))


@register("column_types", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {lit(c)}, {lit(s)}, {lit(d)})" for i, (c, _, s, d) in enumerate(_KINDS))
    + ") t(ord, column_name, spark_type, dtype)")
def column_types(spark, sf):
    return P.column_types(_cleaned(spark, sf))


_MESSY = [" Order Key", "Price-TXT", "code txt", "Order Date", "STATUS ", "all null",
          "int.like", "amt", "Order Date"]
_CLEAN_NAMES = ["order_key", "price_txt", "code_txt", "order_date", "status", "all_null",
                "int_like", "amt", "order_date_1"]


@register("clean_names", f"WITH {DIRTY_ORDERS_SQL}\nSELECT " + ", ".join(
    f"{src} AS {dst}" for src, dst in zip(
        ["o_orderkey", "price_txt", "code_txt", "order_date_txt", "status", "all_null",
         "int_like", "amt", "o_orderpriority"], _CLEAN_NAMES)) + " FROM dirty_orders")
def clean_names(spark, sf):
    return CL.clean_column_names(dirty_orders(spark, sf).toDF(*_MESSY))


@register("flag_missing", _WITH_CLEANED + """SELECT *, price_txt IS NULL AS price_txt_missing,
  order_date_txt IS NULL AS order_date_txt_missing, amt IS NULL AS amt_missing FROM cleaned""")
def flag_missing(spark, sf):
    return CL.flag_missing(_cleaned(spark, sf))


@register("fill_mean", _WITH_CLEANED + """SELECT * REPLACE (
  round(coalesce(CAST(price_txt AS DOUBLE), (SELECT avg(price_txt) FROM cleaned)), 6) AS price_txt,
  round(coalesce(amt, (SELECT avg(amt) FROM cleaned)), 6) AS amt) FROM cleaned""")
def fill_mean(spark, sf):
    return rounded(CL.fill_missing(_cleaned(spark, sf), "mean", ["price_txt", "amt"]))


@register("fill_median", _WITH_CLEANED + """SELECT * REPLACE (
  round(coalesce(CAST(price_txt AS DOUBLE), (SELECT quantile_cont(price_txt, 0.5) FROM cleaned)), 6) AS price_txt,
  round(coalesce(amt, (SELECT quantile_cont(amt, 0.5) FROM cleaned)), 6) AS amt) FROM cleaned""")
def fill_median(spark, sf):
    return rounded(CL.fill_missing(_cleaned(spark, sf), "median", ["price_txt", "amt"]))


@register("fill_mode", _WITH_CLEANED + """SELECT * REPLACE (
  coalesce(price_txt, (SELECT price_txt FROM cleaned WHERE price_txt IS NOT NULL
     GROUP BY price_txt ORDER BY count(*) DESC, price_txt LIMIT 1)) AS price_txt,
  coalesce(code_txt, (SELECT code_txt FROM cleaned WHERE code_txt IS NOT NULL
     GROUP BY code_txt ORDER BY count(*) DESC, code_txt LIMIT 1)) AS code_txt) FROM cleaned""")
def fill_mode(spark, sf):
    return CL.fill_missing(_cleaned(spark, sf), "mode", ["price_txt", "code_txt"])


@register("fill_forward", _WITH_CLEANED + """SELECT * REPLACE (
  last_value(price_txt IGNORE NULLS) OVER w AS price_txt,
  last_value(amt IGNORE NULLS) OVER w AS amt) FROM cleaned
WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_forward(spark, sf):
    return CL.fill_missing(_cleaned(spark, sf), "ffill", ["price_txt", "amt"], order_by=["o_orderkey"])


@register("fill_constant", _WITH_CLEANED + """SELECT * REPLACE (coalesce(code_txt, 'n/a') AS code_txt,
  coalesce(amt, 0.0) AS amt) FROM cleaned""")
def fill_constant(spark, sf):
    c = _cleaned(spark, sf)
    return CL.fill_missing(CL.fill_missing(c, "constant", ["code_txt"], "n/a"),
                           "constant", ["amt"], 0.0)


@register("drop_missing_rows", _WITH_CLEANED
          + "SELECT * FROM cleaned WHERE price_txt IS NOT NULL AND amt IS NOT NULL")
def drop_missing_rows(spark, sf):
    return CL.drop_missing(_cleaned(spark, sf), "any", ["price_txt", "amt"])


@register("drop_sparse_cols", f"WITH {DIRTY_ORDERS_SQL}\nSELECT * EXCLUDE (all_null) FROM dirty_orders")
def drop_sparse_cols(spark, sf):
    return CL.drop_sparse_columns(dirty_orders(spark, sf), 0.5)


@register("clean_unnamed", """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name,
  CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation""")
def clean_unnamed(spark, sf):
    """B2 end to end: an index-like ``Unnamed: 3`` column written to CSV is
    dropped by the cleaning plan after reading the text back."""
    from pyspark.sql import functions as F
    from quarry.session import scratch_path
    from quarry.sources.text import export_table, read_csv_text
    path = scratch_path(spark, "unnamed")
    n = read_table(spark, sf, "nation")
    export_table(n.withColumn("Unnamed: 3", F.col("n_nationkey") * 10), path, "csv")
    full, _, _ = smart_clean(read_csv_text(spark, path))
    return full


@register("nan_to_null", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS was_nan,
  event_id % 9 = 0 AS is_null FROM events""")
def nan_to_null(spark, sf):
    """NaN planted in events.value becomes null (missing)."""
    from pyspark.sql import functions as F
    from quarry.functions.kinds import nan_to_null as to_null
    e = read_table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    out = to_null(e)
    return out.select("event_id", "value", F.when(F.col("event_id") % 9 == 0, 1).otherwise(0).alias("was_nan"),
                      F.col("value").isNull().alias("is_null"))


@register("clean_plan_stream", _WITH_CLEANED + "SELECT * FROM cleaned")
def clean_plan_stream(spark, sf):
    """B9 on a stream: the plan fitted on the batch table is applied
    unchanged to a Structured Stream of the same rows (file source,
    availableNow, exactly-once parquet sink)."""
    from quarry.session import scratch_path
    from quarry.streaming.sessions import run_to_parquet
    d = dirty_orders(spark, sf)
    plan = CleanPlan.fit(d)
    src = scratch_path(spark, "dirty-src")
    d.write.parquet(src)
    stream = spark.readStream.schema(d.schema).parquet(src)
    out, ck = scratch_path(spark, "clean-out"), scratch_path(spark, "clean-ck")
    run_to_parquet(plan.apply(stream), out, ck, "append")
    return spark.read.parquet(out)
