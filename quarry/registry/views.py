"""Derived "dirty" views (FIXTURES.md section 6) in Spark and in SQL.

The driver tables have no nulls or duplicates, so cleaning, missingness
and duplicate operators are checked on deterministic derivations of them.
Each view reads its whole base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import read_table


def dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("o_orderkey"),
        F.when(k % 11 == 0, "N/A").when(k % 13 == 0, " unknown ").when(k % 17 == 0, "bad")
        .otherwise(F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"))
        .alias("price_txt"),
        F.when(k % 4 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("code_txt"),
        F.when(k % 19 == 0, "not a date")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date_txt"),
        F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" ")).alias("status"),
        F.lit(None).cast("string").alias("all_null"),
        F.col("o_custkey").cast("double").alias("int_like"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("amt"),
        F.col("o_orderpriority"),
    )


DIRTY_ORDERS_SQL = """dirty_orders AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 13 = 0 THEN ' unknown '
         WHEN o_orderkey % 17 = 0 THEN 'bad'
         ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS price_txt,
    CASE WHEN o_orderkey % 4 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END AS code_txt,
    CASE WHEN o_orderkey % 19 = 0 THEN 'not a date'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date_txt,
    '  ' || o_orderstatus || ' ' AS status,
    CAST(NULL AS VARCHAR) AS all_null,
    CAST(o_custkey AS DOUBLE) AS int_like,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS amt,
    o_orderpriority
  FROM orders)"""

DIRTY_ORDERS_COLS = ["o_orderkey", "price_txt", "code_txt", "order_date_txt", "status",
                     "all_null", "int_like", "amt", "o_orderpriority"]


def dup_events(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", "props")
    extra = e.where(F.col("event_id") % 50 == 0)
    return e.unionByName(extra).drop("event_id")


DUP_EVENTS_SQL = """dup_events AS (
  SELECT event_type, user_id, value, props FROM events
  UNION ALL
  SELECT event_type, user_id, value, props FROM events WHERE event_id % 50 = 0)"""


def planted_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.withColumn(
        "l_extendedprice",
        F.when(F.col("l_orderkey") % 1000 == 0, F.col("l_extendedprice") * 100)
        .otherwise(F.col("l_extendedprice")))


PLANTED_LINEITEM_SQL = """planted_lineitem AS (
  SELECT * REPLACE (CASE WHEN l_orderkey % 1000 = 0 THEN l_extendedprice * 100
                         ELSE l_extendedprice END AS l_extendedprice)
  FROM lineitem)"""


# Fixed English prefixes by turn % 6 (the generated prose is invented words).
CHAT_PREFIXES = [
    "Please clean the missing values. ",
    "Can you train a model to predict this? ",
    "Show me a plot of the trend. ",
    "How many null values are missing here? ",
    "Find the outlier rows and check correlation. ",
    "Write python code to visualize the data. ",
]


def chat_tagged(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    prefix = F.element_at(F.array(*[F.lit(p) for p in CHAT_PREFIXES]),
                          (F.col("turn") % 6 + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat(prefix, F.col("text")).alias("text"))


def _sql_prefix_case() -> str:
    arms = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(CHAT_PREFIXES))
    return f"CASE turn % 6 {arms} END"


CHAT_TAGGED_SQL = f"""chat_tagged AS (
  SELECT conv_id, turn, role, {_sql_prefix_case()} || text AS text FROM conversations)"""


# Fixed code snippets placed in generated assistant responses (turn % 6).
RESPONSE_CODES = [
    "df.head()",
    "import os\nprint(os.listdir('.'))",
    "df.to_csv('x')",
    "import json\nprint(json.dumps({'a': 1}))",
    "def broken(:\n    pass",
    "print(df.__class__)",
]


def chat_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant messages re-shaped into model-response variants by
    turn % 7: all five labels, explanation only, plain text, lower-case
    labels, camelCase JSON, broken JSON, snake_case JSON."""
    c = read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    t = F.col("text")
    code = F.element_at(F.array(*[F.lit(x) for x in RESPONSE_CODES]), (F.col("turn") % 6 + 1).cast("int"))
    k = F.col("turn") % 7
    full = F.concat(F.lit("EXPLANATION: "), t, F.lit("\nCODE:\n```python\n"), code,
                    F.lit("\n```\nNEXT_STEPS:\n- Check missing values\n* Plot distributions\n"
                          "• Train a model\nCHART_TYPE: histogram\nDOMAIN_INSIGHTS: "), t)
    camel = F.to_json(F.struct(t.alias("explanation"), code.alias("code"),
                               F.array(F.lit("a"), F.lit("b")).alias("nextSteps"),
                               F.lit("scatter").alias("chartType")))
    snake = F.to_json(F.struct(t.alias("explanation"), code.alias("code"),
                               F.array(F.lit("c")).alias("next_steps"),
                               F.lit("line").alias("chart_type"), t.alias("domain_insights")))
    resp = (F.when(k == 0, full).when(k == 1, F.concat(F.lit("EXPLANATION: "), t))
            .when(k == 2, t)
            .when(k == 3, F.concat(F.lit("explanation: "), t,
                                   F.lit("\nnext_steps:\n- one\n- two\nchart_type: bar")))
            .when(k == 4, camel).when(k == 5, F.concat(F.lit('{"explanation": "'), t))
            .otherwise(snake))
    return c.select("conv_id", "turn", "role", resp.alias("response"))


def _sql_codes() -> str:
    def q(s):
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "[" + ", ".join(q(x) for x in RESPONSE_CODES) + "][turn % 6 + 1]"


CHAT_RESPONSES_SQL = f"""chat_responses AS (
  SELECT conv_id, turn, role, CASE turn % 7
    WHEN 0 THEN 'EXPLANATION: ' || text || chr(10) || 'CODE:' || chr(10) || '```python' || chr(10)
         || {_sql_codes()} || chr(10) || '```' || chr(10) || 'NEXT_STEPS:' || chr(10)
         || '- Check missing values' || chr(10) || '* Plot distributions' || chr(10)
         || '• Train a model' || chr(10) || 'CHART_TYPE: histogram' || chr(10) || 'DOMAIN_INSIGHTS: ' || text
    WHEN 1 THEN 'EXPLANATION: ' || text
    WHEN 2 THEN text
    WHEN 3 THEN 'explanation: ' || text || chr(10) || 'next_steps:' || chr(10) || '- one' || chr(10)
         || '- two' || chr(10) || 'chart_type: bar'
    WHEN 4 THEN CAST(json_object('explanation', text, 'code', {_sql_codes()},
         'nextSteps', ['a', 'b'], 'chartType', 'scatter') AS VARCHAR)
    WHEN 5 THEN '{{"explanation": "' || text
    ELSE CAST(json_object('explanation', text, 'code', {_sql_codes()}, 'next_steps', ['c'],
         'chart_type', 'line', 'domain_insights', text) AS VARCHAR) END AS response
  FROM conversations WHERE role = 'assistant')"""
