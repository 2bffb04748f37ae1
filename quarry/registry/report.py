"""Checked queries for C16-C20 (composite reports)."""

from __future__ import annotations

from quarry.plans import report as RP
from quarry.plans.clean_plan import smart_clean
from quarry.registry import register
from quarry.registry.clean import _WITH_CLEANED
from quarry.registry.views import dirty_orders
from quarry.session import read_table

_MISS = "(" + " + ".join(f"count(*) - count({c})" for c in [
    "o_orderkey", "price_txt", "code_txt", "order_date_txt", "status", "int_like", "amt",
    "o_orderpriority"]) + ")"
_TOT = f"tot AS (SELECT count(*) AS rows, {_MISS} AS miss FROM cleaned)"
_SCORE = ("CAST(greatest(0, least(100, floor(100.0 - least(CAST(miss AS DOUBLE) / (rows * 8) * 100 * 0.5, 30.0)"
          " + 8 + 8 + 0.5))) AS BIGINT)")


def _cleaned(spark, sf):
    full, _, _ = smart_clean(dirty_orders(spark, sf))
    return full


@register("quality_score", _WITH_CLEANED.rstrip() + f",\n{_TOT}\nSELECT {_SCORE} AS quality_score FROM tot")
def quality_score(spark, sf):
    return RP.quality_score(_cleaned(spark, sf))


@register("dataset_summary", _WITH_CLEANED.rstrip() + f""",\n{_TOT}
SELECT 'Dataset: orders.csv' || chr(10) || 'Domain: financial' || chr(10) || 'Shape: ' || CAST(rows AS VARCHAR)
  || ' rows × 8 columns' || chr(10) || 'Numerical Features: 4' || chr(10) || 'Categorical Features: 4'
  || chr(10) || 'Missing Values: ' || CAST(miss AS VARCHAR) || ' total' || chr(10)
  || 'Data Quality Score: ' || CAST({_SCORE} AS VARCHAR) AS summary FROM tot""")
def dataset_summary(spark, sf):
    return RP.dataset_summary(_cleaned(spark, sf), "orders.csv")


_LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("auto_insights")
def auto_insights(spark, sf):
    """Rows-only: ordered insight texts for lineitem."""
    return RP.auto_insights(read_table(spark, sf, "lineitem"), "lineitem.parquet")


@register("dataset_context")
def dataset_context(spark, sf):
    """Rows-only: one struct row describing the cleaned dirty_orders."""
    return RP.dataset_context(_cleaned(spark, sf), "orders.csv", ["o_orderkey"])


@register("profile_report")
def profile_report(spark, sf):
    """Rows-only: the whole profile of the cleaned dirty_orders as one row."""
    return RP.profile_report(_cleaned(spark, sf), "orders.csv", ["o_orderkey"])
