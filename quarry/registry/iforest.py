"""E3 isolation forest queries (rows-only: no SQL twin for a random
forest; invariants are tested in pytest)."""

from __future__ import annotations

from quarry.operators.iforest import outliers_isolation
from quarry.registry import register
from quarry.registry.views import planted_lineitem

_LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("outliers_isolation")
def outliers_isolation_count(spark, sf):
    count, _ = outliers_isolation(planted_lineitem(spark, sf), _LI_KEY, _FEATURES)
    return count


@register("outliers_isolation_rows")
def outliers_isolation_rows(spark, sf):
    _, rows = outliers_isolation(planted_lineitem(spark, sf), _LI_KEY, _FEATURES)
    return rows
