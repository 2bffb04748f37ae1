"""Small helpers that spell the long-form oracle SQL for known tables."""

from __future__ import annotations

# Schemas of the driver tables that registered queries read (fixed values).
TABLES = {
    "lineitem": [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"),
                 ("l_linenumber", "n"), ("l_quantity", "n"), ("l_extendedprice", "n"),
                 ("l_discount", "n"), ("l_tax", "n"), ("l_returnflag", "c"),
                 ("l_linestatus", "c"), ("l_shipdate", "t")],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "c"),
               ("o_totalprice", "n"), ("o_orderdate", "t"), ("o_orderpriority", "c")],
    "customer": [("c_custkey", "n"), ("c_name", "c"), ("c_nationkey", "n"),
                 ("c_acctbal", "n"), ("c_mktsegment", "c")],
    "documents": [("doc_id", "n"), ("text", "c"), ("lang", "c"), ("source", "c"),
                  ("n_chars", "n")],
    "events": [("event_id", "n"), ("ts", "t"), ("user_id", "n"), ("event_type", "c"),
               ("value", "n"), ("props", "c")],
    "part": [("p_partkey", "n"), ("p_name", "c"), ("p_brand", "c"), ("p_type", "c"),
             ("p_size", "n"), ("p_retailprice", "n")],
}


def numeric(table: str) -> list[str]:
    return [c for c, k in TABLES[table] if k == "n"]


def categorical(table: str) -> list[str]:
    return [c for c, k in TABLES[table] if k != "n"]


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
