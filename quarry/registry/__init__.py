"""Registry of checked queries: each Spark query over the driver tables is
paired with an equivalent DuckDB SQL text (the oracle) where one exists.

Conventions shared by both sides so that value hashes agree: every
computed column is aliased identically, counts are bigint, and floating
statistics are rounded (6 decimals; variances/correlations 4).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

_MODULES = ["profile", "clean", "relate", "outliers", "charts", "sources", "report", "iforest",
            "relational", "chat", "streams", "transform"]


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"quarry.registry.{m}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (both sides of the oracle do the same)."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])
