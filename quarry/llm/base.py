"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import ship_package


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Project the columns an operator needs under fixed names; extra columns, whatever their names,
    are dropped.  Names may hold dots."""
    ship_package(df.sparkSession)
    return df.select(*[quoted(c).alias(n) for n, c in columns.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Total UTF-8 bytes of the texts: one column-pruned scan and one row."""
    return df.select(F.sum(F.octet_length(quoted(text)))).first()[0] or 0


def parts_for(total_bytes: int, each: int, least: int = 8) -> int:
    """Number of partitions so that each holds about ``each`` bytes."""
    return max(least, -(-total_bytes // each))


def same_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in names])
