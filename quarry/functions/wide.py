"""Wide aggregation: many per-column statistics in one scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_agg(df: DataFrame, items: Sequence[str], stats: Callable[[int, str], list[Column]]) -> DataFrame:
    """Apply ``stats(ord, name)`` to every item; return one row per item.

    ``stats`` returns aggregate columns already aliased to the output field
    names; ``ord`` and ``column_name`` are prepended.  All items are fields
    of one aggregate row, so the input is scanned once however many there
    are; the row is then exploded to long form.
    """
    items = list(items)
    if not items:
        return None
    one = df.agg(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("column_name"), *stats(i, name)).alias(f"s{i}")
                   for i, name in enumerate(items)])
    return one.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(items))])))


def unpivot(df: DataFrame, values: Sequence[Column], where: Column | None = None) -> DataFrame:
    """(ord, x) for every row and value column, in one scan."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), x.alias("x")) for i, x in enumerate(values)])))
    return long if where is None else long.where(where)
