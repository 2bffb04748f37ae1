"""J1 apply_transform and J2 table_diff."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.kinds import q


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag comparison -> one row (left_rows, right_rows, only_left,
    only_right, equal).  The rows of both tables are counted with opposite
    signs in one aggregate, which combines copies map-side.  Tables with
    different schemas are simply not equal."""
    same_schema = a.columns == b.columns and \
        [f.dataType for f in a.schema.fields] == [f.dataType for f in b.schema.fields]
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    names = [f"c{i}" for i in range(len(a.columns))] if same_schema else []
    left = a.select(*[q(c).alias(n) for n, c in zip(names, a.columns, strict=False)], one.alias("_l"), zero.alias("_r"))
    right = b.select(*[q(c).alias(n) for n, c in zip(names, b.columns, strict=False)], zero.alias("_l"), one.alias("_r"))
    both = left.union(right)
    if same_schema:
        both = both.groupBy(*names).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    total = lambda x: F.coalesce(F.sum(x), zero)
    unknown = F.lit(None).cast("bigint")
    over = lambda x, y: total(F.greatest(F.col(x) - F.col(y), zero)) if same_schema else unknown
    out = both.agg(total("_l").alias("left_rows"), total("_r").alias("right_rows"),
                   over("_l", "_r").alias("only_left"), over("_r", "_l").alias("only_right"))
    equal = F.coalesce((F.col("only_left") == 0) & (F.col("only_right") == 0), F.lit(False))
    return out.select("left_rows", "right_rows", "only_left", "only_right", equal.alias("equal"))


def apply_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame],
                    order_by: Sequence[str], n: int = 10):
    """Run a caller's DataFrame -> DataFrame function (``df.transform``).
    Returns ``(result, preview, summary)``: the lazy result, its first
    ``n`` rows by ``order_by``, and one row (rows, changed) where changed
    means a new schema or a different bag of rows."""
    out = df.transform(fn)
    preview = out.orderBy(*[c for c in order_by if c in out.columns]).limit(n)
    summary = table_diff(df, out).select(F.col("right_rows").alias("rows"),
                                         (~F.col("equal")).alias("changed"))
    return out, preview, summary
