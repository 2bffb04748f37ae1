"""Cleaning operators B1-B4, B8, B10-B16 (B5-B7, B9 live in CleanPlan)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kinds import numeric_columns, q
from quarry.functions.parsing import null_tokens, strip
from quarry.operators.profile import value_counts
from quarry.plans.clean_plan import CleanPlan
from quarry.session import materialize


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """B1: one ``count`` per column in a single job, then drop."""
    row = df.agg(*[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if row[f"c{i}"] > 0]
    return df.select(*[q(c) for c in keep])


def drop_unnamed_columns(df: DataFrame) -> DataFrame:
    """B2: names starting with ``Unnamed`` (case-sensitive)."""
    return df.select(*[q(c) for c in df.columns if not re.match("^Unnamed", c)])


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip Unicode whitespace from every text column."""
    return df.select(*[strip(q(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else q(f.name) for f in df.schema.fields])


def nullify_tokens(df: DataFrame) -> DataFrame:
    """Missing-value tokens in text columns become null."""
    return df.select(*[null_tokens(q(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else q(f.name)
                       for f in df.schema.fields])


def display_projection(df: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` columns, 5 <= n <= 1000."""
    if not 5 <= n <= 1000:
        raise ValueError("n must be within 5..1000")
    return df.select(*[q(c) for c in df.columns[:n]])


def clean_preview(df: DataFrame, order_by: Sequence[str], n: int = 100) -> DataFrame:
    """Cleaned head(n) by ``order_by``."""
    plan = CleanPlan.fit(df)
    return plan.apply(df).orderBy(*order_by).limit(n)


def clean_column_names(df: DataFrame) -> DataFrame:
    """Trim, lower-case, non-alphanumerics to ``_``; ``_1``, ``_2``
    suffixes on clashes."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = re.sub(r"[^0-9a-z]+", "_", c.strip().lower()).strip("_") or "column"
        name = base
        while name in seen:
            seen[base] += 1
            name = f"{base}_{seen[base]}"
        seen.setdefault(name, 0)
        names.append(name)
    return df.toDF(*names)


def flag_missing(df: DataFrame, only_with_nulls: bool = True) -> DataFrame:
    """Keep nulls and add boolean ``<col>_missing`` (for columns with
    at least one null unless ``only_with_nulls`` is False)."""
    cols = df.columns
    if only_with_nulls:
        row = df.agg(*[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        cols = [c for i, c in enumerate(cols) if row[f"m{i}"] > 0]
    return df.withColumns({f"{c}_missing": q(c).isNull() for c in cols})


def _fill_values(df: DataFrame, cols: list[str], strategy: str) -> dict:
    """One aggregate row of fill values (O(#columns) values to the driver)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if strategy == "mean":
        row = df.agg(*[F.avg(q(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    elif strategy == "median":
        from quarry.functions.kinds import as_double
        from quarry.functions.quantiles import exact_quantiles
        med = exact_quantiles(df, {c: as_double(c, types[c]) for c in cols}, [0.5])
        return {c: med[(c, 0.5)] for c in cols}
    elif strategy == "mode":
        # per-column value counts (partial aggregation), then min_by on
        # (-count, value): smallest value among the most frequent
        vc = value_counts(df, cols)
        num_ords = [i for i, c in enumerate(cols) if isinstance(types[c], T.NumericType)]
        key = F.struct((-F.col("count")).alias("nc"),
                       F.when(F.col("ord").isin(num_ords), F.col("value").try_cast("double")).alias("nv"),
                       F.col("value"))
        ends = vc.groupBy("ord").agg(F.min_by("value", key).alias("v"))
        got = {r["ord"]: r["v"] for r in ends.collect()}     # one row per column
        return {c: (None if got.get(i) is None else
                    F.lit(got[i]).cast(types[c])) for i, c in enumerate(cols)}
    else:
        raise ValueError(strategy)
    return {c: row[f"v{i}"] for i, c in enumerate(cols)}


def fill_missing(df: DataFrame, strategy: str = "constant", cols: Sequence[str] | None = None,
                 value=None, order_by: Sequence[str] | None = None,
                 partition_by: Sequence[str] | None = None) -> DataFrame:
    """Constant | mean | median | mode | ffill.

    Integer columns filled with a fractional mean/median become double
    (the reference raises instead)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if strategy == "ffill":
        return forward_fill(df, list(cols or df.columns), order_by or [], partition_by)
    if strategy == "constant":
        cols = list(cols or df.columns)
        return df.withColumns({c: F.coalesce(q(c), F.lit(value).cast(types[c])) for c in cols})
    cols = list(cols or (numeric_columns(df) if strategy in ("mean", "median") else df.columns))
    vals = _fill_values(df, cols, strategy)
    out = {}
    for c in cols:
        v = vals[c]
        if v is None:
            continue
        if strategy == "mode":
            out[c] = F.coalesce(q(c), v)
        else:
            out[c] = F.coalesce(q(c).cast("double"), F.lit(float(v)))
    return df.withColumns(out)


def forward_fill(df: DataFrame, cols: list[str], order_by: Sequence[str],
                 partition_by: Sequence[str] | None = None) -> DataFrame:
    """Forward fill (last non-null value so far) in ``order_by`` order.

    With ``partition_by`` it is a plain window per group.  Globally, a
    window without a partition would pull every row into one task, so the
    rows are range-partitioned by the order columns (any orderable types)
    into blocks of about equal size: each block fills inside itself, and
    the value a block inherits is the last non-null of earlier blocks,
    taken from a small per-block table (one row per block)."""
    order_by = list(order_by)
    if not order_by:
        raise ValueError("forward fill needs an order")
    ow = [q(c) for c in order_by]
    if partition_by:
        w = (Window.partitionBy(*[q(c) for c in partition_by]).orderBy(*ow)
             .rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumns({c: F.last(q(c), ignorenulls=True).over(w) for c in cols})
    # ranges over all order columns, of whatever types; written once, so both
    # uses below see the same blocks
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = materialize(df.repartitionByRange(n, *ow).withColumn("_blk", F.spark_partition_id()), "fill-blocks")
    w = Window.partitionBy("_blk").orderBy(*ow).rowsBetween(Window.unboundedPreceding, 0)
    inside = b.withColumns({c: F.last(q(c), ignorenulls=True).over(w) for c in cols})
    order_struct = F.struct(*ow)
    per_block = b.groupBy("_blk").agg(*[
        F.max_by(q(c), F.when(q(c).isNotNull(), order_struct)).alias(f"_l{i}")
        for i, c in enumerate(cols)])
    wb = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select("_blk", *[F.last(f"_l{i}", ignorenulls=True).over(wb).alias(f"_c{i}")
                                       for i in range(len(cols))])
    joined = inside.join(carry, "_blk", "left")
    return joined.withColumns({c: F.coalesce(q(c), F.col(f"_c{i}")) for i, c in enumerate(cols)}) \
        .drop("_blk", *[f"_c{i}" for i in range(len(cols))])


def drop_missing(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None,
                 thresh: int | None = None) -> DataFrame:
    """B16 rows: ``dropna(how, subset, thresh)``; column names may hold dots."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(subset) if subset else list(df.columns)
    if not cols:
        return df
    there = [(q(c).isNotNull() & ~F.isnan(q(c)) if isinstance(types[c], (T.FloatType, T.DoubleType))
              else q(c).isNotNull()).cast("int") for c in cols]
    least = thresh if thresh is not None else (len(cols) if how == "any" else 1)
    return df.where(reduce(lambda a, b: a + b, there) >= least)


def drop_sparse_columns(df: DataFrame, max_missing_share: float = 0.5) -> DataFrame:
    """B16 columns: drop columns whose missing share exceeds the limit."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n = row["_n"] or 1
    keep = [c for i, c in enumerate(df.columns) if (n - row[f"c{i}"]) / n <= max_missing_share]
    return df.select(*[q(c) for c in keep])
