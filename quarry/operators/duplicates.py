"""Duplicate rows (nulls compare equal, as in pandas)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kinds import q


def holds_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.StructType):
        return any(holds_map(f.dataType) for f in dt.fields)
    return isinstance(dt, T.MapType) or isinstance(dt, T.ArrayType) and holds_map(dt.elementType)


def _row_hash(df: DataFrame, cols: list[str]):
    """Two independent hashes (64 + 32 bits) of the row's columns.  Spark hashes no maps: a column with
    one inside contributes whether it is null, which only adds candidates for the exact grouping."""
    types = {f.name: f.dataType for f in df.schema.fields}
    vals = [q(c).isNull() if holds_map(types[c]) else q(c) for c in cols]
    return F.struct(F.xxhash64(*vals).alias("h1"), F.hash(*vals).alias("h2"))


_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _wide(df: DataFrame, cols: list[str]) -> bool:
    """Rows worth hashing first: any variable-width column, or many columns
    (a row of at most 8 fixed-width values is no bigger than its hashes)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return len(cols) > 8 or any(not isinstance(types[c], _FIXED) for c in cols)


def _candidates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose row hash occurs more than once (all rows for narrow
    fixed-width rows).  Pass 1 counts hashes
    (a few bytes per row, combined map-side), pass 2 keeps only rows with a
    repeated hash via a semi-join.  Hash collisions only add candidates;
    the exact grouping on the full columns that follows removes them."""
    if not _wide(df, cols):
        return df
    hashed = df.withColumn("_rh", _row_hash(df, cols))
    repeated = hashed.groupBy("_rh").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_rh")
    return hashed.join(repeated, "_rh", "left_semi").drop("_rh")


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """E5: (rows, distinct_rows, duplicates), nulls equal.  Only the row
    hashes and the rows with a repeated hash are shuffled; an exact group-by
    on the full columns runs on those candidates alone, so wide rows (long
    texts) that are unique never cross the network."""
    cols = list(cols or df.columns)
    total = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("tag"), "n")
    groups = _candidates(df, cols).groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    dups = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n")) \
        .select(F.lit("dups").alias("tag"), "n")
    both = total.unionByName(dups).agg(
        F.sum(F.when(F.col("tag") == "rows", F.col("n"))).cast("bigint").alias("rows"),
        F.sum(F.when(F.col("tag") == "dups", F.col("n"))).cast("bigint").alias("duplicates"))
    return both.select("rows", (F.col("rows") - F.col("duplicates")).cast("bigint").alias("distinct_rows"),
                       "duplicates")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """All members of duplicated groups (``duplicated(keep=False)``) with
    the group size ``dup_count``.

    Candidates come from the row-hash pass; they are grouped exactly on the
    full columns and matched back with a null-safe equi-join.  AQE turns
    the join into a broadcast when the measured group side is small and
    splits a skewed (hot-group) partition otherwise."""
    cols = list(cols or df.columns)
    cand = _candidates(df, cols)
    groups = (cand.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("dup_count"))
              .where(F.col("dup_count") > 1))
    g = groups.select(*[q(c).alias(f"_g{i}") for i, c in enumerate(cols)], "dup_count")
    cond = reduce(lambda a, b: a & b,
                  [q(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(cols)])
    return cand.join(g, cond, "inner").drop(*[f"_g{i}" for i in range(len(cols))])


def duplicate_preview(df: DataFrame, order_by: Sequence[str], n: int = 10,
                      cols: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` duplicated rows by ``order_by`` (all copies)."""
    return duplicate_rows(df, cols).orderBy(*order_by).limit(n)


def drop_duplicates(df: DataFrame, cols: Sequence[str] | None = None,
                    order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per group.  Without ``order_by`` any copy is kept
    (``dropDuplicates``).  With it the first copy by ``order_by`` is kept via
    ``min_by(row, order)``, an aggregate that combines map-side, so a hot
    group never lands whole in one task."""
    cols = list(cols or df.columns)
    if not order_by:
        return df.dropDuplicates(cols)
    row = F.struct(*[q(c) for c in df.columns])
    order = F.struct(*[q(c) for c in order_by], row)
    kept = df.groupBy(*[q(c).alias(f"_k{i}") for i, c in enumerate(cols)]).agg(
        F.min_by(row, order).alias("_row"))
    return kept.select("_row.*")
