"""Order-free fingerprints of tables and a comparison that only moves rows where they differ.

Rows are dealt to hash buckets of their key.  A bucket's fingerprint has, per column, the sums of the four 32-bit parts
of two 64-bit hashes of (key, column, value): 128 bits that don't depend on the order of rows and count copies.  Tables
of any size become at most ``buckets`` rows, so two equal tables are compared without moving one of their rows; of
unequal tables only the rows of unequal buckets are grouped.

Nulls have a hash of their own, 0.0 and -0.0 are equal, values that hold maps are hashed as JSON.  Rows with equal keys
are told apart by their values and counted.  Sums are exact up to 2^31 rows a bucket; a wrong "equal" has a chance of
about 2^-128 per bucket and column.  Extra columns may have any name.  Empty tables have no buckets and are equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kinds import q
from quarry.operators.duplicates import holds_map
from quarry.session import materialize

BUCKETS = 4096


def _plain(name: str, dt: T.DataType) -> Column:
    """A value that Spark can hash and group by; equal values give equal ones."""
    c = q(name)
    if holds_map(dt):
        return F.to_json(F.array_sort(F.map_entries(c)) if isinstance(dt, T.MapType) and not holds_map(dt.valueType) else c)
    return c + F.lit(0.0).cast(dt) if isinstance(dt, (T.FloatType, T.DoubleType)) else c


def _columns(df: DataFrame) -> dict[str, Column]:
    return {f.name: _plain(f.name, f.dataType) for f in df.schema.fields}


def _hash(seed: int, values: Sequence[Column]) -> Column:
    return F.xxhash64(F.lit(seed), *[part for v in values for part in (v.isNull(), v)])


def _bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> Column:
    cells = _columns(df)
    return F.pmod(_hash(0, [cells[k] for k in keys]), F.lit(buckets)).cast("int")


def fingerprints(df: DataFrame, keys: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, prints): one row per occupied bucket; ``prints`` has four sums per column, in column order.
    Without ``keys`` the whole row is the key."""
    cells = _columns(df)
    keys = list(keys or df.columns)
    key = [cells[k] for k in keys]
    parts = []
    for i, c in enumerate(df.columns):
        for seed in (1, 2):
            h = F.xxhash64(F.lit(seed * 1_000_003 + i), F.col("k1"), F.col("k2"), F.col(f"n{i}"), F.col(f"v{i}"))
            parts += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    rows = df.select(_bucket(df, keys, buckets).alias("bucket"), _hash(11, key).alias("k1"), _hash(12, key).alias("k2"),
                     *[e for i, c in enumerate(df.columns) for e in (cells[c].isNull().alias(f"n{i}"), cells[c].alias(f"v{i}"))])
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.array(*parts).alias("prints"))


def _same_schema(a: DataFrame, b: DataFrame) -> None:
    if [(f.name, f.dataType) for f in a.schema.fields] != [(f.name, f.dataType) for f in b.schema.fields]:
        raise ValueError("fingerprints compare tables of the same columns and types")


def changed_columns(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(ord, column_name, buckets): in how many buckets a column differs.  Rows that only one table has change every
    column of their bucket; a changed cell only its own (if it is no key).  Only fingerprints are shuffled."""
    _same_schema(a, b)
    both = _pairs(a, b, keys, buckets)
    cells = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column_name"),
                      (~F.slice("left", 4 * i + 1, 4).eqNullSafe(F.slice("right", 4 * i + 1, 4))).cast("int").alias("d"))
             for i, c in enumerate(a.columns)]
    return (both.select(F.inline(F.array(*cells))).groupBy("ord", "column_name")
            .agg(F.sum("d").cast("bigint").alias("buckets")))


def _pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] | None, buckets: int) -> DataFrame:
    """(bucket, left, right) of both tables' fingerprints, null where a table has no row in the bucket."""
    sides = [fingerprints(t, keys, buckets).select("bucket", F.col("prints").alias(side))
             for t, side in ((a, "left"), (b, "right"))]
    both = sides[0].select("bucket", "left", F.lit(None).cast(sides[1].schema["right"].dataType).alias("right")).unionAll(
        sides[1].select("bucket", F.lit(None).cast(sides[0].schema["left"].dataType).alias("left"), "right"))
    return both.groupBy("bucket").agg(F.max("left").alias("left"), F.max("right").alias("right"))


def changed_rows(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows in which the bags differ, with ``only_left`` and ``only_right`` (how many more copies a side has).
    Rows of equal buckets are left where they are read; the others are counted with opposite signs in one aggregate."""
    _same_schema(a, b)
    clash = {"only_left", "only_right"} & set(a.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} have the names of the result's own")
    keys = list(keys or a.columns)
    unequal = materialize(_pairs(a, b, keys, buckets).where(~F.col("left").eqNullSafe(F.col("right"))).select("bucket"),
                          "unequal-buckets")
    cells = _columns(a)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def side(t: DataFrame, left: Column, right: Column) -> DataFrame:
        rows = t.select(F.struct(*[q(c) for c in t.columns]).alias("row"), _bucket(t, keys, buckets).alias("bucket"),
                        F.struct(*[cells[c].alias(f"g{i}") for i, c in enumerate(t.columns)]).alias("g"),
                        left.alias("l"), right.alias("r"))
        # at most `buckets` integers
        return rows.join(F.broadcast(unequal), "bucket", "left_semi")

    both = side(a, one, zero).unionAll(side(b, zero, one))
    counted = both.groupBy("g").agg(F.first("row").alias("row"), F.sum("l").alias("l"), F.sum("r").alias("r")).where(F.col("l") != F.col("r"))
    return counted.select("row.*", F.greatest(F.col("l") - F.col("r"), zero).alias("only_left"),
                          F.greatest(F.col("r") - F.col("l"), zero).alias("only_right"))


def equal_tables(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row (left_rows, right_rows, unequal_buckets, equal); no row of either table is shuffled."""
    _same_schema(a, b)
    counts = [fingerprints(t, None, buckets).select("bucket", F.struct("n", "prints").alias("p"), F.col("n").alias(side),
                                                    F.lit(0).cast("bigint").alias(other))
              for t, side, other in ((a, "l", "r"), (b, "r", "l"))]
    per = counts[0].unionByName(counts[1]).groupBy("bucket").agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"),
        # two sides with one and the same fingerprint
        ((F.count(F.lit(1)) == 2) & F.min("p").eqNullSafe(F.max("p"))).alias("same"))
    total = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("bigint")
    out = per.agg(total("l").alias("left_rows"), total("r").alias("right_rows"),
                  total((~F.col("same")).cast("int")).alias("unequal_buckets"))
    return out.withColumn("equal", F.col("unequal_buckets") == 0)
