"""G: the relational surface analysts reach for, with pandas semantics
where they differ from SQL.  Plain ``select/filter/groupBy/join/window``
need no wrapper; only the helpers below add behaviour."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kinds import q


def merge(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
          suffixes: tuple[str, str] = ("_x", "_y"), null_equal: bool = False) -> DataFrame:
    """G3 pandas ``merge``: key columns once, overlapping non-key columns
    suffixed; ``null_equal`` matches null keys with null keys (pandas) via
    null-safe equality (still an equi-join for the planner)."""
    on = list(on)
    overlap = (set(left.columns) & set(right.columns)) - set(on)
    lsel = [q(c).alias(f"_lk{i}") for i, c in enumerate(on)] + [
        q(c).alias(c + suffixes[0]) if c in overlap else q(c) for c in left.columns if c not in on]
    rsel = [q(c).alias(f"_rk{i}") for i, c in enumerate(on)] + [
        q(c).alias(c + suffixes[1]) if c in overlap else q(c)
        for c in right.columns if c not in on]
    l2, r2 = left.select(*lsel), right.select(*rsel)
    eq = (lambda a, b: a.eqNullSafe(b)) if null_equal else (lambda a, b: a == b)
    cond = reduce(lambda a, b: a & b, [eq(F.col(f"_lk{i}"), F.col(f"_rk{i}")) for i in range(len(on))])
    joined = l2.join(r2, cond, how)
    keys = {c: (F.coalesce(f"_lk{i}", f"_rk{i}") if how in ("right", "outer", "full") else F.col(f"_lk{i}")).alias(c)
            for i, c in enumerate(on)}
    rest = [c for c in joined.columns if not c.startswith(("_lk", "_rk"))]
    return joined.select(*[keys[c] for c in on], *[q(c) for c in rest])


def band_join(left: DataFrame, right: DataFrame, lcol: str, rcol: str, width: float,
              how: str = "inner") -> DataFrame:
    """G4 theta join ``|l - r| <= width`` without a nested loop: both sides
    are bucketed by ``floor(x / width)`` and one of them also stands in the
    two neighbouring buckets, so an equi-join on the bucket sees every pair
    once; the exact band predicate filters.  The side whose unmatched rows
    are kept is never the multiplied one; a full join adds the unmatched
    right rows to the left join.  Work grows with matching pairs, not
    |L| x |R|."""
    def bucket(df: DataFrame, col: str, name: str, spread: bool) -> DataFrame:
        b = F.floor(q(col) / F.lit(width))
        return df.withColumn(name, F.explode(F.array(b - 1, b, b + 1)) if spread else b)

    def joined(kind: str, spread_left: bool) -> DataFrame:
        lb = bucket(left, lcol, "_lb", spread_left).withColumn("_lx", q(lcol))
        rb = bucket(right, rcol, "_rb", not spread_left).withColumn("_rx", q(rcol))
        cond = (F.col("_lb") == F.col("_rb")) & (F.abs(F.col("_lx") - F.col("_rx")) <= F.lit(width))
        if kind == "right_anti":
            return rb.join(lb, cond, "left_anti").drop("_rb", "_rx")
        return lb.join(rb, cond, kind).drop("_lb", "_rb", "_lx", "_rx")

    kind = how.lower().replace("_", "").removesuffix("outer") or "full"
    if kind in ("inner", "left", "leftsemi", "semi", "leftanti", "anti"):
        return joined(how, spread_left=False)
    if kind == "right":
        return joined("right", spread_left=True)
    if kind == "full":
        alone = joined("right_anti", spread_left=True)
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields]
        return joined("left", spread_left=False).union(alone.select(*nulls, *[q(c) for c in right.columns]))
    raise ValueError(how)


def concat_tables(dfs: Sequence[DataFrame]) -> DataFrame:
    """G13 ``concat``: stack with the union of columns (missing -> null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def pivot_table(df: DataFrame, index: Sequence[str], columns: str, values: str,
                aggfunc: str = "mean", categories: Sequence | None = None) -> DataFrame:
    """G14 ``pivot_table`` (mean by default).  Passing ``categories``
    skips the distinct-values job; otherwise Spark's pivot limit applies."""
    fn = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
          "median": F.median}[aggfunc]
    g = df.groupBy(*index)
    g = g.pivot(columns, list(categories)) if categories is not None else g.pivot(columns)
    return g.agg(fn(values))


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None = None,
         var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """G15 ``melt`` (rows with null values kept)."""
    value_vars = list(value_vars or [c for c in df.columns if c not in id_vars])
    return df.unpivot(list(id_vars), value_vars, var_name, value_name)


def get_dummies(df: DataFrame, cols: Sequence[str], categories: dict[str, Sequence[str]] | None = None,
                prefix_sep: str = "_") -> DataFrame:
    """G16 ``get_dummies``: one 0/1 column per category (sorted), original
    column dropped.  ``categories`` names a column's categories; where it
    doesn't, one distinct aggregate finds them - the list is as wide as the
    result's schema, which is a driver object anyway.  For columns with very
    many categories use ``dummies_long``."""
    out = df
    for c in cols:
        vals = (categories or {}).get(c)
        if vals is None:
            found = df.select(q(c).cast("string").alias("v")).where("v IS NOT NULL").distinct().collect()
            vals = sorted(r["v"] for r in found)
        out = out.withColumns({f"{c}{prefix_sep}{v}": (q(c).cast("string") == F.lit(v)).cast("int")
                               for v in vals}).drop(c)
    return out


def dummies_long(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """G16 in long form: (key, column_name, category) of every cell that is 1,
    for any number of categories and without a job of its own."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("category")) for c in cols])
    long = df.select(*[q(k) for k in key], F.inline(pairs))
    return long.where(F.col("category").isNotNull())


def unique_sorted(df: DataFrame, col: str) -> DataFrame:
    """G7 ``np.unique``: distinct non-null values, sorted."""
    return df.select(q(col)).where(q(col).isNotNull()).distinct().orderBy(q(col))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False,
                    rsd: float = 0.05) -> DataFrame:
    """Count of distinct non-null values per column - exact
    (``count_distinct``) or HyperLogLog++ (``approx_count_distinct``) when
    exact distinct sets would be too large to shuffle."""
    fn = (lambda c: F.approx_count_distinct(q(c), rsd)) if approx else (lambda c: F.count_distinct(q(c)))
    return df.agg(*[fn(c).alias(c) for c in cols])


def distinct_counts_bitmap(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact counts of distinct non-null values of whole-number columns, all
    columns in one exchange: each task sets a bit per value in bitmaps of 32,768
    values, and only bitmaps travel and are merged.  Ids and other dense numbers
    need an eighth of a byte per value of their range instead of a shuffled row
    per value; for sparse numbers (hashes) ``distinct_counts`` is smaller."""
    for c in cols:
        if not isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            raise ValueError(f"{c}: bitmaps hold whole numbers")
    cells = F.array(*[F.struct(F.lit(i).alias("c"), q(c).cast("bigint").alias("v")) for i, c in enumerate(cols)])
    long = df.select(F.inline(cells)).where("v IS NOT NULL")
    maps = long.groupBy("c", F.bitmap_bucket_number("v").alias("bucket")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("v"))).alias("n"))
    return maps.agg(*[F.coalesce(F.sum(F.when(F.col("c") == i, F.col("n"))), F.lit(0)).cast("bigint").alias(c)
                      for i, c in enumerate(cols)])


def linspace(df: DataFrame, col: str, num: int = 50) -> DataFrame:
    """G20 ``np.linspace`` over the observed range of ``col``:
    (i, x) with both endpoints included."""
    st = df.agg(F.min(q(col)).cast("double").alias("lo"), F.max(q(col)).cast("double").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(max(num - 1, 1)))
    pts = st.select(F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("i"), "lo", "hi")
    return pts.select("i", F.when(F.col("i") == num - 1, F.col("hi"))
                      .otherwise(F.col("lo") + F.col("i") * step).alias("x"))


def arange_per_group(df: DataFrame, group: str, count_col: str, name: str = "i") -> DataFrame:
    """G20 ``np.arange(n)`` per row: one output row per i in [0, n)."""
    return df.where(q(count_col) > 0).select(
        q(group), F.explode(F.sequence(F.lit(0), (q(count_col) - 1).cast("int"))).alias(name))
