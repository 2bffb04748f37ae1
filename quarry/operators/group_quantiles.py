"""Exact quantiles of many groups at once (G6), by distributed selection.

Spark's exact ``percentile`` keeps a value -> count map per group and merges
it in one task, so a key that holds a third of the rows brings a third of the
distinct values there.  Here all groups' order statistics are narrowed
together, and no step collects values:

* round 0 counts (group, log-scale bin) with each bin's least and greatest
  value, map-side;
* a running sum over a group's bins tells which bin holds a wanted rank.  The
  rank is settled if the bin holds one value, or the rank is its first or
  last; small groups are settled here;
* the other bins go back as brackets, one row per group that still has open
  ranks, and are joined to the rows; only rows inside a bracket are counted
  again, in ``BINS`` equal bins.

Groups and ranks stay in tables; only the question whether ranks are open
comes to the driver.  Nulls and NaN don't count; null keys are a group, and a
group without values has null quantiles.  Interpolation follows pandas and
DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.kinds import q
from quarry.functions.quantiles import BINS, _log_key
from quarry.session import materialize


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], other: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(keys, other, strict=True):
        on = on & left[a].eqNullSafe(right[b])
    return on


def _locate(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the bins (c values from mn to mx each, ``base`` values before their bracket), those that hold open
    ranks, with the number of values before them."""
    earlier = Window.partitionBy(*keys, "base").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("c").over(earlier), F.lit(0))
    held = bins.withColumn("before", before)
    inside = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))
    return held.withColumn("ranks", inside).where(F.size("ranks") > 0).select(*keys, "before", "c", "mn", "mx", "ranks")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """The keys, ``n`` (values of the group) and one column per entry of ``quantiles`` {name: share}."""
    ks = [f"k{i}" for i in range(len(keys))]
    x = q(value).cast("double")
    src = df.select(*[q(c).alias(k) for c, k in zip(keys, ks, strict=True)], F.when(~F.isnan(x), x).alias("x"))
    rows = src.where(F.col("x").isNotNull())
    sizes = src.groupBy(*ks).agg(F.count("x").alias("n"))
    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in quantiles.items()}
    wanted = F.array_distinct(F.array(*[f(v).cast("bigint") for v in place.values() for f in (F.floor, F.ceil)]))
    first = rows.groupBy(*ks, _log_key(F.col("x")).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx"))
    # a group's size is the sum over its bins, so no second scan is needed
    first = first.withColumn("n", F.sum("c").over(Window.partitionBy(*ks))).select(*ks, "bin", "c", "mn", "mx", wanted.alias("ranks"), F.lit(0).cast("bigint").alias("base"))
    settled, bins = None, first
    while True:
        found = materialize(_locate(bins, ks), "group-ranks")
        sure = lambda r: (F.col("mn") == F.col("mx")) | (r == F.col("before")) | (r == F.col("before") + F.col("c") - 1)
        done = found.select(*ks, "before", "mn", "mx", F.explode(F.filter("ranks", sure)).alias("r")).select(
            *ks, "r", F.when(F.col("r") == F.col("before"), F.col("mn")).otherwise(F.col("mx")).alias("v"))
        settled = done if settled is None else settled.unionByName(done)
        left = found.withColumn("ranks", F.filter("ranks", lambda r: ~sure(r))).where(F.size("ranks") > 0)
        if left.isEmpty():
            break
        brackets = left.groupBy(*[F.col(k).alias(f"b{k}") for k in ks]).agg(
            F.collect_list(F.struct(F.col("mn").alias("lo"), F.col("mx").alias("hi"), F.col("before").alias("base"), "ranks")).alias("open"))
        near = rows.join(brackets, _same(rows, brackets, ks, [f"b{k}" for k in ks]))
        near = near.select(*ks, "x", F.explode(F.filter("open", lambda b: (F.col("x") >= b["lo"]) & (F.col("x") <= b["hi"]))).alias("b"))
        # halving the operands keeps hi - lo finite for any two doubles
        share = (F.col("x") / 2 - F.col("b.lo") / 2) / (F.col("b.hi") / 2 - F.col("b.lo") / 2)
        cut = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        bins = near.groupBy(*ks, F.col("b.base").alias("base"), F.col("b.ranks").alias("ranks"), cut.alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx"))
    ranked = settled.groupBy(*[F.col(k).alias(f"s{k}") for k in ks]).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))
    out = sizes.join(ranked, _same(sizes, ranked, ks, [f"s{k}" for k in ks]), "left")
    cells = []
    for name, p in place.items():
        lo, hi = (F.col("at")[f(p).cast("bigint")] for f in (F.floor, F.ceil))
        cells.append(F.when(F.col("n") > 0, F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (p - F.floor(p)))).alias(name))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keys, ks, strict=True)], "n", *cells)
