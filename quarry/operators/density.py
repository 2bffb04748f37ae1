"""Gaussian density curves (F3, F7) by a fast Gauss transform.

A curve's height at a grid point sums exp(-((g - v) / h)^2 / 2) over all rows.
Instead of meeting every row with every point, rows are summed in cells as
wide as the bandwidth h.  With t = (v - c) / (sqrt(2) h) around a cell's
centre c and y = (g - c) / (sqrt(2) h), the kernel is a Hermite series

    exp(-(y - t)^2) = sum_k  t^k / k!  h_k(y),   h_{k+1} = 2 y h_k - 2 k h_{k-1},  h_0 = exp(-y^2)

so a cell is known by ``TERMS`` moments, which one aggregate takes in the scan.
Points then meet occupied cells, and only those within ``REACH`` bandwidths:
at most cells x points rows, whatever the number of rows.

As |t| <= 1 / (2 sqrt 2) and |h_k(y)| < 1.09 sqrt(2^k k!) (Cramer), the terms
left out of a kernel add up to less than 1.09 sum_{k >= TERMS} 2^-k / sqrt(k!),
1e-13 at 18 terms, and what lies beyond the reach to exp(-36) each; a density
is off by at most ``error_bound(h)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.kinds import as_double, q

TERMS = 18
REACH = 9.0


def error_bound(h: float, terms: int = TERMS) -> float:
    """How far a density of bandwidth ``h`` may be from the exact sum."""
    left_out = 1.09 * sum(0.5 ** k / math.sqrt(math.factorial(k)) for k in range(terms, terms + 60))
    return (left_out + math.exp(-(REACH - 0.5) ** 2 / 2)) / (h * math.sqrt(2 * math.pi))


def _series(moments: Column, y: Column) -> Column:
    """The Hermite series of a cell at y."""
    start = F.struct(F.lit(0.0).alias("before"), F.exp(-y * y).alias("now"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("k"))
    return F.aggregate(moments, start, lambda a, m: F.struct(
        a["now"].alias("before"), (2 * y * a["now"] - 2 * a["k"] * a["before"]).alias("now"),
        (a["sum"] + m * a["now"]).alias("sum"), (a["k"] + 1).alias("k")), lambda a: a["sum"])


def _curves(values: DataFrame, points: int, terms: int) -> DataFrame:
    """values: g, v (finite).  g, point, x, density, n for every group with at least two distinct values."""
    stats = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    stats = stats.where((F.col("sd") > 0) & (F.col("hi") > F.col("lo"))).select(
        "g", "n", "lo", (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("h"), ((F.col("hi") - F.col("lo")) / F.lit(float(points - 1))).alias("step"))
    width = F.lit(math.sqrt(2.0)) * F.col("h")
    rows = values.join(stats.select("g", "lo", "h"), "g").withColumn("cell", F.floor((F.col("v") - F.col("lo")) / F.col("h")))
    centre = F.col("lo") + (F.col("cell") + 0.5) * F.col("h")
    t = (F.col("v") - centre) / width
    cells = rows.select("g", "cell", t.alias("t")).groupBy("g", "cell").agg(
        F.array(F.count(F.lit(1)).cast("double"), *[F.sum(F.pow("t", F.lit(k))) / F.lit(float(math.factorial(k))) for k in range(1, terms)]).alias("m"))
    near = cells.join(stats, "g").withColumn("c", centre)
    first = F.greatest(F.lit(0), F.ceil((F.col("c") - REACH * F.col("h") - F.col("lo")) / F.col("step")))
    last = F.least(F.lit(points - 1), F.floor((F.col("c") + REACH * F.col("h") - F.col("lo")) / F.col("step")))
    near = near.withColumn("a", first).withColumn("b", last).where("a <= b").withColumn("point", F.explode(F.sequence("a", "b")))
    y = (F.col("lo") + F.col("point") * F.col("step") - F.col("c")) / width
    sums = near.withColumn("y", y).groupBy("g", "point").agg(F.sum(_series(F.col("m"), F.col("y"))).alias("s"))
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    norm = F.lit(1.0) / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return grid.join(sums.select(F.col("g").alias("sg"), F.col("point").cast("int").alias("sp"), "s"),
                     (F.col("g") == F.col("sg")) & (F.col("point") == F.col("sp")), "left").select(
        "g", "point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce("s", F.lit(0.0)) * norm).alias("density"), F.col("n").cast("bigint").alias("n"))


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def kde_curve(df: DataFrame, col: str, points: int = 200, terms: int = TERMS) -> DataFrame:
    """Gaussian density with Scott's bandwidth h = std * n^(-1/5) on ``points`` grid points over [min, max]
    of the finite values: (point, x, density, n).  A column with fewer than two distinct values has no curve."""
    v = _finite(as_double(col, df.schema[col].dataType))
    # one group, by an expression: a literal key would be folded away and leave a join without a key
    values = df.select(F.when(v.isNull(), 1).otherwise(0).alias("g"), v.alias("v")).where(F.col("v").isNotNull())
    return _curves(values, points, terms).drop("g")


def kde_by_group(df: DataFrame, col: str, group: str, points: int = 200, terms: int = TERMS) -> DataFrame:
    """F7 violin data: F3 per group, each with its own bandwidth and grid: (group, point, x, density, n)."""
    v = _finite(as_double(col, df.schema[col].dataType))
    values = df.select(q(group).alias("g"), v.alias("v")).where(F.col("v").isNotNull() & F.col("g").isNotNull())
    return _curves(values, points, terms).withColumnRenamed("g", group)
