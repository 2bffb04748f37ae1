"""The data behind the reference's charts (no rendering).

Multi-pass operators follow one pattern: pass 1 is a single aggregate row
of O(#columns) parameters (ranges, quartiles, widths) read on the driver;
pass 2 is one distributed aggregate whose output is bounded by
bins x columns.  Nothing proportional to the rows reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kinds import as_double, numeric_columns, q
from quarry.operators.density import kde_by_group, kde_curve  # noqa: F401  (F3 and F7 belong to the charts)
from quarry.operators.outliers import iqr_bounds
from quarry.operators.profile import missing_counts, value_counts
from quarry.session import materialize

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
HIST_SCHEMA = "ord int, column_name string, bin bigint, lo double, hi double, count bigint"


def _finite(x):
    return F.when(F.abs(x) < float("inf"), x)


def _bin(x, lo, hi, nb):
    """Number of the equal-width bin; -1 for negative and ``nb`` for positive infinity, null for null."""
    inside = F.lit(0) if hi == lo else F.least(F.floor((x - F.lit(lo)) * F.lit(float(nb)) / F.lit(hi - lo)), F.lit(nb - 1))
    # least() skips nulls, so guard: a null value has no bin
    return F.when(x == float("inf"), F.lit(nb)).when(x == float("-inf"), F.lit(-1)).when(x.isNotNull(), inside)


def _range_stats(df, cols, with_quartiles, method="exact"):
    """One aggregate of count/min/max of the finite values per column (+ their
    quartiles when asked) and the count of infinite ones; returned as a
    dict-like row keyed n{i}, lo{i}, hi{i}, inf{i}, q{i}."""
    from quarry.functions.quantiles import exact_quantiles
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(cols):
        every = as_double(c, types[c])
        x = _finite(every)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 (F.count(every) - F.count(x)).alias(f"inf{i}")]
        if with_quartiles and method == "approx":
            aggs.append(F.percentile_approx(x, [0.25, 0.75], 10000).alias(f"q{i}"))
    row = df.agg(*aggs).first().asDict()
    if with_quartiles and method != "approx":
        values = {c: _finite(as_double(c, types[c])) for c in cols}
        qv = exact_quantiles(df, values, [0.25, 0.75])
        for i, c in enumerate(cols):
            row[f"q{i}"] = [qv[(c, 0.25)], qv[(c, 0.75)]] if row[f"n{i}"] else None
    return row


def auto_bin_count(n: int, lo: float, hi: float, q1: float, q3: float,
                   integral: bool) -> int:
    """numpy's 'auto' rule: the smaller of Sturges and Freedman-Diaconis
    widths (FD only when positive); integer data keeps width >= 1."""
    rng = hi - lo
    if n == 0 or rng == 0:
        return 1
    sturges = rng / (math.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * math.pow(n, -1.0 / 3.0)
    w = min(fd, sturges) if fd > 0 else sturges
    if integral and w < 1:
        w = 1.0
    return int(max(1, math.ceil(rng / w)))


def _histogram(df, specs, empty: bool):
    """specs: list of (ord, name, lo, hi, nbins).  ``empty``: bins without
    rows too (for a fixed number of bins); else occupied bins only, so the
    result is bounded by the rows, not by range and width."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    if not specs:
        return spark.createDataFrame([], HIST_SCHEMA)
    specs = [(o, c, lo, hi, nb if hi > lo else 1) for o, c, lo, hi, nb in specs]
    arms = [F.struct(F.lit(o).alias("ord"), _bin(as_double(c, types[c]), lo, hi, nb).cast("bigint").alias("bin"))
            for o, c, lo, hi, nb in specs]
    long = df.select(F.inline(F.array(*arms))).where(F.col("bin").isNotNull())
    counts = long.groupBy("ord", "bin").agg(F.count(F.lit(1)).alias("count"))
    columns = spark.createDataFrame(specs, "ord int, column_name string, mn double, mx double, nb bigint")     # one row per column
    if empty:
        every = columns.select("ord", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)).alias("bin"), F.lit(0).cast("bigint").alias("count"))
        counts = counts.unionByName(every).groupBy("ord", "bin").agg(F.sum("count").alias("count"))
    out = counts.join(F.broadcast(columns), "ord")
    flat, step = F.col("mx") == F.col("mn"), (F.col("mx") - F.col("mn")) / F.col("nb")
    below, above = F.col("bin") < 0, F.col("bin") == F.col("nb")
    infinite = F.when(below, F.lit(float("-inf"))).when(above, F.lit(float("inf")))
    lo = F.coalesce(infinite, F.when(flat, F.col("mn") - 0.5).otherwise(F.col("mn") + F.col("bin") * step))
    hi = F.coalesce(infinite, F.when(flat, F.col("mx") + 0.5).when(F.col("bin") == F.col("nb") - 1, F.col("mx")).otherwise(
        F.col("mn") + (F.col("bin") + 1) * step))
    return out.select("ord", "column_name", "bin", lo.alias("lo"), hi.alias("hi"),
                      F.col("count").cast("bigint").alias("count"))


def histogram_auto(df: DataFrame, cols: Sequence[str] | None = None, max_plots: int | None = None,
                   method: str = "exact", sample: int | None = None,
                   key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """histograms of the numeric columns (of the first ``max_plots`` if
    given) with the automatic bin width; nulls dropped; last edge closed;
    occupied bins only.  Range and width are those of the finite values;
    infinite ones are counted in bin -1 and in the one after the last.  ``sample`` (with
    a ``key``) bins an exact seeded sample of that many rows instead of the
    whole column, as the reference does with 50 000 rows."""
    cols = list(cols or numeric_columns(df))[:max_plots]
    if sample is not None:
        df = sample_rows(df, sample, list(key or df.columns), seed)
    if not cols:
        return df.sparkSession.createDataFrame([], HIST_SCHEMA)
    r = _range_stats(df, cols, True, method)
    types = {f.name: f.dataType for f in df.schema.fields}
    specs = []
    for i, c in enumerate(cols):
        n, lo, hi, qs = r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"], r[f"q{i}"]
        if not n:
            if r[f"inf{i}"]:
                specs.append((i, c, 0.0, 0.0, 1))
            continue
        nb = auto_bin_count(n, lo, hi, qs[0], qs[1], isinstance(types[c], _INTEGRAL))
        specs.append((i, c, lo, hi, nb))
    return _histogram(df, specs, empty=False)


def histogram_fixed(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins over [min, max] (right edge closed);
    a constant column gives one bin.  Infinite values as in ``histogram_auto``."""
    cols = list(cols or numeric_columns(df))
    if not cols:
        return df.sparkSession.createDataFrame([], HIST_SCHEMA)
    r = _range_stats(df, cols, False)
    specs = [(i, c, r[f"lo{i}"], r[f"hi{i}"], bins) if r[f"n{i}"] else (i, c, 0.0, 0.0, 1)
             for i, c in enumerate(cols) if r[f"n{i}"] or r[f"inf{i}"]]
    return _histogram(df, specs, empty=True)


def missingness_bar(df: DataFrame) -> DataFrame:
    """(ord, column_name, present, share) per column."""
    mc = missing_counts(df)
    return mc.select("ord", "column_name", "present",
                     (F.col("present") / (F.col("present") + F.col("missing"))).alias("share"))


def missingness_matrix(df: DataFrame, key: str, bands: int = 20) -> DataFrame:
    """presence share per (row band, column) and row completeness per
    band.  Bands are equal ranges of ``key`` (a global ``ntile`` would pull
    every row into one partition)."""
    empty = df.sparkSession.createDataFrame(
        [], "band int, ord int, column_name string, rows bigint, present_share double, row_completeness double")
    kind = df.schema[key].dataType
    names = df.columns
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        k = q(key).cast("timestamp") if isinstance(kind, (T.DateType, T.TimestampNTZType)) else q(key)
        kx = F.unix_micros(k).cast("double") if not isinstance(kind, (T.NumericType, T.BooleanType)) else k.cast("double")
        r = df.agg(F.min(kx).alias("lo"), F.max(kx).alias("hi")).first()
        lo, hi = r["lo"], r["hi"]
        if lo is None:
            return empty
        band = F.when(kx.isNotNull(), F.least(
            F.floor((kx - F.lit(lo)) * F.lit(float(bands)) / F.lit(hi - lo + 1.0)).cast("int"), F.lit(bands - 1)))
    else:
        # keys without a distance: ranges of about equal numbers of rows
        ranged = df.repartitionByRange(bands, q(key)).withColumn("_band", F.spark_partition_id())
        df, band = materialize(ranged, "key-bands"), F.when(q(key).isNotNull(), F.col("_band"))
    cols = names
    flags = [F.when(q(c).isNotNull(), 1.0).otherwise(0.0) for c in cols]
    complete = sum(flags[1:], flags[0]) / F.lit(float(len(cols)))
    agg = df.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(complete).alias("row_completeness"),
        *[F.avg(f).alias(f"p{i}") for i, f in enumerate(flags)])
    structs = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column_name"),
                        F.col(f"p{i}").alias("present_share")) for i, c in enumerate(cols)]
    return agg.select("band", "rows", "row_completeness", F.inline(F.array(*structs))).select(
        "band", "ord", "column_name", "rows", "present_share", "row_completeness")


def category_bars(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """value counts with a colour mark: the most frequent value green,
    the least frequent red, the rest yellow (ties: value ascending).
    First and last come from ``min_by``/``max_by`` aggregates, so no
    per-column window holds all distinct values in one task."""
    vc = value_counts(df, cols)
    order = F.struct((-F.col("count")).alias("nc"), F.col("value"))
    ends = vc.groupBy("ord", "column_name").agg(
        F.min_by("value", order).alias("first_value"),
        F.max_by("value", order).alias("last_value"))
    return (vc.join(F.broadcast(ends), ["ord", "column_name"])
            .select("ord", "column_name", "value", "count",
                    F.when(F.col("value") == F.col("first_value"), "green")
                    .when(F.col("value") == F.col("last_value"), "red")
                    .otherwise("yellow").alias("color")))


def box_stats(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """five numbers, whiskers at the furthest points inside k*IQR, and
    the number of fliers, per numeric column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    bounds = iqr_bounds(df, cols, k, extra=[0.5])
    spark = df.sparkSession
    schema = ("ord int, column_name string, min double, q1 double, median double, q3 double, "
              "max double, whisker_low double, whisker_high double, fliers bigint")
    if not bounds:
        return spark.createDataFrame([], schema)
    structs = []
    for b in bounds:
        x = as_double(b["column_name"], types[b["column_name"]])
        if b["lower"] is None:
            inside = F.lit(False)
            out = F.lit(False)
        else:
            inside = (x >= F.lit(b["lower"])) & (x <= F.lit(b["upper"]))
            out = (x < F.lit(b["lower"])) | (x > F.lit(b["upper"]))
        structs.append(F.struct(
            F.lit(b["ord"]).alias("ord"), F.lit(b["column_name"]).alias("column_name"),
            F.min(x).alias("min"), F.lit(b["q1"]).cast("double").alias("q1"),
            F.lit(b["extra"][0.5]).cast("double").alias("median"),
            F.lit(b["q3"]).cast("double").alias("q3"),
            F.max(x).alias("max"), F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.count_if(F.coalesce(out, F.lit(False))).cast("bigint").alias("fliers")).alias(f"s{b['ord']}"))
    return df.agg(*structs).select(F.inline(F.array(*[F.col(f"s{b['ord']}") for b in bounds])))


def pair_bins(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """F8: 2-D histogram for every numeric pair (scatter/pair-plot data at
    any scale): (a, b, bin_x, bin_y, count); rows with a null in the pair skipped.
    Infinite values are in bin -1 and in the one after the last."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or numeric_columns(df))
    schema = "a_ord int, a string, b_ord int, b string, bin_x int, bin_y int, count bigint"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    r = _range_stats(df, cols, False)

    def bin_of(i):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
        return _bin(as_double(cols[i], types[cols[i]]), lo, hi, bins if hi > lo else 1).cast("int")

    bx = {i: bin_of(i) for i in range(len(cols))}
    arms = [F.struct(F.lit(i).alias("a_ord"), F.lit(cols[i]).alias("a"), F.lit(j).alias("b_ord"),
                     F.lit(cols[j]).alias("b"), bx[i].alias("bin_x"), bx[j].alias("bin_y"))
            for i, j in combinations(range(len(cols)), 2)]
    long = df.select(F.inline(F.array(*arms))).where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
    return long.groupBy("a_ord", "a", "b_ord", "b", "bin_x", "bin_y").agg(
        F.count(F.lit(1)).alias("count"))


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42,
                oversample: float = 1.3) -> DataFrame:
    """exactly ``min(n, rows)`` rows without replacement, deterministic
    for a seed: the rows with the smallest ``xxhash64(key, seed)``.

    A first count fixes a hash threshold that keeps about
    ``oversample * n`` rows; only those are sorted, so no task ever merges
    n rows from every partition.  The threshold doubles until at least n
    rows pass (rarely needed)."""
    h = F.xxhash64(*[q(c) for c in key], F.lit(seed))
    u = (F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53)))
    tagged = df.withColumn("_u", u)
    total = df.count()
    if total <= n:
        return tagged.orderBy("_u", *key).drop("_u")
    frac = min(1.0, oversample * n / total + 10.0 / total)
    while True:
        cand = tagged.where(F.col("_u") < F.lit(frac))
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 2)
    return cand.orderBy("_u", *key).limit(n).drop("_u")


def pair_sample(df: DataFrame, n: int, key: Sequence[str], cols: Sequence[str] | None = None,
                seed: int = 42) -> DataFrame:
    """F8 scatter/line data: exactly ``n`` seeded sample rows (F9) with the
    key and the numeric columns, for plotting every pair."""
    cols = list(cols or numeric_columns(df))
    return sample_rows(df.select(*[q(k) for k in key], *[q(c) for c in cols if c not in key]),
                       n, key, seed)
