"""Shape, kinds, missingness, describe, value counts, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kinds import (as_double, categorical_columns, is_numeric,
                                    numeric_columns, pandas_dtype_name, q,
                                    timestamp_columns)
from quarry.functions.wide import long_agg, unpivot


def _meta_frame(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


# --- C1-C3: schema facts -------------------------------------------------

def shape(df: DataFrame) -> DataFrame:
    """One row (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def column_kinds(df: DataFrame) -> DataFrame:
    """(ord, column_name, kind) with kind numeric|categorical; no job."""
    rows = [(i, f.name, "numeric" if is_numeric(f.dataType) else "categorical")
            for i, f in enumerate(df.schema.fields)]
    return _meta_frame(df, rows, "ord int, column_name string, kind string")


def column_types(df: DataFrame) -> DataFrame:
    """(ord, column_name, spark_type, dtype) where dtype is the pandas name."""
    rows = [(i, f.name, f.dataType.simpleString(), pandas_dtype_name(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return _meta_frame(df, rows, "ord int, column_name string, spark_type string, dtype string")


# --- C4-C5: missingness --------------------------------------------------

def _null_expr(name: str, dt: T.DataType):
    c = q(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C4: (ord, column_name, missing, present) in one scan; NaN counts as missing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or df.columns)

    def stats(i, name):
        miss = F.sum(F.when(_null_expr(name, types[name]), 1).otherwise(0)).cast("bigint")
        return [miss.alias("missing"), F.count(F.lit(1)).alias("rows")]

    out = long_agg(df, cols, stats)
    return out.select("ord", "column_name", "missing",
                      (F.col("rows") - F.col("missing")).alias("present"))


def missing_summary(df: DataFrame) -> DataFrame:
    """Total missing cells and ``col: n`` list of columns with gaps."""
    mc = missing_counts(df)
    return mc.agg(
        F.sum("missing").cast("bigint").alias("total_missing"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("missing") > 0, F.struct("ord", "column_name", "missing")))),
            lambda s: F.concat(s["column_name"], F.lit(": "), s["missing"].cast("string"))),
            ", ").alias("summary"),
    ).select("total_missing",
             F.when(F.col("total_missing") > 0, F.col("summary")).alias("summary"))


# --- C6-C7: describe -----------------------------------------------------

QUARTILES = [0.25, 0.5, 0.75]
DESCRIBE_SCHEMA = ("ord int, column_name string, count bigint, mean double, std double, "
                   "min double, p25 double, p50 double, p75 double, max double")


def _quantiles(c, method: str, accuracy: int):
    if method == "approx":
        return F.percentile_approx(c, QUARTILES, accuracy)
    return F.percentile(c, F.array(*[F.lit(p) for p in QUARTILES]))


def _moments(df: DataFrame, values: dict, extra_quantiles=None):
    """One chunked aggregate: count, mean, std (ddof 1), min, max per item."""
    names = list(values)

    def stats(i, name):
        c = values[name]
        out = [F.count(c).alias("count"), F.avg(c).alias("mean"),
               F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]
        if extra_quantiles is not None:
            out.append(extra_quantiles(c).alias("qs"))
        return out

    return long_agg(df, names, stats).orderBy("ord").collect()


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None,
                     method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """Pandas ``describe().T``: count, mean, std (ddof 1), min, quartiles
    (linear interpolation), max; one row per numeric column.

    ``exact`` finds the quartiles by distributed selection (bounded memory,
    a few scans for all columns together); ``approx`` uses a bounded sketch in the same
    scan as the moments; ``spark`` uses Spark's exact ``percentile`` (one
    scan, but a per-value map merged in one task)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or numeric_columns(df))
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], DESCRIBE_SCHEMA)
    values = {c: as_double(c, types[c]) for c in cols}
    if method in ("approx", "spark"):
        rows = _moments(df, values, lambda c: _quantiles(c, method, accuracy))
        qs = {(r["column_name"], p): (r["qs"][j] if r["qs"] is not None else None)
              for r in rows for j, p in enumerate(QUARTILES)}
    else:
        from quarry.functions.quantiles import column_profile
        prof = column_profile(df, values, QUARTILES)
        rows = [{"ord": i, "column_name": c, **{k: prof[c][k] for k in ("count", "mean", "std", "min", "max")}}
                for i, c in enumerate(cols)]
        qs = {(c, p): prof[c]["q"][p] for c in cols for p in QUARTILES}
    out = [(r["ord"], r["column_name"], r["count"], r["mean"], r["std"], r["min"],
            qs[(r["column_name"], .25)], qs[(r["column_name"], .5)], qs[(r["column_name"], .75)], r["max"])
           for r in rows]
    return spark.createDataFrame(out, DESCRIBE_SCHEMA)


def describe_datetime(df: DataFrame, cols: Sequence[str] | None = None,
                      method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """Describe of timestamp columns, computed on epoch micros."""
    cols = list(cols or timestamp_columns(df))
    micro_df = df.select(*[F.unix_micros(q(c).cast("timestamp")).cast("double").alias(c) for c in cols])
    d = describe_numeric(micro_df, cols, method, accuracy)

    def back(c):
        return F.timestamp_micros(F.floor(c).cast("bigint")).cast("timestamp_ntz")

    return d.select("ord", "column_name", "count", back(F.col("mean")).alias("mean"),
                    back(F.col("min")).alias("min"), back(F.col("p25")).alias("p25"),
                    back(F.col("p50")).alias("p50"), back(F.col("p75")).alias("p75"),
                    back(F.col("max")).alias("max"))


def numeric_summary(df: DataFrame, n_cols: int | None = None) -> DataFrame:
    """C11: min, max, mean of the numeric columns (of the first ``n_cols`` if given)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = numeric_columns(df)[:n_cols]

    def stats(i, name):
        c = as_double(name, types[name])
        return [F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
                F.count(c).alias("count")]

    return long_agg(df, cols, stats)


# --- C8-C10: value counts ------------------------------------------------

def as_text(name: str, dt: T.DataType):
    c = q(name)
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def _counts_with_nulls(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    """(ord, column_name, value, count) including the null group: the columns
    are unpivoted to text in one scan and counted in one hash aggregate;
    map-side partial aggregation absorbs hot values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(categorical_columns(df) if cols is None else cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "ord int, column_name string, value string, count bigint")
    counts = unpivot(df, [as_text(c, types[c]) for c in cols]).groupBy("ord", "x").agg(F.count(F.lit(1)).alias("count"))
    names = F.array(*[F.lit(c) for c in cols])
    return counts.select("ord", F.get(names, F.col("ord")).alias("column_name"), F.col("x").alias("value"), "count")


def value_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(ord, column_name, value, count) for every non-numeric column, nulls
    excluded.  Values are unpivoted to text and counted in one hash
    aggregate; map-side partial aggregation absorbs hot values.
    """
    return _counts_with_nulls(df, cols).where(F.col("value").isNotNull())


def top_values(df: DataFrame, k: int = 5, cols: Sequence[str] | None = None) -> DataFrame:
    """First ``k`` values per column by count desc, value asc, with the
    percent of *all* rows (1 decimal) and the number of remaining values.

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit
    before the exchange, so only k rows per column and task are shuffled.
    The per-column totals have one row per column (bounded by the schema).
    """
    vc = _counts_with_nulls(df, cols)
    per_col = vc.groupBy("ord", "column_name").agg(
        F.sum("count").alias("total_rows"), F.count("value").alias("n_values"))
    # the null group sorts last and is dropped after the window, so both
    # branches share one aggregate (and its exchange is reused)
    w = Window.partitionBy("ord", "column_name").orderBy(
        F.col("value").isNull(), F.desc("count"), F.asc("value"))
    top = (vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
           .where(F.col("value").isNotNull()))
    return (top.join(F.broadcast(per_col), ["ord", "column_name"])
            .select("ord", "column_name", "rank", "value", "count",
                    F.round(F.col("count") * 100.0 / F.col("total_rows"), 1).alias("pct"),
                    F.greatest(F.col("n_values") - k, F.lit(0)).alias("remaining")))


def top_category(df: DataFrame, n_cols: int | None = None) -> DataFrame:
    """Mode of the categorical columns (of the first ``n_cols`` if given; smallest value
    wins ties, as pandas ``mode()`` is sorted) and its count."""
    cols = categorical_columns(df)[:n_cols]
    t = top_values(df, 1, cols)
    return t.select("ord", "column_name", "value", "count")


# --- C12-C13: previews ---------------------------------------------------

def head_sample(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows by ``order_by`` (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def page(df: DataFrame, page_no: int, size: int, order_by: Sequence[str]) -> DataFrame:
    """Rows [page*size, page*size+size) by ``order_by``."""
    return df.orderBy(*order_by).offset(page_no * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """C13 companion: (total, pages = ceil(total / size))."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(size)).cast("bigint").alias("pages"))


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """C13 deep pages: keyset pagination - the ``size`` rows following
    ``after`` in ``key`` order; the predicate reaches the scan, so a deep
    page costs no more than the first."""
    c = q(key)
    return df.where(c > F.lit(after)).orderBy(c).limit(size)
