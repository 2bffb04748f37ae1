"""IQR and z-score outliers (counts and rows).

Pass 1 is a single aggregate row holding O(#columns) bounds; it is read
back and the bounds become literals in pass 2, so the second scan is a
plain filter/aggregate that Catalyst can code-generate and push down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.kinds import as_double, numeric_columns


def _quartiles(c, method, accuracy):
    if method == "approx":
        return F.percentile_approx(c, [0.25, 0.75], accuracy)
    return F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))


def iqr_bounds(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
               method: str = "exact", accuracy: int = 10000, extra: Sequence[float] = ()) -> list[dict]:
    """Pass 1 of E1 (driver receives O(#columns) numbers): per column q1,
    q3 and the fences.  ``exact`` uses distributed selection; ``approx`` a
    bounded sketch; ``spark`` Spark's exact ``percentile``.  ``extra`` shares
    come out of the same exact search, under ``extra``."""
    from quarry.functions.quantiles import exact_quantiles
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or numeric_columns(df))
    if not cols:
        return []
    more: dict[str, dict] = {}
    if method == "exact":
        qv = exact_quantiles(df, {c: as_double(c, types[c]) for c in cols}, [0.25, 0.75, *extra])
        more = {c: {p: qv[(c, p)] for p in extra} for c in cols}
        qs = {c: (qv[(c, 0.25)], qv[(c, 0.75)]) for c in cols}
    else:
        row = df.agg(*[_quartiles(as_double(c, types[c]), method, accuracy).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        qs = {c: ((row[f"q{i}"][0], row[f"q{i}"][1]) if row[f"q{i}"] is not None else (None, None))
              for i, c in enumerate(cols)}
    out = []
    for i, c in enumerate(cols):
        q1, q3 = qs[c]
        lo = hi = None
        if q1 is not None:
            iqr = q3 - q1
            lo, hi = q1 - k * iqr, q3 + k * iqr
        out.append({"ord": i, "column_name": c, "q1": q1, "q3": q3, "lower": lo, "upper": hi, "extra": more.get(c, {})})
    return out


def zscore_bounds(df: DataFrame, cols: Sequence[str] | None = None) -> list[dict]:
    """Pass 1 of E2: per column mean and population std (ddof 0)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or numeric_columns(df))
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        x = as_double(c, types[c])
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return [{"ord": i, "column_name": c, "mean": row[f"m{i}"], "std": row[f"s{i}"]}
            for i, c in enumerate(cols)]


def _iqr_flag(df, b):
    x = as_double(b["column_name"], df.schema[b["column_name"]].dataType)
    if b["lower"] is None:
        return F.lit(False)
    return F.coalesce((x < F.lit(b["lower"])) | (x > F.lit(b["upper"])), F.lit(False))


def _z_flag(df, b, threshold):
    x = as_double(b["column_name"], df.schema[b["column_name"]].dataType)
    if b["std"] is None or b["std"] == 0:
        return F.lit(False)          # constant or empty column: no outliers
    z = F.abs((x - F.lit(b["mean"])) / F.lit(b["std"]))
    return F.coalesce(z > F.lit(threshold), F.lit(False))


def _count_flags(df, bounds, flags):
    spark = df.sparkSession
    if not bounds:
        return spark.createDataFrame([], "ord int, column_name string, outliers bigint")
    one = df.agg(*[F.count_if(f).alias(f"c{b['ord']}") for b, f in zip(bounds, flags)])
    structs = [F.struct(F.lit(b["ord"]).alias("ord"), F.lit(b["column_name"]).alias("column_name"),
                        F.col(f"c{b['ord']}").cast("bigint").alias("outliers")) for b in bounds]
    return one.select(F.inline(F.array(*structs)))


def outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
                 method: str = "exact") -> DataFrame:
    """(ord, column_name, q1, q3, lower, upper, outliers); strict
    inequalities, nulls never outliers."""
    bounds = iqr_bounds(df, cols, k, method)
    counts = _count_flags(df, bounds, [_iqr_flag(df, b) for b in bounds])
    meta = df.sparkSession.createDataFrame(
        [(b["ord"], b["q1"], b["q3"], b["lower"], b["upper"]) for b in bounds],
        "ord int, q1 double, q3 double, lower double, upper double")
    return counts.join(F.broadcast(meta), "ord").select(
        "ord", "column_name", "q1", "q3", "lower", "upper", "outliers")


def outliers_zscore(df: DataFrame, cols: Sequence[str] | None = None,
                    threshold: float = 3.0) -> DataFrame:
    """(ord, column_name, outliers) with |x-mean|/std_pop > threshold."""
    bounds = zscore_bounds(df, cols)
    return _count_flags(df, bounds, [_z_flag(df, b, threshold) for b in bounds])


def outlier_rows(df: DataFrame, method: str = "iqr", cols: Sequence[str] | None = None,
                 k: float = 1.5, threshold: float = 3.0) -> DataFrame:
    """The rows with at least one outlying value, plus
    ``outlier_columns`` (comma-joined, schema order)."""
    if method == "iqr":
        bounds = iqr_bounds(df, cols, k)
        flags = [_iqr_flag(df, b) for b in bounds]
    else:
        bounds = zscore_bounds(df, cols)
        flags = [_z_flag(df, b, threshold) for b in bounds]
    if not bounds:
        return df.limit(0).withColumn("outlier_columns", F.lit(None).cast("string"))
    names = F.array_compact(F.array(*[F.when(f, F.lit(b["column_name"]))
                                      for b, f in zip(bounds, flags)]))
    return (df.withColumn("outlier_columns", F.array_join(names, ","))
            .where(F.col("outlier_columns") != ""))
