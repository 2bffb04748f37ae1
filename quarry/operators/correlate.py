"""Pearson correlation (pairwise complete), highlights, linear trend."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.kinds import as_double, numeric_columns, q
from quarry.session import ship_package

_MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy")


def _pair_moments(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Per task: count, means and co-moments of every pair of columns over the rows where both are
    present, merged batch by batch (updating formulas, so no large sums cancel)."""
    total = {k: np.zeros((d, d)) for k in _MOMENTS}
    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
        there = ~np.isnan(x)
        m = there.astype(float)
        mid = np.where(m.sum(axis=0) > 0, np.where(there, x, 0).sum(axis=0) / np.maximum(m.sum(axis=0), 1), 0.0)
        z = np.where(there, x - mid, 0.0)
        n = m.T @ m
        safe = np.maximum(n, 1)
        sx, sy = z.T @ m, m.T @ z
        new = {"n": n, "mx": mid[:, None] + sx / safe, "my": mid[None, :] + sy / safe,
               "cxx": (z * z).T @ m - sx * sx / safe, "cyy": m.T @ (z * z) - sy * sy / safe, "cxy": z.T @ z - sx * sy / safe}
        both = np.maximum(total["n"] + n, 1)
        w = total["n"] * n / both
        dx, dy = new["mx"] - total["mx"], new["my"] - total["my"]
        total["cxx"] += new["cxx"] + dx * dx * w
        total["cyy"] += new["cyy"] + dy * dy * w
        total["cxy"] += new["cxy"] + dx * dy * w
        total["mx"] += dx * n / both
        total["my"] += dy * n / both
        total["n"] += n
    i, j = np.triu_indices(d, 1)
    yield pa.RecordBatch.from_pydict({"a_ord": i.astype(np.int32), "b_ord": j.astype(np.int32),
                                      **{k: total[k][i, j] for k in _MOMENTS}})


def _merge(p, s):
    """Combine the moments of two disjoint sets of rows."""
    n = p["n"] + s["n"]
    safe = F.greatest(n, F.lit(1.0))
    dx, dy, w = s["mx"] - p["mx"], s["my"] - p["my"], p["n"] * s["n"] / safe
    return F.struct(n.alias("n"), (p["mx"] + dx * s["n"] / safe).alias("mx"), (p["my"] + dy * s["n"] / safe).alias("my"),
                    (p["cxx"] + s["cxx"] + dx * dx * w).alias("cxx"), (p["cyy"] + s["cyy"] + dy * dy * w).alias("cyy"),
                    (p["cxy"] + s["cxy"] + dx * dy * w).alias("cxy"))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(a_ord, a, b_ord, b, r, n) for each unordered numeric pair a<b.

    One scan however many pairs: every task sums the pairwise-complete
    moments of all pairs with matrix products and hands on one row per pair;
    these are merged per pair.  Empty when fewer than two numeric columns.
    A constant column gives a null r (pandas NaN).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or numeric_columns(df))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame(
            [], "a_ord int, a string, b_ord int, b string, r double, n bigint")
    ship_package(df.sparkSession)
    values = df.select(*[as_double(c, types[c]).alias(f"c{i}") for i, c in enumerate(cols)])
    parts = values.mapInArrow(partial(_pair_moments, d=len(cols)),
                              "a_ord int, b_ord int, " + ", ".join(f"{k} double" for k in _MOMENTS))
    kept = parts.groupBy("a_ord", "b_ord").agg(F.collect_list(F.struct(*_MOMENTS)).alias("parts"))     # one per task
    none = F.struct(*[F.lit(0.0).alias(k) for k in _MOMENTS])
    m = kept.withColumn("m", F.aggregate("parts", none, _merge)).select("a_ord", "b_ord", "m.*")
    r = F.when((F.col("cxx") > 0) & (F.col("cyy") > 0), F.col("cxy") / F.sqrt("cxx") / F.sqrt("cyy"))
    names = F.array(*[F.lit(c) for c in cols])
    return m.select("a_ord", F.get(names, F.col("a_ord")).alias("a"), "b_ord", F.get(names, F.col("b_ord")).alias("b"),
                    r.alias("r"), F.col("n").cast("bigint").alias("n"))


def correlation_highlights(df: DataFrame, k: int = 5, drop_perfect: bool = True,
                           cols: Sequence[str] | None = None) -> DataFrame:
    """Top ``k`` pairs by |r| over rows complete in *all* numeric
    columns; each unordered pair once; |r| == 1 dropped when
    ``drop_perfect`` (the reference's ``< 1.0`` filter)."""
    cols = list(cols or numeric_columns(df))
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = reduce(lambda a, b: a & b, [as_double(c, types[c]).isNotNull() for c in cols], F.lit(True))
    complete = df.select(*[q(c) for c in cols]).where(whole)
    cm = correlation_matrix(complete, cols).withColumn("abs_r", F.abs("r"))
    cm = cm.where(F.col("abs_r").isNotNull())
    if drop_perfect:
        cm = cm.where(F.col("abs_r") < 1.0)
    top = cm.orderBy(F.desc("abs_r"), "a_ord", "b_ord").limit(k)
    return top.select(
        "a", "b", "abs_r",
        F.format_string("Corr: %s <-> %s (|r|=%.2f)", "a", "b", "abs_r").alias("text"))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """D3: least-squares slope/intercept of y on x, r2 and pair count;
    constant x gives nulls."""
    xc, yc = q(x).cast("double"), q(y).cast("double")
    return df.agg(F.regr_slope(yc, xc).alias("slope"),
                  F.regr_intercept(yc, xc).alias("intercept"),
                  F.regr_r2(yc, xc).alias("r2"),
                  F.regr_count(yc, xc).alias("n"))
