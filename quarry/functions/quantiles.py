"""Exact quantiles (and moments) from mergeable sketches and brackets.

Spark's exact ``percentile`` keeps a value->count map per group and merges
it in one task, so memory and time grow with the number of distinct
values.  Here the table is scanned twice, whatever its size:

* scan 1 - one aggregate of count, mean, deviation, min, max and a KLL
  sketch per column.  The sketch's quantiles around each target rank, wider
  than its rank error, are a bracket that very likely holds the target;
* scan 2 - values inside brackets are kept (distinct value, count), the
  others only counted per zone between brackets.  The result, a small
  share of the values, is written as a table.

The counts below a bracket prove that it holds its rank.  Inside, and in
the unlikely case of a bracket that misses, ranks are found by refinement:
bins that hold a target rank are cut into ``BINS`` equal ones until the bin
holds a single value or the rank is its first or last.

Sketches draw random bits, so brackets may differ between runs; the values
found do not.  The driver holds a bracket per column and rank and at most
``BINS`` bins for each.  Interpolation follows pandas/DuckDB
``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.wide import long_agg, unpivot
from quarry.session import materialize

BINS = 1024
#: Size of a sketch, and half the width of a bracket as a share of the rows: twice the rank error of that size at
#: 99 % confidence (0.24 %).
SKETCH_K = 2048
_MARGIN = 0.005
_LOG_STEPS = 16
_INF_KEY = 1_000_000


def _ranks(n: int, p: float):
    r = p * (n - 1)
    return math.floor(r), math.ceil(r), r - math.floor(r)


def _log_key(x: Column) -> Column:
    """Monotonic bin key: sign-mirrored floor(16 log2|x|); zero -> 0,
    infinities -> +-1e6.  Each key is a contiguous range of values."""
    k = F.lit(100_000) + F.floor(F.log2(F.abs(x)) * F.lit(float(_LOG_STEPS)))
    inf = F.lit(float("inf"))
    return (F.when(x == inf, F.lit(_INF_KEY)).when(x == -inf, F.lit(-_INF_KEY))
            .when(x > 0, k).when(x < 0, -k).otherwise(F.lit(0)))


def _zones(long: DataFrame, spans: dict[int, list[tuple]]) -> DataFrame:
    """``long`` (ord, x, ..) with ``b``, the bounds of the column's disjoint ascending intervals, and ``zone``: 2j + 1
    inside the j-th interval, 2j before it.  The bounds are a literal table, so code doesn't grow with columns."""
    most = max(len(found) for found in spans.values())
    # NaN lies above every value, so intervals that a column lacks are never reached
    rows = [[float(b) for span in spans.get(i, []) for b in span] for i in range(max(spans) + 1)]
    table = F.array(*[F.array(*[F.lit(b) for b in row + [math.nan] * (2 * most - len(row))]) for row in rows])
    zone = F.lit(0)
    for j in range(most):
        zone = zone + (F.col("x") >= F.get("b", F.lit(2 * j))).cast("int") + (F.col("x") > F.get("b", F.lit(2 * j + 1))).cast("int")
    return long.withColumn("b", F.get(table, F.col("ord"))).withColumn("zone", zone)


def _zoned(df: DataFrame, values: dict[str, Column], brackets: dict[str, list[tuple]]) -> DataFrame:
    """(ord, zone, x, c): the distinct values inside brackets (odd zones) with their counts; a zone between brackets is
    one row with a null value.  One scan, one aggregate."""
    long = unpivot(df, [values[name] for name in brackets], F.col("x").isNotNull())
    zoned = _zones(long, dict(enumerate(brackets.values()))).select("ord", "x", "zone")
    return (zoned.groupBy("ord", "zone", F.when(F.col("zone") % 2 == 1, F.col("x")).alias("x"))
            .agg(F.count(F.lit(1)).alias("c")))


def _refine(rows: DataFrame, pending: dict) -> dict:
    """``rows`` (ord, x, c); pending: {(ord, lo, hi, below): {ranks}} -> {(ord, rank): value}.
    One pass per round for all columns: each pending interval is cut into
    ``BINS`` equal bins until the bin with the rank holds one value."""
    out: dict[tuple, float] = {}
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    # halving the operands keeps hi - lo finite for any two doubles
    width = hi / 2 - lo / 2
    share = (x / 2 - lo / 2) / F.when(width > 0, width).otherwise(1.0)
    inf = F.lit(float("inf"))
    cut = (F.when(x == -inf, F.lit(-1)).when(x == inf, F.lit(_INF_KEY)).when((lo == -inf) | (hi == inf), _log_key(x))
           .otherwise(F.least(F.floor(share * F.lit(float(BINS))), F.lit(BINS - 1))))
    while pending:
        spans: dict[int, list] = {}
        for i, low, high, _ in sorted(pending):          # disjoint intervals of one column
            spans.setdefault(i, []).append((low, high))
        held = _zones(rows.select("ord", "x", "c"), spans).where(F.col("zone") % 2 == 1).select(
            "ord", "zone", "x", "c", F.get("b", F.col("zone") - 1).alias("lo"), F.get("b", F.col("zone")).alias("hi"))
        bins = held.groupBy("ord", "zone", cut.alias("bin")).agg(
            F.sum("c").alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx"))
        found: dict[tuple, list] = {}
        for r in bins.collect():   # at most BINS rows (or occupied log bins) per pending rank
            found.setdefault((r["ord"], *spans[r["ord"]][r["zone"] // 2]), []).append(r)
        nxt: dict = {}
        for (i, low, high, below), ranks in pending.items():
            acc = below
            for r in sorted(found.get((i, low, high), []), key=lambda r: r["mn"]):
                hit = {k for k in ranks if acc <= k < acc + r["c"]}
                # the first and last value of a bin are its least and greatest
                ends = {acc: r["mn"], acc + r["c"] - 1: r["mx"]}
                out.update({(i, k): (r["mn"] if r["mn"] == r["mx"] else ends[k]) for k in hit
                            if r["mn"] == r["mx"] or k in ends})
                rest = {k for k in hit if (i, k) not in out}
                if rest:
                    nxt.setdefault((i, r["mn"], r["mx"], acc), set()).update(rest)
                acc += r["c"]
        pending = nxt
    return out


def _disjoint(spans: list[tuple]) -> list[tuple]:
    """Overlapping intervals joined, in ascending order."""
    out: list[tuple] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _select(df: DataFrame, values: dict[str, Column], brackets: dict[str, list[tuple]], ranks: dict[str, set]) -> dict:
    """{(name, rank): value}: scan 2 and the refinement of what it kept."""
    names = list(brackets)
    kept = materialize(_zoned(df, values, brackets), "quantile-brackets")
    counts = {(r["ord"], r["zone"]): r["c"] for r in kept.groupBy("ord", "zone").agg(F.sum("c").alias("c")).collect()}
    pending: dict = {}
    missed: dict = {}
    for i, name in enumerate(names):
        below, zones = 0, []
        for zone in range(2 * len(brackets[name]) + 1):
            zones.append((zone, below, counts.get((i, zone), 0)))
            below += zones[-1][2]
        for k in ranks[name]:
            zone, base, _ = next(z for z in zones if z[1] <= k < z[1] + z[2])
            if zone % 2:
                pending.setdefault((i, *brackets[name][zone // 2], base), set()).add(k)
            else:
                missed.setdefault(i, set()).add(k)
    picked = _refine(kept.where(F.col("zone") % 2 == 1), pending)
    if missed:                       # a bracket without its rank: the whole column is refined
        cells = [F.struct(F.lit(i).alias("ord"), values[names[i]].alias("x"), F.lit(1).alias("c")) for i in missed]
        rows = df.select(F.inline(F.array(*cells))).where(F.col("x").isNotNull())
        picked.update(_refine(rows, {(i, float("-inf"), float("inf"), 0): ks for i, ks in missed.items()}))
    return {(names[i], k): v for (i, k), v in picked.items()}


def column_profile(df: DataFrame, values: dict[str, Column], probs: Sequence[float]) -> dict:
    """{name: {count, mean, std (ddof 1), min, max, q: {p: value}}}.  The
    sketches are made in the scan that takes the moments."""
    names = list(values)
    if not names:
        return {}
    near = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-_MARGIN, _MARGIN)})

    def stats(i, name):
        x = values[name]
        sketch = F.kll_sketch_agg_double(x, F.lit(SKETCH_K))
        at = F.array(*[F.lit(p) for p in near])
        return [F.count(x).alias("c"), F.min(x).alias("mn"), F.max(x).alias("mx"), F.avg(x).alias("mu"),
                F.stddev_samp(x).alias("sd"),
                F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(sketch, at)).alias("near")]

    out, picked, brackets, ranks = {}, {}, {}, {}
    for r in long_agg(df, names, stats).collect():      # one row per column
        name, n = r["column_name"], r["c"]
        out[name] = {"count": n, "mean": r["mu"], "std": r["sd"], "min": r["mn"], "max": r["mx"], "q": {p: None for p in probs}}
        if n == 0:
            continue
        wanted = {k for p in probs for k in _ranks(n, p)[:2]}
        ends = {0: r["mn"], n - 1: r["mx"]}
        picked.update({(name, k): ends.get(k, r["mn"]) for k in wanted if k in ends or r["mn"] == r["mx"]})
        wanted = {k for k in wanted if (name, k) not in picked}
        if wanted:
            at = dict(zip(near, r["near"], strict=True))
            cut = {p: (at[max(p - _MARGIN, 0.0)], at[min(p + _MARGIN, 1.0)]) for p in probs}
            brackets[name], ranks[name] = _disjoint([cut[p] for p in probs if wanted & set(_ranks(n, p)[:2])]), wanted
    if brackets:
        picked.update(_select(df, values, brackets, ranks))
    for name, info in out.items():
        n = info["count"]
        if not n:
            continue
        for p in probs:
            k0, k1, frac = _ranks(n, p)
            v0, v1 = picked[(name, k0)], picked[(name, k1)]
            info["q"][p] = v0 + (v1 - v0) * frac if v0 != v1 else v0
    return out


def exact_quantiles(df: DataFrame, values: dict[str, Column], probs: Sequence[float]) -> dict:
    """{(name, p): value} with linear interpolation (None for empty columns)."""
    prof = column_profile(df, values, probs)
    return {(name, p): prof[name]["q"].get(p) for name in values for p in probs}
