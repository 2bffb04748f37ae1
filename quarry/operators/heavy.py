"""Most frequent values with proof (C8-C10, F6 on columns of very many distinct values).

``top_values`` shuffles every distinct value once.  Here values travel only as 64-bit hashes, and few of them:

1. every task keeps Misra-Gries counters of value hashes per column.  A task that runs out of counters takes the
   same amount off all of them; a value's true count exceeds its counter by at most the sum of these amounts;
2. values whose counter plus that error reaches the k-th largest counter are counted exactly, texts included;
3. if the k-th exact count exceeds the error, no other value can be among the first k: the column is proven.

For the other columns (no value stands out) hashes are counted whole, and only values whose hash count reaches the
k-th largest are grouped as texts: with two hashes in one, counts only grow, so nothing is lost; the k-th exact count
proves this step, too, and a column that fails even then is counted as it is.

Null values are no candidates.  Ties go to the smaller value.  An empty table or column gives no rows.  Long texts are
hashed where they are read; those that reach step 2 are shuffled whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.kinds import categorical_columns
from quarry.functions.wide import unpivot
from quarry.operators.profile import as_text
from quarry.session import materialize, ship_package

#: Counters of a task and column, 16 bytes each.
COUNTERS = 16_384
_SUMMARY = "ord int, h bigint, c bigint"


class _Counters:
    """Misra-Gries counters over batches of (hash, count)."""

    def __init__(self, size: int):
        self.size, self.error = size, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        fresh, n = np.unique(hashes, return_counts=True)
        keys, at = np.unique(np.concatenate([self.keys, fresh]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, np.concatenate([self.counts, n]))
        if len(keys) > self.size:
            # the largest count that gets no counter comes off everywhere
            off = np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1]
            self.error += int(off)
            counts -= off
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def _summarise(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[int, _Counters] = {}
        for batch in batches:
            ords, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in np.unique(ords):
                columns.setdefault(int(i), _Counters(size)).add(hashes[ords == i])
        for i, found in columns.items():
            # the row without a hash carries the task's error
            keys = pa.array([*found.keys.tolist(), None], pa.int64())
            counts = pa.array(np.append(found.counts, found.error), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), keys, counts], ["ord", "h", "c"])
    return run


def _kth(counts: DataFrame, k: int) -> DataFrame:
    """(ord, least): the k-th largest ``c`` of each column, 0 where it has fewer values."""
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("c")))).where(F.col("r") <= k)
    return first.groupBy("ord").agg(F.when(F.count(F.lit(1)) == k, F.min("c")).otherwise(0).alias("least"))


def _first(counts: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("ord").orderBy(F.desc("c"), "x")
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _exact(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ord, x, c): exact counts of the values whose hash is wanted; copies combine before the exchange."""
    return rows.join(wanted, ["ord", "h"], "left_semi").groupBy("ord", "x").agg(F.count(F.lit(1)).alias("c"))


def heavy_hitters(df: DataFrame, k: int = 5, cols: Sequence[str] | None = None, counters: int = COUNTERS) -> DataFrame:
    """(ord, column_name, rank, value, count, proof): the first ``k`` values of each column by count, then value.
    ``proof`` names the step that settled the column: counters, hashes or all."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(categorical_columns(df) if cols is None else cols)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "ord int, column_name string, rank int, value string, count bigint, proof string")
    ship_package(spark)
    rows = unpivot(df, [as_text(c, types[c]) for c in cols], F.col("x").isNotNull()).withColumn("h", F.xxhash64("x"))
    summary = materialize(rows.select("ord", "h").mapInArrow(_summarise(counters), _SUMMARY).groupBy("ord", "h")
                          .agg(F.sum("c").alias("c")), "heavy-counters")
    error = summary.where(F.col("h").isNull()).select("ord", F.col("c").alias("error"))       # a row per column
    seen = summary.where(F.col("h").isNotNull())
    bar = _kth(seen, k).join(F.broadcast(error), "ord")                                       # a row per column
    likely = seen.join(F.broadcast(bar), "ord").where((F.col("least") > F.col("error")) | (F.col("error") == 0))
    likely = likely.where(F.col("c") + F.col("error") >= F.col("least")).select("ord", "h")
    first = materialize(_first(_exact(rows, likely), k), "heavy-first")
    facts = {r["ord"]: r["error"] for r in error.collect()}
    reached = {r["ord"]: (r["n"], r["least"]) for r in
               first.groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()}
    proven = [i for i, e in facts.items() if e == 0 or (i in reached and reached[i][0] == k and reached[i][1] > e)]
    parts = [(first.where(F.col("ord").isin(proven)), "counters")]
    rest = [i for i in facts if i not in proven]
    if rest:
        open_rows = rows.where(F.col("ord").isin(rest))
        hashes = materialize(open_rows.groupBy("ord", "h").agg(F.count(F.lit(1)).alias("c")), "heavy-hashes")
        least = {r["ord"]: r["least"] for r in _kth(hashes, k).collect()}
        at_least = F.lit(False)
        for i, c in least.items():
            at_least = at_least | ((F.col("ord") == i) & (F.col("c") >= c))
        found = materialize(_first(_exact(open_rows, hashes.where(at_least).select("ord", "h")), k), "heavy-hashed")
        reached = {r["ord"]: r["least"] for r in _kth(found, k).collect()}
        sure = [i for i in rest if reached.get(i, 0) >= least[i]]
        parts.append((found.where(F.col("ord").isin(sure)), "hashes"))
        last = [i for i in rest if i not in sure]
        if last:
            counted = rows.where(F.col("ord").isin(last)).groupBy("ord", "x").agg(F.count(F.lit(1)).alias("c"))
            parts.append((_first(counted, k), "all"))
    names = F.array(*[F.lit(c) for c in cols])
    out = None
    for part, proof in parts:
        part = part.select("ord", F.get(names, F.col("ord")).alias("column_name"), "rank", F.col("x").alias("value"),
                           F.col("c").alias("count"), F.lit(proof).alias("proof"))
        out = part if out is None else out.unionAll(part)
    return out
