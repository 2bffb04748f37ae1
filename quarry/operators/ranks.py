"""Row numbers, tiles, running sums, tie ranks and numbered pages over any number of rows.

A window without a partition sorts the whole table in one task, and one over
a key that holds a third of the rows sorts that third in one task.  Here the
order is a range partition instead:

1. ``arrange`` cuts the rows by (keys, order) into ranges of about equal
   size, sorts each range and writes it once, with every row's ordinal in its
   range.  A hot key spreads over as many ranges as its rows fill.
2. Counts and sums are taken per (range, key), one row each.
3. A prefix scan over these few rows gives what stands before a range.
4. A row's number, tile or running sum is its range's offset plus its place
   inside the range.

Rows of one key are numbered in ``order``; equal rows in any order, so give an
order without ties where numbers must be reproducible.  Rows that agree in
keys and order stay in one range; ``tie_ranks`` first counts such rows
together, so hot ties travel as one row.  Nulls are smallest, as in Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.kinds import q
from quarry.session import materialize

Order = str | tuple[str, str]
_ORDINAL_BITS = 33          # of monotonically_increasing_id: the rest is the partition


def _sort_column(o: Order) -> Column:
    name, way = (o, "asc") if isinstance(o, str) else o
    if way not in ("asc", "desc"):
        raise ValueError(f"order {way!r} is neither asc nor desc")
    return q(name).desc() if way == "desc" else q(name).asc()


def _name(o: Order) -> str:
    return o if isinstance(o, str) else o[0]


class Arranged:
    """Rows in order, cut into ranges; made by ``arrange``."""

    def __init__(self, rows: DataFrame, columns: Sequence[str], keys: Sequence[str]):
        self.rows, self.columns = rows, list(columns)
        self.keys = [f"c{self.columns.index(k)}" for k in keys]

    def _column(self, name: str) -> Column:
        return F.col(f"c{self.columns.index(name)}")

    def spans(self, sums: Mapping[str, str]) -> DataFrame:
        """One row per (range, key): its first ordinal, what stands before it within the key (rows and sums)
        and the key's total of rows."""
        found = self.rows.groupBy("part", *self.keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("at").alias("first"),
            *[F.sum(self._column(c)).alias(f"s{i}") for i, c in enumerate(sums.values())])
        if not self.keys:
            return self._driver_scan(found, len(sums))
        earlier = Window.partitionBy(*self.keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.keys)
        return found.select("part", *self.keys, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                            F.sum("n").over(whole).alias("total"),
                            *[F.sum(f"s{i}").over(earlier).alias(f"b{i}") for i in range(len(sums))])

    def _driver_scan(self, found: DataFrame, n_sums: int) -> DataFrame:
        """Without keys there is one row per range; their number is fixed by ``arrange``, not by the data."""
        rows = sorted(found.collect(), key=lambda r: r["part"])
        total = sum(r["n"] for r in rows)
        out, before, sums = [], 0, [None] * n_sums
        for r in rows:
            out.append((r["part"], r["first"], before, total, *sums))
            before += r["n"]
            sums = [s if r[f"s{i}"] is None else r[f"s{i}"] if s is None else s + r[f"s{i}"] for i, s in enumerate(sums)]
        kinds = [found.schema[f"s{i}"].dataType.simpleString() for i in range(n_sums)]
        ddl = ", ".join(["part bigint", "first bigint", "before bigint", "total bigint",
                         *[f"b{i} {k}" for i, k in enumerate(kinds)]])
        return F.broadcast(found.sparkSession.createDataFrame(out, ddl))

    def with_windows(self, row_number: str | None = None, ntiles: Mapping[str, int] | None = None,
                     running: Mapping[str, str] | None = None, total: str | None = None) -> DataFrame:
        """The rows with the asked columns: ``row_number``, ``ntiles`` {name: tiles}, ``running`` {name:
        summed column} (nulls don't count, null before the first value) and ``total`` (rows of the key)."""
        ntiles, running = ntiles or {}, running or {}
        spans = self.spans(running)
        for i, k in enumerate(self.keys):
            spans = spans.withColumnRenamed(k, f"k{i}")
        same = self.rows["part"] == spans["part"]
        for i, k in enumerate(self.keys):
            same = same & self.rows[k].eqNullSafe(spans[f"k{i}"])
        # a left join that always finds its row: the large side is never built into a hash table
        both = self.rows.join(spans, same, "left").drop(spans["part"])
        place = F.col("before") + F.col("at") - F.col("first")
        each, over = F.col("total"), Window.partitionBy("part", *self.keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        new = [] if row_number is None else [(place + 1).alias(row_number)]
        for name, n in ntiles.items():
            longer = each % F.lit(n)                   # so many tiles hold one row more than the others
            small = ((each - longer) / F.lit(n)).cast("bigint")
            rest = place - longer * (small + 1)
            tile = F.when(rest < 0, F.floor(place / (small + 1))).otherwise(longer + F.floor(rest / F.greatest(small, F.lit(1))))
            new.append((tile + 1).cast("bigint").alias(name))
        for i, (name, c) in enumerate(running.items()):
            inside, before = F.sum(self._column(c)).over(over), F.col(f"b{i}")
            new.append(F.coalesce(inside + before, inside, before).alias(name))
        if total is not None:
            new.append(each.alias(total))
        return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(self.columns)], *new)

    def page(self, page_no: int, size: int) -> DataFrame:
        """Rows [page_no*size, page_no*size + size) of the whole order: only the ranges that hold them are
        read, by a filter on the ordinal that reaches the scan."""
        if self.keys:
            raise ValueError("pages are of a table arranged without keys")
        if not hasattr(self, "_ends"):
            counts = {r["part"]: r["n"] for r in self.rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
            self._ends = sorted(counts.items())
        lo, hi = page_no * size, page_no * size + size
        wanted, before = F.lit(False), 0
        for part, n in self._ends:
            a, b = max(lo - before, 0), min(hi - before, n)
            if a < b:
                wanted = wanted | F.col("id").between((part << _ORDINAL_BITS) + a, (part << _ORDINAL_BITS) + b - 1)
            before += n
        return self.rows.where(wanted).orderBy("id").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(self.columns)])


def arrange(df: DataFrame, order: Sequence[Order], keys: Sequence[str] = (), ranges: int | None = None) -> Arranged:
    """Range-partition ``df`` by (keys, order), sort inside the ranges and write the rows with their
    ordinals.  ``ranges`` is by default the session's number of shuffle partitions."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [q(k).asc() for k in keys] + [_sort_column(o) for o in order]
    if not by:
        raise ValueError("an order is needed")
    rows = df.repartitionByRange(n, *by).sortWithinPartitions(*by).select(
        *[q(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.monotonically_increasing_id().alias("id"))
    rows = materialize(rows, "arranged").withColumn("part", F.shiftright("id", _ORDINAL_BITS))
    return Arranged(rows.withColumn("at", F.col("id").bitwiseAND(F.lit((1 << _ORDINAL_BITS) - 1))), df.columns, keys)


def tie_ranks(df: DataFrame, order: Sequence[Order], keys: Sequence[str] = (), rank: str = "rank",
              dense_rank: str = "dense_rank", ranges: int | None = None) -> DataFrame:
    """SQL's ``rank`` and ``dense_rank``: rows that agree in keys and order are counted first (map-side), the
    distinct ones are arranged, and their ranks are joined back."""
    cols = [*keys, *[_name(o) for o in order]]
    names = [f"v{i}" for i in range(len(cols))]
    distinct = df.groupBy(*[q(c).alias(v) for c, v in zip(cols, names, strict=True)]).agg(F.count(F.lit(1)).alias("n_rows"))
    renamed = [(v, "asc" if isinstance(o, str) else o[1]) for v, o in zip(names[len(keys):], order, strict=True)]
    ranked = arrange(distinct, renamed, names[:len(keys)], ranges).with_windows("dense", running={"upto": "n_rows"})
    ranked = ranked.select(*names, F.col("dense").alias("r_dense"), (F.col("upto") - F.col("n_rows") + 1).alias("r_rank"))
    same = F.lit(True)
    for c, v in zip(cols, names, strict=True):
        same = same & q(c).eqNullSafe(F.col(v))
    renamed_df = df.select(*[q(c) for c in df.columns])
    return renamed_df.join(ranked, same, "left").select(
        *[q(c) for c in df.columns], F.col("r_rank").alias(rank), F.col("r_dense").alias(dense_rank))


def page_at(df: DataFrame, page_no: int, size: int, order: Sequence[Order], ranges: int | None = None) -> DataFrame:
    """One page of any depth; keep an ``arrange`` for several pages of one table."""
    return arrange(df, order, ranges=ranges).page(page_no, size)
