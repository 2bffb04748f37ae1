"""Joins on overlapping intervals without a nested loop.

Two inequalities (a starts before b ends, b starts before a ends) give the
planner no equi-key.  Here every interval has a level, the least power of two
that holds its length, and lies in at most two cells of that size.  Two
intervals are compared on the larger one's level, where the shorter one lies in
at most two cells as well: one side is posted on its own level, the other one on
every level of its own size or above that the first side uses, and an equi-join
on (keys, level, cell) brings them together.  The cell that holds the later of
both starts emits the pair, so it is emitted once.  Rows are multiplied by at
most twice the number of levels in use, however long an interval is, and
intervals that share a cell have comparable lengths or are nested in it, so the
work follows the matching pairs.

Few rows may have very many pairs, so tasks are cut by the pairs to compare, not
by bytes: the rows of every cell are counted on both sides, a cell of more than
``CHUNK`` candidates becomes a grid of chunks (one side's rows go to one row of
the grid, the other side's to one column of it), and the number of tasks follows
the sum of the candidates.

Whether a row meets anything needs no pairs: it does if, among the other side's
intervals that start before its end, the furthest end lies behind its start.
That is a running maximum along the axis, taken in ranges of about equal size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.kinds import q
from quarry.session import materialize

LOWEST, HIGHEST = -1074, 1023  # binary exponents of doubles
CHUNK = 1 << 22                # candidate pairs of a cell that stay together, and
PER_TASK = 1 << 25             # about so many of a task
MOST_TASKS = 20_000


def _axis(df: DataFrame, col: str) -> Column:
    """A point as a double; the map is monotone, so cells never separate points that overlap."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(q(col).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(q(col)).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(q(col)).cast("double")
    return q(col).cast("double")


def _known(df: DataFrame, start: str, end: str, on: Sequence[str], closed: bool) -> Column:
    """Whether a row can match anything."""
    valid = (q(start) <= q(end)) if closed else (q(start) < q(end))
    finite = F.abs(_axis(df, start)) < F.lit(float("inf"))
    finite &= F.abs(_axis(df, end)) < F.lit(float("inf"))
    return reduce(lambda a, b: a & b, [q(c).isNotNull() for c in on], valid & finite)


def _measured(df: DataFrame, start: str, end: str, on: Sequence[str], closed: bool, side: str) -> DataFrame:
    """The rows that can match anything, with their ends as doubles and their level; null for points."""
    s, e = _axis(df, start), _axis(df, end)
    rows = df.select(F.struct(*[q(c) for c in df.columns]).alias(f"_{side}"), *[q(c).alias(f"_on{i}") for i, c in enumerate(on)],
                     q(start).alias(f"_{side}s"), q(end).alias(f"_{side}e"), s.alias("_s"), e.alias("_e"), _known(df, start, end, on, closed).alias("_ok"))
    length = F.col("_e") - F.col("_s")
    level = F.when(length > 0, F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.ceil(F.log2(length)))).cast("int"))
    return rows.where("_ok").drop("_ok").withColumn("_level", level)


def _posted(rows: DataFrame, levels: list[int], own_only: bool, strictly_above: bool, first: str) -> DataFrame:
    """One row per cell: on the own level, or on all used levels from there (or above it)."""
    at = F.lit(levels[0])
    own = F.coalesce("_level", at)
    if own_only:
        out = rows.withColumn("_at", own)
    else:
        used = F.array(*[F.lit(x) for x in levels])
        above = F.filter(used, lambda x: (x > own) if strictly_above else (x >= own))
        out = rows.withColumn("_at", F.explode(above))
    size = F.pow(F.lit(2.0), F.col("_at").cast("double"))
    out = out.withColumn(first, F.floor(F.col("_s") / size)).withColumn("_last", F.floor(F.col("_e") / size))
    return out.withColumn("_cell", F.explode(F.sequence(first, "_last"))).drop("_s", "_e", "_level", "_last")


def _dealt(x: DataFrame, y: DataFrame, shared: list[str], mixed: tuple[list[str], list[str]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join on ``shared``, dealt to tasks by the pairs they make, and the columns to join on.
    Rows of a heavy key are told apart by the ``mixed`` columns and the partition they come from."""
    counts = x.groupBy(*shared).agg(F.count(F.lit(1)).cast("double").alias("_nx")).join(
        y.groupBy(*shared).agg(F.count(F.lit(1)).cast("double").alias("_ny")), shared)
    each = F.col("_nx") * F.col("_ny")
    # one row for all light keys, and one per CHUNK pairs at most
    loads = materialize(counts.groupBy(F.when(each > CHUNK, F.struct(*shared)).alias("_key")).agg(
        F.sum(each).alias("_load"), F.max("_nx").alias("_nx"), F.max("_ny").alias("_ny")), "interval-loads")
    total = loads.agg(F.sum("_load").alias("load"), F.count("_key").alias("heavy")).first()
    if (total.load or 0) <= PER_TASK:
        return x, y, shared
    side = CHUNK ** 0.5
    cut = (lambda own, other: F.ceil(F.col(own) / F.greatest(F.lit(side), CHUNK / F.col(other))))
    heavy = F.broadcast(loads.where("_key is not null").select("_key.*", cut("_nx", "_ny").alias("_cx"), cut("_ny", "_nx").alias("_cy")))

    def dealt(rows: DataFrame, columns: list[str], own: str, other: str) -> DataFrame:
        if not total.heavy:
            return rows.withColumns({"_gx": F.lit(0), "_gy": F.lit(0)})
        many = rows.join(heavy, shared, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_cx", "_cy")})
        place = F.pmod(F.xxhash64(*[F.col(c) for c in columns], F.spark_partition_id()), F.col(f"_c{own}")).cast("int")
        many = many.withColumn(f"_g{own}", place).withColumn(f"_g{other}", F.explode(F.sequence(F.lit(0), (F.col(f"_c{other}") - 1).cast("int"))))
        return many.drop("_cx", "_cy")

    keys = [*shared, "_gx", "_gy"]
    tasks = int(min(MOST_TASKS, max(total.load // PER_TASK + 1, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    x, y = (dealt(rows, columns, *names).repartition(tasks, *keys) for rows, columns, names in ((x, mixed[0], "xy"), (y, mixed[1], "yx")))
    return x, y, keys


def _plain(df: DataFrame, side: str) -> list[str]:
    """The fields of a side's rows that can be hashed."""
    return [f"_{side}.{q_name}" for q_name, kind in ((f"`{f.name.replace('`', '``')}`", f.dataType) for f in df.schema.fields)
            if isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)]


def _pairs(left: DataFrame, right: DataFrame, lcols: tuple[str, str], rcols: tuple[str, str], on: Sequence[str],
           closed: bool) -> DataFrame | None:
    """(_l, _r) of all overlapping pairs, None if one side has no interval."""
    a, b = _measured(left, *lcols, on, closed, "l"), _measured(right, *rcols, on, closed, "r")
    # at most one row per level, of which doubles have no more than 2098
    found = [[r._level for r in x.groupBy("_level").agg(F.lit(1)).collect()] for x in (a, b)]
    if not all(found):
        return None
    used = [sorted(x for x in levels if x is not None) for levels in found]
    lowest = min([*used[0], *used[1]], default=0)  # points lie on the lowest level that intervals use
    used = [sorted({lowest if x is None else x for x in levels}) for levels in found]
    points = (lambda x: x.withColumn("_level", F.coalesce("_level", F.lit(lowest))))
    xs, ys = [], []
    for probe_left in (True, False):
        levels = used[1] if probe_left else used[0]
        xs.append(_posted(points(a), levels, not probe_left, False, "_lf").withColumn("_probe", F.lit(probe_left)))
        ys.append(_posted(points(b), levels, probe_left, not probe_left, "_rf").withColumn("_probe", F.lit(probe_left)))
    shared = ["_probe", "_at", "_cell", *[f"_on{i}" for i in range(len(on))]]
    x, y, keys = _dealt(reduce(DataFrame.unionByName, xs), reduce(DataFrame.unionByName, ys), shared, (_plain(left, "l"), _plain(right, "r")))
    hit = x.join(y, keys).where(F.col("_cell") == F.greatest("_lf", "_rf"))
    touch = ((F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le"))) if closed else \
        ((F.col("_ls") < F.col("_re")) & (F.col("_rs") < F.col("_le")))
    return hit.where(touch).select("_l", "_r")


def _furthest(left: DataFrame, right: DataFrame, lcols: tuple[str, str], rcols: tuple[str, str], on: Sequence[str],
              closed: bool) -> DataFrame:
    """_on, _pos, _far: per keys and end of a left interval the furthest end of the right ones that start before it,
    or at it if closed; no row without one."""
    a, b = _measured(left, *lcols, on, closed, "l"), _measured(right, *rcols, on, closed, "r")
    ons = [f"_on{i}" for i in range(len(on))]
    starts = b.groupBy(*ons, F.col("_rs").alias("_pos")).agg(F.max("_re").alias("_end")).withColumn("_asks", F.lit(False))
    asked = a.select(*ons, F.col("_le").alias("_pos")).distinct().select(
        *ons, "_pos", F.lit(None).cast(starts.schema["_end"].dataType).alias("_end"), F.lit(True).alias("_asks"))
    turn = F.col("_asks").asc() if closed else F.col("_asks").desc()
    # the ranges are numbered in the order of the axis
    events = materialize(asked.unionByName(starts).repartitionByRange(*ons, "_pos").withColumn("_range", F.spark_partition_id()), "interval-ends")
    earlier = Window.partitionBy(*ons).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("_range", *ons).agg(F.max("_end").alias("_end")).withColumn("_end", F.max("_end").over(earlier))
    carried = carried.where("_end is not null").select(
        *ons, F.lit(None).cast(events.schema["_pos"].dataType).alias("_pos"), "_end", F.lit(False).alias("_asks"), "_range")
    upto = Window.partitionBy("_range", *ons).orderBy(F.col("_pos").asc_nulls_first(), turn).rowsBetween(Window.unboundedPreceding, 0)
    far = events.unionByName(carried).withColumn("_far", F.max("_end").over(upto))
    return far.where("_asks and _far is not null").select(*ons, "_pos", "_far")


def interval_join(left: DataFrame, right: DataFrame, lcols: tuple[str, str], rcols: tuple[str, str],
                  on: Sequence[str] = (), how: str = "inner", closed: bool = True) -> DataFrame:
    """Rows whose intervals (start, end) overlap and whose ``on`` columns are equal.

    ``closed`` intervals also match where one ends as the other one starts;
    half-open ones don't, and empty ones among these match nothing.  ``how`` is
    inner, left, semi or anti.  Intervals with a null or infinite end, or that
    end before they start, match nothing; NaN counts as infinite.  Columns of
    the right side that bear a left name must be named in ``on`` and appear once.
    """
    clash = set(left.columns) & set(right.columns) - set(on)
    if clash and how in ("inner", "left"):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    rest = [c for c in right.columns if c not in on]
    kinds = {f.name: f.dataType for f in right.schema.fields}
    if how in ("inner", "left"):
        found = _pairs(left, right, lcols, rcols, on, closed)
        if found is None:
            wide = left.select(*[q(c) for c in left.columns], *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])
            return wide if how == "left" else wide.where(F.lit(False))
        wide = found.select("_l.*", *[F.col("_r").getField(c).alias(c) for c in rest])
        if how == "inner":
            return wide
        alone = interval_join(left, right, lcols, rcols, on, "anti", closed)
        return wide.unionByName(alone.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in rest]))
    if how not in ("semi", "anti"):
        raise ValueError(how)
    found = _furthest(left, right, lcols, rcols, on, closed)
    reached = (F.col("_far") >= q(lcols[0])) if closed else (F.col("_far") > q(lcols[0]))
    same = reduce(lambda a, b: a & b, [q(c) == F.col(f"_on{i}") for i, c in enumerate(on)], q(lcols[1]) == F.col("_pos"))
    return left.join(found, same & reached & _known(left, *lcols, on, closed), f"left_{how}")
