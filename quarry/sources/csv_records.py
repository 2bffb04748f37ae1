"""CSV records from splits that may begin inside a quoted field.

A line break ends a record unless a quoted field is open.  Whether one is
open where a split begins depends on everything before it, so a reader that
wants whole records takes a file in one task.  Here every split is read by
its own task:

1. A line is a map of two states, outside and inside a quoted field, found
   for both by a regular expression: four maps are possible, two constant
   ones, the identity and the swap.
2. The maps are composed along a split in the order in which its task reads
   it, for either state at its beginning: the state is the last constant,
   changed by the swaps since then.  This is a Python stage; it sees maps,
   not fields.
3. The splits' maps are composed by a window over one row per split, which
   gives each split's beginning, and where the record that it begins in
   started.
4. The lines of a record are joined where they are read, as its task meets
   them in a row (a second Python stage, which joins texts).  Only pieces of
   records that go on in another task travel, to the place where their
   record starts.

A quote is special at the beginning of a field and inside a quoted one, where
two of them stand for one.  A field that goes on after its closing quote is
malformed; it ends at the next separator and its cell stays as written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import materialize, ship_package

LINES = "file string, split bigint, at bigint, line string, in0 boolean, in1 boolean, out0 boolean, out1 boolean, start0 bigint, start1 bigint"
PARTS = "file string, split bigint, at bigint, record string, piece string, piece_split bigint, piece_at bigint"
#: A record start that lies before the split.
EARLIER = -1


def _patterns(sep: str) -> tuple[str, str]:
    """Lines that leave no field open, begun outside and begun inside of one.  Every repetition is
    possessive: it never gives back, so it runs in constant stack and a doubled quote stays one."""
    s = re.escape(sep)
    rest = f"[^{s}]*+"
    closed = f'[^"]*+(?:""[^"]*+)*+"{rest}'
    field = f'(?:"{closed}|[^"{s}]{rest}|)'
    return rf"^{field}(?:{s}{field})*+\z", rf"^{closed}(?:{s}{field})*+\z"


def states(to0: np.ndarray, to1: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """State before and after every line, if the split begins in ``first``; to0, to1: where a line leads
    from outside and from inside."""
    constant, odd = to0 == to1, np.cumsum(to0 & ~to1) & 1 == 1
    last = np.maximum.accumulate(np.where(constant, np.arange(len(to0)), -1))
    after = np.where(last >= 0, to0[last] ^ odd ^ odd[last], first ^ odd)
    return np.concatenate([[first], after[:-1]]), after


def _along_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, at, carry, starts = None, 0, [False, True], [EARLIER, EARLIER]
    for batch in batches:
        if not batch.num_rows:
            continue
        # a task's rows come split by split
        files, splits = batch.column("file"), batch.column("split").to_numpy()
        codes = files.dictionary_encode().indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (splits[1:] != splits[:-1])]))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
            if (files[a].as_py(), splits[a]) != key:
                key, at, carry, starts = (files[a].as_py(), splits[a]), 0, [False, True], [EARLIER, EARLIER]
            part = batch.slice(a, b - a)
            to0, to1 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("to0", "to1"))
            place, columns = np.arange(at, at + b - a), {}
            for h in (0, 1):
                # a state carried over is itself a beginning
                before, after = states(to0, to1, carry[h])
                start = np.maximum.accumulate(np.where(before, starts[h], place))
                columns |= {f"in{h}": pa.array(before), f"out{h}": pa.array(after), f"start{h}": pa.array(start)}
                carry[h], starts[h] = bool(after[-1]), int(start[-1])
            at += b - a
            yield pa.RecordBatch.from_arrays(
                [part.column("file"), part.column("split"), pa.array(place), part.column("line"),
                 *[columns[c] for c in ("in0", "in1", "out0", "out1", "start0", "start1")]],
                names=["file", "split", "at", "line", "in0", "in1", "out0", "out1", "start0", "start1"])


def _parts(files: pa.Array, texts: pa.Array, whole: np.ndarray, places: list[np.ndarray]) -> pa.RecordBatch:
    place = np.arange(len(whole))
    record, piece = (texts.take(pa.array(place, mask=absent)) for absent in (~whole, whole))
    split, at, piece_split, piece_at = (pa.array(p, pa.int64()) for p in places)
    return pa.RecordBatch.from_arrays([files, split, at, record, piece, piece_split, piece_at],
                                      names=["file", "split", "at", "record", "piece", "piece_split", "piece_at"])


class _Held:
    """The last lines of a batch; the next batch may go on with them."""

    def __init__(self, file: pa.Array, places: list[int], begins: bool):
        self.file, self.places, self.begins, self.texts = file, places, begins, []

    def add(self, text: pa.Scalar, at: int, goes_on: bool) -> None:
        self.texts.append(text.as_py())
        self.at, self.goes_on = int(at), bool(goes_on)

    def part(self, kind: pa.DataType) -> pa.RecordBatch:
        return _parts(self.file, pa.array(["\n".join(self.texts)], kind), np.array([self.begins and not self.goes_on]),
                      [np.array([p]) for p in self.places])


def _along_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that follow each other in a record become one text: the record, or a piece of it.  Wherever a task
    begins or ends, and in whatever order it meets the lines, the pieces are those it has seen in a row."""
    held = kind = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, lines = batch.column("file"), batch.column("line")
        kind = lines.type
        codes = files.dictionary_encode().indices.to_numpy()
        split, at, first_split, first_at = (batch.column(c).to_numpy() for c in ("split", "at", "first_split", "first_at"))
        inside, after = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("in", "out"))
        new = ~inside
        new[0] = True
        new[1:] |= (codes[1:] != codes[:-1]) | (split[1:] != split[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        lasts = np.append(heads[1:], n) - 1
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(heads, n), pa.int32()), lines), pa.scalar("\n", kind))
        places = [first_split[heads], first_at[heads], split[heads], at[heads]]
        low, high = 0, len(heads) - 1
        if held:
            if inside[0] and held.file[0] == files[0] and held.places[2] == split[0] and held.at + 1 == at[0]:
                held.add(texts[0], at[lasts[0]], after[lasts[0]])
                low = 1
                if not high:
                    continue
            yield held.part(kind)
        if low < high:
            yield _parts(files.take(pa.array(heads[low:high])), texts[low:high], ~inside[heads[low:high]] & ~after[lasts[low:high]],
                         [p[low:high] for p in places])
        held = _Held(files.slice(heads[high], 1), [int(p[high]) for p in places], not inside[heads[high]])
        held.add(texts[high], at[lasts[high]], after[lasts[high]])
    if held:
        yield held.part(kind)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte), line of all lines, in the order of the files inside a split.  Lines end
    with a line feed; a byte order mark at the beginning of a file is dropped."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                        F.when(F.col("value").startswith("\ufeff"), F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("line"))


def _beginnings(lines: DataFrame) -> DataFrame:
    """Per split: is a quoted field open where it begins, and which split and line began that record?"""
    ends = lines.groupBy("file", "split").agg(*[F.max_by(c, "at").alias(c) for c in ("out0", "out1", "start0", "start1")])
    upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # after a split of a constant map the state is known; between those, swaps change it
    swaps = F.coalesce(F.sum(F.when(F.col("out0") & ~F.col("out1"), 1).otherwise(0)).over(
        Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) % 2
    known = ends.withColumn("odd", swaps).withColumn("known", F.when(F.col("out0") == F.col("out1"), F.col("out0").cast("int").bitwiseXOR(F.col("odd").cast("int"))))
    opened = known.withColumn("odd_before", F.coalesce(F.lag("odd").over(Window.partitionBy("file").orderBy("split")), F.lit(0))).withColumn(
        "open", F.coalesce(F.last("known", ignorenulls=True).over(upto), F.lit(0)).bitwiseXOR(F.col("odd_before").cast("int")) == 1)
    start = F.when(F.col("open"), F.col("start1")).otherwise(F.col("start0"))
    began = opened.withColumn("own", F.when(start != EARLIER, F.struct(F.col("split").alias("split"), start.alias("at"))))
    return began.select(F.col("file").alias("b_file"), F.col("split").alias("b_split"), "open",
                        F.last("own", ignorenulls=True).over(upto).alias("began"))


def csv_records(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """file, split, at (of the record's first line), record: every record's text.  Without ``multi_line`` every line
    is a record."""
    lines = raw_lines(spark, path)
    ship_package(spark)
    if multi_line:
        outside, inside = _patterns(sep)
        quoted = F.col("line").contains('"')
        lines = lines.withColumn("to0", F.when(quoted, ~F.col("line").rlike(outside)).otherwise(F.lit(False))).withColumn(
            "to1", F.when(quoted, ~F.col("line").rlike(inside)).otherwise(F.lit(True)))
    else:
        lines = lines.withColumn("to0", F.lit(False)).withColumn("to1", F.lit(False))
    lines = materialize(lines.mapInArrow(_along_splits, LINES), "csv-lines")
    if not multi_line:
        return lines.select("file", "split", "at", _without_return(F.col("line")).alias("record"))
    # one row per split; the lines stay in their order
    begin = F.broadcast(materialize(_beginnings(lines), "csv-beginnings"))
    lines = lines.join(begin, (F.col("file") == F.col("b_file")) & (F.col("split") == F.col("b_split")), "left")
    pick = [F.when(F.col("open"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")).alias(c) for c in ("in", "out", "start")]
    lines = lines.select("file", "split", "at", "line", "began", *pick)
    # a quote that is never closed takes the rest of its file, as in a reader of whole files
    earlier = F.col("start") == EARLIER
    lines = lines.select("file", "split", "at", "line", "in", "out", F.when(earlier, F.col("began.split")).otherwise(F.col("split")).alias("first_split"),
                         F.when(earlier, F.col("began.at")).otherwise(F.col("start")).alias("first_at"))
    parts = materialize(lines.mapInArrow(_along_records, PARTS), "csv-records")
    whole = parts.where("record is not null").select("file", "split", "at", "record")
    pieces = parts.where("piece is not null").groupBy("file", "split", "at").agg(
        F.array_sort(F.collect_list(F.struct("piece_split", "piece_at", "piece"))).alias("all"))
    several = pieces.select("file", "split", "at", F.array_join(F.col("all.piece"), "\n").alias("record"))
    return whole.unionByName(several).select("file", "split", "at", _without_return(F.col("record")).alias("record"))


def _without_return(line: Column) -> Column:
    return F.regexp_replace(line, "\r$", "")
