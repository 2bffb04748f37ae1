"""A1 CSV as text, A6 export."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.parsing import CSV_NULL_TOKENS
from quarry.session import materialize
from quarry.sources.csv_records import csv_records


def pandas_header_names(raw: list) -> list[str]:
    """Header names as pandas makes them: blank -> ``Unnamed: i``;
    repeated names get ``.1``, ``.2`` suffixes."""
    names, seen = [], {}
    for i, h in enumerate(raw):
        base = h if h is not None and str(h) != "" else f"Unnamed: {i}"
        name = base
        while name in seen:
            seen[base] += 1
            name = f"{base}.{seen[base]}"
        seen.setdefault(name, 0)
        names.append(name)
    return names


def read_csv_text(spark: SparkSession, path: str, null_tokens=CSV_NULL_TOKENS,
                  sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A1: header CSV with every cell as text and the reader's null tokens
    turned into null.  Quoted separators, doubled quotes and, with
    ``multi_line``, line breaks in quotes are handled; files are read split
    by split either way (``csv_records``).  Each file's first record names
    its own columns; files are united by name, in the order of first
    appearance by file name.  Only the distinct header lines come to the
    driver.  Blank lines are skipped; missing trailing cells are null and
    surplus ones are dropped."""
    found = csv_records(spark, path, sep, multi_line).where("record <> ''")
    files = found.where("split = 0").groupBy("file").agg(F.min_by(F.struct("at", "record"), "at").alias("h"))
    files = materialize(files.select(F.col("file").alias("h_file"), F.col("h.at").alias("h_at"), F.col("h.record").alias("header")), "csv-headers")
    headers = files.groupBy("header").agg(F.min("h_file").alias("file")).orderBy("file", "header").collect()
    if not headers:
        return spark.createDataFrame([], T.StructType([]))
    named = [pandas_header_names(next(csv.reader(io.StringIO(r["header"], newline=""), delimiter=sep))) for r in headers]
    width = max(len(names) for names in named)
    opts = dict(sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", maxColumns=str(width + 1))
    rows = found.join(files, (F.col("file") == F.col("h_file")) & ((F.col("split") > 0) | (F.col("at") > F.col("h_at"))))
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), opts)
    parsed = rows.select("header", cells.alias("c"))
    tokens = [t for t in null_tokens if t != ""]
    out = []
    for name in dict.fromkeys(n for names in named for n in names):
        places: dict[int, list[str]] = {}
        for r, names in zip(headers, named, strict=True):
            if name in names:
                places.setdefault(names.index(name), []).append(r["header"])
        if len(places) == 1 and len(next(iter(places.values()))) == len(headers):
            value = F.col(f"c.c{next(iter(places))}")
        else:
            value = F.coalesce(*[F.when(F.col("header").isin(hs), F.col(f"c.c{i}")) for i, hs in places.items()])
        out.append(F.when(value.isin(tokens) | (value == ""), F.lit(None)).otherwise(value).alias(name))
    return parsed.select(*out)


def export_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                 partition_by: list[str] | None = None) -> str:
    """Write a (cleaned) table for download: parquet, csv (header) or
    json lines.  Written by the executors in parallel; returns the path."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt}")
    return path
