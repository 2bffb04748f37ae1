"""A2: first sheet of each .xlsx file as text rows.

Files are listed and read by Spark (``binaryFile``); each file is parsed
in its own task by ``mapInPandas`` with the standard library (an xlsx is a
zip of XML parts; it cannot be split).  Output is long-and-narrow
``(path, row_no, cells map<string,string>)`` keyed by pandas-style header
names, then ``workbook_table`` selects the columns.  Legacy ``.xls`` is
not supported (the reference's reader cannot open it either).
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ship_package
from quarry.sources.text import pandas_header_names

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(_REL)
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels:
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


def parse_first_sheet(data: bytes) -> list[list]:
    """Rows of the first sheet as lists of text (None for empty cells)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    sheet = ET.fromstring(z.read(_first_sheet_path(z)))
    rows = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        vals = {}
        for c in row.findall("m:c", _NS):
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            elif t == "b" and v is not None:
                val = "True" if v.text == "1" else "False"
            else:
                val = v.text if v is not None else None
            vals[_col_index(c.get("r"))] = val
        width = max(vals) + 1 if vals else 0
        rows.append([vals.get(i) for i in range(width)])
    return rows


def _parse_files(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = parse_first_sheet(bytes(content))
            if not rows:
                continue
            header = pandas_header_names(rows[0])
            for i, r in enumerate(rows[1:]):
                cells = {header[j]: (r[j] if j < len(r) else None) for j in range(len(header))}
                out.append((path, i, cells))
        yield pd.DataFrame(out, columns=["path", "row_no", "cells"])


def read_workbooks_long(spark: SparkSession, path: str) -> DataFrame:
    ship_package(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", True).load(path).select("path", "content"))
    # the file source already splits by file (small files are packed);
    # content bytes are never shuffled
    return files.mapInPandas(_parse_files,
                             "path string, row_no long, cells map<string,string>")


def workbook_table(long: DataFrame, columns: list[str]) -> DataFrame:
    """Select header columns from the long form as a text table."""
    return long.select("path", "row_no", *[F.col("cells")[c].alias(c) for c in columns])


def read_workbooks(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A2: text rows of the first sheet of every workbook under ``path``.
    Without ``columns``, the header names are gathered with one
    distinct-keys aggregate (bounded by the header width)."""
    long = read_workbooks_long(spark, path)
    if columns is None:
        keys = (long.select(F.explode(F.map_keys("cells")).alias("k")).distinct().collect())
        columns = sorted(r["k"] for r in keys)
    return workbook_table(long, columns)
