"""Removal of lines that many sites share.

Every line with a word is hashed (128 bits).  A HyperLogLog sketch of the
sites it occurs on is built per hash and merged by aggregation.  A line whose
estimate is clearly above the threshold is boilerplate, clearly below it is
not; lines in the band between get an exact distinct count.  Boilerplate
lines are then removed from all documents.

Boilerplate goes from every document, also from one that consists of it.  With
``spare_share`` a document that would lose a larger share of its lines stays
whole instead: where near-duplicate removal follows, copies of a document that
spread over sites must reach it as they are.

Defined cases: null texts and null sites are no lines and no sites; lines
without a word are neither counted nor removed; lines are equal if their
bytes are; repeated rows are treated alike; a text of which every line goes
is empty; texts are split whole, whatever their length; extra columns are
carried along.
All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import pick, quoted
from quarry.session import materialize

WORD = r"[^\x20\x09-\x0D]"
#: Sketch of 2^12 registers: a relative error of 1.6 %; the band is six times as wide on either side.
LOG_REGISTERS = 12
BAND = 0.1


def hashes(value: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("second"), value).alias("h2")]


def _lines(docs: DataFrame, *keys: Column) -> DataFrame:
    """keys, at (index in the text) and the two hashes of every line with a word."""
    pieces = docs.select(*keys, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return pieces.where(F.col("line").rlike(WORD)).select(*[c for c in pieces.columns if c not in ("line",)],
                                                          *hashes(F.col("line")))


def site_spread(docs: DataFrame, site: str = "source", text: str = "text") -> DataFrame:
    """h1, h2, sites (estimate) of every distinct line, by merging sketches."""
    lines = _lines(pick(docs, site=site, text=text), F.col("site"))
    sketch = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"))
    return sketch.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))


def boilerplate(docs: DataFrame, min_sites: int, site: str = "source", text: str = "text") -> DataFrame:
    """h1, h2 of the lines that occur on at least ``min_sites`` sites."""
    near = int(min_sites * (1 - BAND))
    found = materialize(site_spread(docs, site, text).where(F.col("sites") >= near), "line-spread")
    sure = F.col("sites") > min_sites * (1 + BAND)
    lines = _lines(pick(docs, site=site, text=text), F.col("site"))
    exact = lines.join(found.where(~sure).select("h1", "h2"), ["h1", "h2"], "left_semi")
    exact = exact.groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return found.where(sure).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def remove_lines(docs: DataFrame, min_sites: int = 10, spare_share: tuple[int, int] | None = None, site: str = "source",
                 text: str = "text") -> DataFrame:
    """``docs`` with boilerplate removed from ``text``, and the columns of ``docs`` besides, all in a
    struct ``row``; ``n_lines`` (lines with a word) and ``n_removed`` beside it."""
    common = materialize(boilerplate(docs, min_sites, site, text), "boilerplate-lines")
    body = quoted(text)
    whole = pick(docs, **{f"c{i}": c for i, c in enumerate(docs.columns)}).select(
        F.struct("*").alias("row"), F.col(f"c{docs.columns.index(text)}").alias("text"))
    keyed = whole.select("row", "text", *hashes(F.col("text")))
    t1, t2 = hashes(F.col("text"))
    hits = _lines(docs.select(body.alias("text")), t1.alias("t1"), t2.alias("t2"))
    hits = hits.join(common, ["h1", "h2"], "left_semi").groupBy(
        F.col("t1").alias("h1"), F.col("t2").alias("h2")).agg(F.collect_set("at").alias("gone"))
    out = keyed.join(hits, ["h1", "h2"], "left")
    pieces = F.split("text", "\n")
    n_lines = F.coalesce(F.size(F.filter(pieces, lambda x: x.rlike(WORD))), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("bigint")
    out = out.select("row", "text", n_lines.alias("n_lines"), F.col("gone"))
    takes = F.lit(True) if spare_share is None else F.size("gone") * spare_share[1] <= F.col("n_lines") * spare_share[0]
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("gone"))
    cut = F.array_join(F.transform(left, lambda i: F.get(pieces, i)), "\n")
    new = F.when(F.col("gone").isNotNull() & takes, cut).otherwise(F.col("text"))
    gone = F.when(F.col("gone").isNotNull() & takes, F.size("gone")).otherwise(0).cast("bigint")
    at = docs.columns.index(text)
    fields = [(new if i == at else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return out.select(F.struct(*fields).alias("row"), "n_lines", gone.alias("n_removed"))
