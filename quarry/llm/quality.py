"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the raw
measurements and one 64-bit word of failure bits (bit i is set if rule i
fails).  A policy is a named, versioned mask over those bits, so applying
another policy, or asking what a rule costs, reads the ledger only and never
the texts again.

Defined cases: a null or empty text has no words and zero measurements;
repeated rows each get their own ledger row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textvec as V
from quarry.llm.base import pick

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_wordy")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL predicate over the measurements; integer arithmetic only, so every engine
    decides alike."""
    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_mean_word", "word_chars < 2 * n_words"),
    Rule(4, "long_mean_word", "word_chars > 15 * n_words"),
    Rule(5, "repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule(6, "few_wordy_words", "10 * n_wordy < 7 * n_words"),
    Rule(7, "many_words", "n_words > 1000000"),
)
BASE_MASK = 0b11
#: A version is never edited once used; a new policy gets a new version.
POLICIES = {
    "base": BASE_MASK,
    "v1": 0b0000_0111,
    "v2": 0b0111_1111,
}
CURRENT = "v2"


def _measure_batches(batches: Iterator[pa.RecordBatch], text: str, carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in V.text_runs(batch.column(text)):
            starts, ends, bounds = V.word_spans(data, offs)
            n_words = np.diff(bounds)
            begins = (data & 0xC0) != 0x80
            out = {"n_words": n_words,
                   "word_chars": V.per_row(begins & ~V.SPACE[data], offs),
                   "n_symbols": V.per_row(SYMBOLS[data], offs)}
            row_key = V.mix(np.arange(hi - lo, dtype=V.U64) + V.U64(1))
            l_start, l_end, l_bounds = V.line_spans(data, offs)
            at = np.searchsorted(starts, l_start)
            worded = np.searchsorted(starts, l_end) > at
            keys = V.span_hashes(data, l_start, l_end) + row_key[V.rows_of(l_bounds)]
            later = np.zeros(len(keys), bool)
            later[worded] = V.repeats(keys[worded])[1]
            out["n_dup_lines"] = V.per_row(later, l_bounds)
            out["n_lines"] = V.per_row(worded, l_bounds)
            words = V.span_hashes(data, starts, ends)
            grams = V.gram_hashes(words, 3)
            row = V.rows_of(bounds)
            covered = np.zeros(len(words), bool)
            if len(grams):
                whole = np.flatnonzero(row[:len(grams)] == row[2:])
                twice = whole[V.repeats(grams[whole] + row_key[row[whole]])[0]]
                for i in range(3):
                    covered[twice + i] = True
            out["n_repeat_words"] = V.per_row(covered, bounds)
            letters = np.zeros(len(data) + 1, np.int64)
            np.cumsum(LETTERS[data], out=letters[1:])
            out["n_wordy"] = V.per_row(letters[ends] > letters[starts], bounds)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in carry],
                                              *[pa.array(out[m], pa.int64()) for m in MEASURES]],
                                             names=[*carry, *MEASURES])


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with every measurement, in one pass over the texts."""
    src = pick(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_measure_batches, text="text", carry=["doc_id"]),
                          f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits of a row of measurements."""
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Measurements and failure bits of every document."""
    return measure(docs, doc_id, text).withColumn("fail_bits", fail_bits(rules))


def passes(version: str = CURRENT) -> Column:
    """Does a ledger row pass the policy?"""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("bigint")) == 0


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """Ledger rows with the policy's verdict."""
    return entries.withColumn("policy", F.lit(version)).withColumn("kept", passes(version))


def keep_documents(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that pass the policy, with all their columns; one pass, no join.  The columns travel
    under positional names, so none can clash with a measurement."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    src = pick(docs, **dict(zip(names, docs.columns, strict=True)))
    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, src.schema, strict=True)]
    measured = src.mapInArrow(partial(_measure_batches, text=names[docs.columns.index(text)], carry=names),
                              ", ".join([*fields, *[f"{m} bigint" for m in MEASURES]]))
    kept = measured.withColumn("fail_bits", fail_bits()).where(passes(version))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def ablation(entries: DataFrame, version: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of a policy rejects: documents failing it, failing nothing else, and kept in all
    if the rule were dropped.  Bitwise tests on the ledger, one aggregate, no text."""
    mask = POLICIES[version]
    used = [r for r in rules if mask >> r.bit & 1]
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint"))
    one = F.lit(1).cast("bigint")
    aggs = [F.count(F.when(failed == 0, one)).alias("kept")]
    for r in used:
        bit = F.lit(1 << r.bit).cast("bigint")
        aggs.append(F.count(F.when(failed.bitwiseAND(bit) != 0, one)).alias(f"f{r.bit}"))
        aggs.append(F.count(F.when(failed == bit, one)).alias(f"o{r.bit}"))
    stats = entries.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"),
                              F.col(f"o{r.bit}").alias("n_failed_only_this"),
                              (F.col("kept") + F.col(f"o{r.bit}")).alias("n_kept_without"))
                     for r in used])
    return stats.select(F.lit(version).alias("policy"), F.explode(rows).alias("r")).select("policy", "r.*")


def signature_counts(entries: DataFrame) -> DataFrame:
    """Documents per combination of failed rules: enough to replay any policy exactly."""
    return entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n_docs"))
