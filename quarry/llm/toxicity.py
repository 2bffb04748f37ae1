"""Toxicity by a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings (4, 5 and 6 bytes),
by hash.  The training loss is the logistic loss plus a penalty on the change
of a text's score when its identity terms are swapped for others of the same
group, so that naming a group moves no score by itself.

Training uses a bounded, documented sample of the labelled rows; scoring reads
every whole text once.

Defined cases: null and empty texts have no features and get the model's base
score; labels that are null are ignored, of contradicting labels of one id the
toxic one counts; without labelled texts of both kinds the score is the share
of toxic ones (0 without any); repeated rows are scored alike; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textvec as V
from quarry.llm.base import pick
from quarry.session import materialize

#: Bounds of the training sample and of the model.
MAX_TRAINING_DOCS = 12_000
MAX_FEATURES = 20_000
LEAST_DOCS = 4  # of a feature in the sample
LEAST_Z = 2.5  # of a feature's log odds between the classes
PREFIXES = (4, 5, 6)
RIDGE, SWAP_PENALTY, STEPS, RATE = 1e-3, 5.0, 250, 0.1
U64 = np.uint64

#: Groups of identity terms that may stand for one another.
IDENTITY_TERMS = (
    ("he", "she", "they"), ("man", "woman"), ("men", "women"), ("boy", "girl"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("american", "german", "french", "spanish", "mexican", "chinese", "african", "european"),
    ("old", "young"), ("disabled", "blind", "deaf"),
    ("mann", "frau"), ("männer", "frauen"), ("muslime", "juden", "christen"),
    ("homme", "femme"), ("hommes", "femmes"), ("musulmans", "juifs", "chrétiens"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("musulmanes", "judíos", "cristianos"),
)
NEXT_TERM = {t: g[(i + 1) % len(g)] for g in IDENTITY_TERMS for i, t in enumerate(g)}
_TERMS = re.compile(r"\b(?:" + "|".join(sorted(NEXT_TERM, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with every identity term replaced by the next one of its group."""
    return _TERMS.sub(lambda m: NEXT_TERM[m[0].lower()], text)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all words and word beginnings of a run, repeats included."""
    starts, ends, bounds = V.word_spans(data, offs)
    row = V.rows_of(bounds)
    rows, out = [row], [V.span_hashes(data, starts, ends, lower=True)]
    for i, n in enumerate(PREFIXES):
        long = ends - starts > n
        rows.append(row[long])
        out.append(V.mix(V.span_hashes(data, starts[long], starts[long] + n, lower=True) + U64(i + 1)))
    return np.concatenate(rows), np.concatenate(out)


def _sets(column) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for lo, hi, data, offs in V.text_runs(column):
        row, f = features(data, offs)
        order = np.lexsort((f, row))
        row, f = row[order], f[order]
        new = np.ones(len(f), bool)
        new[1:] = (row[1:] != row[:-1]) | (f[1:] != f[:-1])
        row, f = row[new], f[new]
        yield lo, hi, np.split(f, np.searchsorted(row, np.arange(1, hi - lo)))


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        other = [swapped(t) for t in texts]
        changed = np.array([a != b for a, b in zip(texts, other, strict=True)])
        plain = [s for *_, sets in _sets(pa.array(texts, pa.large_string())) for s in sets]
        swap = [s for *_, sets in _sets(pa.array(other, pa.large_string())) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([s.view(np.int64) for s in plain], kind),
             pa.array([s.view(np.int64) if c else None for s, c in zip(swap, changed, strict=True)], kind)],
            names=["label", "own", "swap"])


def _chosen_batches(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted numbers of the chosen features in place of all features; swapped rows that come out the same are null."""
    def chosen(x) -> np.ndarray:
        f = x.values.to_numpy(zero_copy_only=False).view(U64)
        if not len(f) or not len(keys):
            return np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
        return np.sort(at[keys[at] == f]).astype(np.int32)

    kind = pa.list_(pa.int32())
    for batch in batches:
        own = [chosen(x) for x in batch.column("own")]
        swap = [chosen(x) if x.is_valid else None for x in batch.column("swap")]
        swap = [None if s is None or np.array_equal(s, x) else s for s, x in zip(swap, own, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(own, kind), pa.array(swap, kind)],
                                         names=["label", "own", "swap"])


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the base score."""
    keys: np.ndarray
    weights: np.ndarray
    base: float

    def scores(self, column) -> np.ndarray:
        out = []
        seen = np.zeros(1 << 20, bool)
        seen[(self.keys & U64((1 << 20) - 1)).astype(np.int64)] = True
        for lo, hi, data, offs in V.text_runs(column):
            row, f = features(data, offs)
            maybe = seen[(f & U64((1 << 20) - 1)).astype(np.int64)]
            row, f = row[maybe], f[maybe]
            z = np.full(hi - lo, self.base)
            if len(f) and len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
                hit = self.keys[at] == f
                pair = np.unique(row[hit] * len(self.keys) + at[hit])
                z += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(labels: np.ndarray, own: list[np.ndarray], swap: list[np.ndarray | None], n: int) -> tuple[np.ndarray, float]:
    """Weights of n features and the base, by full-batch Adam on logistic loss (both classes weigh the same),
    ridge and the squared change of score under swapping."""
    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows])

    r, c = sparse(own)
    pair = np.array([i for i, s in enumerate(swap) if s is not None], np.int64)
    sr, sc = sparse([swap[i] for i in pair])
    weight = np.where(labels > 0.5, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[c], len(own)), -30, 30)))
        d = (p - labels) * weight
        if len(pair):
            q = 1 / (1 + np.exp(-np.clip(b + np.bincount(sr, w[sc], len(pair)), -30, 30)))
            gap = 2 * SWAP_PENALTY * (p[pair] - q) / len(pair)
            d[pair] += gap * p[pair] * (1 - p[pair])
            dq = -gap * q * (1 - q)
        g = np.append(np.bincount(c, d[r], n) + RIDGE * w, d.sum())
        if len(pair):
            g[:-1] += np.bincount(sc, dq[sr], n)
            g[-1] += dq.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def held_out(doc_id: Column) -> Column:
    """Rows that are never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model:
    """Model from docs (doc_id, text) and labels (doc_id, label); only rows that are not held out."""
    known = labels.where("label is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    share = min(1.0, 1.2 * max_docs / max(n, 1))
    order = F.xxhash64(F.lit("draw"), "doc_id")
    drawn = known.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(order, "doc_id").limit(max_docs)
    # at most max_docs rows of two numbers
    sample = docs.join(F.broadcast(drawn), "doc_id").select("label", "text")
    sample = materialize(sample.mapInArrow(_train_batches, "label double, own array<bigint>, swap array<bigint>"), "toxicity-sample")
    total, toxic = sample.agg(F.count("label"), F.sum("label")).first()
    if not total or toxic in (0, total):
        base = 30.0 if total and toxic == total else -30.0
        return Model(np.zeros(0, U64), np.zeros(0), base)
    each = sample.select("label", F.explode("own").alias("f")).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).where(F.col("n") >= LEAST_DOCS)
    t, o = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / (toxic + 1.0)) - F.log(o / (total - toxic + 1.0))
    best = each.select("f", F.abs(odds / F.sqrt(1 / t + 1 / o)).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(MAX_FEATURES)
    keys = np.sort(np.array([r.f for r in best.collect()], np.int64).view(U64))
    # at most max_docs rows, each with no more than the chosen features
    table = sample.mapInArrow(partial(_chosen_batches, keys=keys), "label double, own array<int>, swap array<int>").toArrow()
    own, swap = ([x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else None for x in table.column(c)]
                 for c in ("own", "swap"))
    label = table.column("label").to_numpy().astype(float)
    order = sorted(range(len(own)), key=lambda i: (label[i], own[i].tobytes()))  # sums don't depend on Spark's row order
    w, b = fit(label[order], [own[i] for i in order], [swap[i] for i in order], len(keys))
    return Model(keys, w, b)


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")), pa.float64())],
                                         names=["doc_id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
             label: str = "toxic", max_docs: int = MAX_TRAINING_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    src = pick(docs, doc_id=doc_id, text=text)
    known = pick(labels, doc_id=label_id, label=label).withColumn("label", F.col("label").cast("double"))
    model = train(src, known, max_docs)
    kind = src.schema["doc_id"].dataType.simpleString()
    scored = src.mapInArrow(partial(_score_batches, model=model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
