"""Near-duplicate documents by an inverted join of MinHash coordinates.

1. Every document's set of word shingles gets a 128-bit digest and a
   signature of ``K`` coordinates.  Documents with equal sets form a class;
   only classes go on, each named by its smallest document id.
2. A class is posted under each (coordinate, value) pair.  Two classes that
   are similar enough collide in at least ``T`` of the K postings (the chance
   that a pair at the threshold doesn't is below 1e-6).  Postings nobody
   shares are dropped, classes left with fewer than T are dropped, and of the
   others' m postings only the m - T + 1 rarest are merged: two classes with
   T collisions must share one of these, so the longest lists are skipped.
3. Rounds of linear candidates: each list names a representative, the others
   are paired with it.  Pairs whose signatures agree in T coordinates are
   confirmed on the full sets, and the links are contracted to components.
4. Lists that still hold several components are compared in blocks, class by
   class across components, so no link is lost; pairs inside a component need
   no check, and a group of near copies never becomes all its pairs.  A pair
   counts in the first list that both merge.
5. Before full sets travel, a candidate must also agree in ``LONG_T`` of
   ``LONG_K`` more coordinates of a byte each, made for candidates only (a pair
   at the threshold fails that with a chance below 2e-6).

Defined cases: texts without words (or null) have an empty set and no links;
fewer words than a shingle make one shingle of the whole sequence; rows
without an id keep a null component; rows that share an id are judged each by
its own text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textvec as V
from quarry.llm.base import pick
from quarry.llm.components import components
from quarry.session import materialize

SHINGLE = 5
#: Similarity threshold as a fraction: linked if 100 * intersection >= 75 * union.
SIMILAR = (75, 100)
K = 64
#: At a similarity of 0.75 the number of collisions is binomial (64, 0.75): P(fewer than 30) < 1e-6.
T = 30
#: Byte coordinates agree with a chance of 0.751 at a similarity of 0.75: binomial (512, 0.751), P(fewer than 338) < 2e-6.
LONG_K = 512
LONG_T = 338
STAR_ROUNDS = 3
BLOCK = 2048
#: Of the bitmap that picks candidates' texts; more ids than that only mean more sets are made.
FILTER_BITS = 1 << 25

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 2**64 - 1, K + LONG_K, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63 - 1, K + LONG_K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DIGEST = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def signatures(sets: np.ndarray, bounds: np.ndarray, first: int = 0, n: int = K, kind=np.uint32) -> np.ndarray:
    """n x rows matrix of minima (their low bits, for a narrower kind); rows must not be empty."""
    out = np.empty((n, len(bounds) - 1), kind)
    for k in range(n):
        h = (((sets ^ _XOR[first + k]) * _MUL[first + k]) >> np.uint64(32)).astype(np.uint32)
        out[k] = np.minimum.reduceat(h, bounds[:-1]).astype(kind)
    return out


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in V.text_runs(batch.column("text")):
            sets = list(V.shingle_sets(data, offs, SHINGLE))
            sizes = np.array([len(s) for s in sets], np.int64)
            digests, sig = np.zeros((2, hi - lo), np.uint64), np.zeros((hi - lo, K), np.uint32)
            full = np.flatnonzero(sizes)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(sizes[full])])
                for j, seed in enumerate(_DIGEST):
                    digests[j, full] = np.add.reduceat(V.mix(flat ^ seed), at[:-1])
                sig[full] = signatures(flat, at).T
            raw = sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes),
                 pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * K),
                                          pa.array(np.frombuffer(raw, np.int32)))],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"])


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (d1, d2) and signature of every document."""
    src = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return src.mapInArrow(_sketch_batches, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig array<int>")


def _pack_bits(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << 16, bool)
    bits[table.column("bit").to_numpy() & 0xFFFF] = True
    return pa.table({"block": [table.column("block")[0].as_py()], "bits": [np.packbits(bits).tobytes()]})


def _bitmap(ids: DataFrame) -> np.ndarray:
    """One bit per hash of an id, ``FILTER_BITS`` in all (4 MB), whatever the number of ids."""
    bit = F.pmod(F.xxhash64("cid"), F.lit(FILTER_BITS))
    rows = ids.select(bit.alias("bit")).distinct().withColumn("block", F.shiftright("bit", 16))
    out = np.zeros(FILTER_BITS, bool)
    for r in rows.groupBy("block").applyInArrow(_pack_bits, "block bigint, bits binary").collect():
        out[r.block << 16:(r.block + 1) << 16] = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return np.packbits(out)


def _set_batches(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = batch.column("bit").to_numpy()
        batch = batch.filter(pa.array(bitmap[bit >> 3] >> (7 - (bit & 7)) & 1 == 1))
        for lo, hi, data, offs in V.text_runs(batch.column("text")):
            sets = list(V.shingle_sets(data, offs, SHINGLE))
            sizes = np.array([len(s) for s in sets], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            out = [batch.column("cid").slice(lo, hi - lo),
                   pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))]
            full = np.flatnonzero(sizes)
            coords = np.zeros((hi - lo, LONG_K), np.uint8)
            if len(full):
                coords[full] = signatures(flat, np.append(bounds[full], bounds[-1]), K, LONG_K, np.uint8).T
            out.append(pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [
                None, pa.py_buffer((np.arange(hi - lo + 1) * LONG_K).astype(np.int32)), pa.py_buffer(coords.tobytes())]))
            yield pa.RecordBatch.from_arrays(out, names=["cid", "shingles", "coords"])


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """cid, full set and byte coordinates of the classes whose ids are named (and of a few others: a
    bitmap of hashes picks the rows, so no text is shuffled)."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("cid"), "text",
                                                   F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))
    return materialize(rows.mapInArrow(partial(_set_batches, bitmap=_bitmap(ids)),
                                       "cid bigint, shingles array<bigint>, coords binary"), "shingle-sets")


def _postings(classes: DataFrame) -> DataFrame:
    """coordinate, value, cid: the lists to merge; ``merged``: bits of the coordinates the class is listed under."""
    posted = classes.select("cid", F.posexplode("sig").alias("coordinate", "value"))
    lengths = posted.groupBy("coordinate", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posted.join(lengths, ["coordinate", "value"])
    own = shared.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "coordinate", "value"))).alias("p"))
    own = own.where(F.size("p") >= T).select("cid", F.expr(f"slice(p, 1, size(p) - {T} + 1)").alias("p"))
    merged = F.aggregate("p", F.lit(0).cast("bigint"),
                         lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["coordinate"])))
    own = own.select("cid", merged.alias("merged"), F.explode("p").alias("p"))
    return own.select("p.coordinate", "p.value", "cid", "merged")


def _agree(x: Column, y: Column) -> Column:
    """Collisions of two signatures."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    wide = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b").join(
        sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return wide.where(both * SIMILAR[1] >= union * SIMILAR[0]).select("a", "b").distinct()


def _matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those with T collisions."""
    sig = classes.select("cid", "sig")
    wide = pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("x")), "a").join(
        sig.select(F.col("cid").alias("b"), F.col("sig").alias("y")), "b")
    return wide.where(_agree(F.col("x"), F.col("y")) >= T).select("a", "b").distinct()


def _long_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LONG_K) for c in ("x", "y"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LONG_T))


def _long_matching(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that also agree in enough byte coordinates; full sets needn't travel for
    the others."""
    coords = sets.select("cid", "coords")
    wide = pairs.join(coords.select(F.col("cid").alias("a"), F.col("coords").alias("x")), "a").join(
        coords.select(F.col("cid").alias("b"), F.col("coords").alias("y")), "b")
    return wide.select("a", "b", "x", "y").mapInArrow(_long_batches, "a bigint, b bigint").distinct()


def _cross_blocks(table: pa.Table) -> pa.Table:
    """Pairs of one list's blocks that agree often enough, lie in different components, and have this
    list as the first one that both are listed in."""
    table = table.combine_chunks()
    cid, comp = table.column("cid").to_numpy(), table.column("comp").to_numpy()
    left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("is_left", "is_right"))
    sig = table.column("sig").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, K)
    coords = np.frombuffer(b"".join(table.column("coords").to_pylist()), np.uint8).reshape(-1, LONG_K)
    bits = (table.column("merged").to_numpy()[None, :] >> np.arange(K)[:, None]) & 1 == 1
    c = table.column("coordinate")[0].as_py()
    sig_r, bits_r = np.ascontiguousarray(sig[right].T), bits[:, right]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left:
        agree = sig_r == sig[i][:, None]
        earlier = (agree[:c] & bits_r[:c])[bits[:c, i]].any(axis=0)
        j = right[(agree.sum(axis=0) >= T) & (comp[right] != comp[i]) & ~earlier]
        j = j[(coords[j] == coords[i]).sum(axis=1) >= LONG_T] if len(j) else j
        found_a.append(np.minimum(cid[i], cid[j]))
        found_b.append(np.maximum(cid[i], cid[j]))
    pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], axis=1), axis=0).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _cross_pairs(lists: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """All agreeing pairs across components within the lists, compared block by block."""
    key = ["coordinate", "value"]
    lengths = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = lists.join(lengths, key).withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    signed = classes.select("cid", "sig").join(sets.select("cid", "coords"), "cid")
    rows = rows.join(signed, "cid").select(
        *key, "i", "j", "cid", "comp", "merged", "sig", "coords", (F.col("own") == F.col("i")).alias("is_left"),
        (F.col("own") == F.col("j")).alias("is_right"))
    return rows.groupBy(*key, "i", "j").applyInArrow(_cross_blocks, "a bigint, b bigint").distinct()


def _with_components(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Lists with each class's component; only lists that hold several components stay."""
    if labels is None:
        return lists.withColumn("comp", F.col("cid"))
    rows = lists.join(labels, lists.cid == labels.node, "left").select(
        *lists.columns, F.coalesce("component", "cid").alias("comp"))
    key = ["coordinate", "value"]
    mixed = rows.groupBy(*key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(*key)
    return rows.join(mixed, key, "left_semi")


def links(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(node, component) of all linked classes; None if there are no links."""
    lists = materialize(_postings(classes), "postings")
    key = ["coordinate", "value"]
    edges = tested = labels = sets = None
    for step in range(STAR_ROUNDS + 1):
        rows = materialize(_with_components(lists, labels), "mixed-lists")
        if step and sets is None:
            sets = _sets(docs, rows.select("cid"))
        if step < STAR_ROUNDS:
            # one order for all lists, so that the lists of one group name the same representative
            order = F.col("cid") if step == 0 else F.xxhash64("cid", F.lit(step))
            reps = rows.groupBy(*key).agg(F.min_by(F.struct("cid", "comp"), order).alias("r"))
            pairs = rows.join(reps, key).where("comp <> r.comp").select(
                F.least("cid", F.col("r.cid")).alias("a"), F.greatest("cid", F.col("r.cid")).alias("b")).distinct()
            pairs = _matching(pairs, classes)
        else:
            sets = sets or _sets(docs, rows.select("cid"))
            pairs = _cross_pairs(rows, classes, sets)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "candidate-pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        full = sets or _sets(docs, pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))))
        if step < STAR_ROUNDS:
            pairs = _long_matching(pairs, full)
        new = materialize(_confirm(pairs, full), "links")
        if new.isEmpty():
            continue
        edges = new if edges is None else edges.unionByName(new)
        labels = components(edges)
    return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept, of every row."""
    src = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sketch = materialize(sketches(src), "sketches")
    digest = ["n_shingles", "d1", "d2"]
    real = sketch.where("n_shingles > 0 and doc_id is not null")
    members = real.groupBy(*digest).agg(F.min("doc_id").alias("cid"))
    classes = materialize(real.groupBy(*digest).agg(F.min_by("sig", "doc_id").alias("sig"), F.min("doc_id").alias("cid"))
                          .select("cid", "sig"), "classes")
    labels = links(classes, src)
    out = sketch.select("doc_id", *digest).join(members, digest, "left")
    if labels is None:
        out = out.withColumn("component", F.lit(None).cast("bigint"))
    else:
        out = out.join(labels, out.cid == labels.node, "left")
    component = F.coalesce("component", "cid", "doc_id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
