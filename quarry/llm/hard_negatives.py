"""Hard negatives: rows of another label that score just below an anchor's positives.

Every row is indexed in a forest of R-trees (``rtree``).  Sort-tile-recursive
runs twice: across the table, rows are tiled by label and by the two
coordinates of the largest variance into shards of up to ``SHARD_ROWS`` rows,
by range partition (``operators.ranks``), so a label that holds a third of
the rows spreads over its shards; and inside a shard by the remaining
coordinates.  Anchors are then searched in blocks, one block being the
anchors of a shard:

1. against the shards of their own label, for the best rows: positives;
2. against the shards of all other labels, for the best rows inside each
   positive's score window: negatives.

Shards and blocks meet in groups of one shard and up to ``GROUP_BLOCKS``
blocks; only the best few per anchor and shard leave a group, and the best of
these are the result.

Scores are whole: components count as floor(256 x), and beyond +-2^26 as
+-2^26.  Defined cases: rows with a null id, label or vector, or with a null
or non-finite component, take no part; missing trailing components count as
zero, an empty vector as zeros; every row counts, so rows that share an id,
or are equal, are rows of their own, and an anchor excludes itself once; ties
go to the smaller id; a negative positive score leaves no window; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.base import pick
from quarry.llm.rtree import FANOUT, LEAF, Tree
from quarry.operators.ranks import arrange
from quarry.session import materialize

SHARD_ROWS = 1 << 15
GROUP_BLOCKS = 16
#: Buckets in which blocks and the list of shards are paired.
PAIR_BUCKETS = 64
SCALE, LIMIT = 256, 1 << 26

MOST_TASKS = 4096

INDEX = "label int, tile int, shards int, dim int, ids binary, rows binary, low binary, high binary, least binary"
#: A block's anchors, and per anchor and positive (-1: none) its id and score.
BLOCK = "label int, tile int, shards int, dim int, ids binary, rows binary, positive_ids binary, positive_scores binary, n_positives binary"
HIT = "b_label int, b_tile int, at int, which int, anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"
ANCHOR = ["b_label", "b_tile", "at"]
PAIR = ["label", "tile", "part"]


def points(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", relabel_every: int = 7,
           labels: int = 10) -> DataFrame:
    """vec_id, label, vec (whole components) of the rows that take part; every ``relabel_every``-th id has its
    label moved on by one."""
    src = pick(vectors, vec_id=vec_id, label=label, vec=vector)
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("vec", lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-LIMIT))),
                                                         F.lit(float(LIMIT)))).cast("int"))
    moved = F.when(F.col("vec_id") % relabel_every == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    return src.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), moved.cast("int").alias("label"), whole.alias("vec"))


def widest(rows: DataFrame, n: int) -> list[int]:
    """The coordinates of the largest variance; one row per coordinate comes to the driver."""
    spread = rows.select(F.posexplode("vec").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("v")).collect()
    return [r["at"] for r in sorted(spread, key=lambda r: (-r["v"], r["at"]))[:n]]


def tiles(rows: DataFrame) -> DataFrame:
    """rows with tile (number of their shard within the label) and shards (their number): slabs of equal size by
    one coordinate, cut by another."""
    axes = [*widest(rows, 2), 0, 0][:2]
    rows = rows.select("*", *[F.get("vec", F.lit(a)).alias(f"x{i}") for i, a in enumerate(axes)])
    rows = arrange(rows, ["x0", "vec_id"], ["label"]).with_windows("place", total="n")
    wanted = F.ceil(F.col("n") / SHARD_ROWS)
    slabs = F.ceil(F.sqrt(wanted)).cast("int")
    rows = rows.withColumn("slabs", slabs).withColumn("cuts", F.ceil(wanted / F.col("slabs")).cast("int"))
    slab = F.floor((F.col("place") - 1) * F.col("slabs") / F.col("n")).cast("int")
    rows = rows.select("vec_id", "label", "vec", "x1", "slabs", "cuts", slab.alias("slab"))
    rows = arrange(rows, ["x1", "vec_id"], ["label", "slab"]).with_windows("place", total="n")
    cut = F.floor((F.col("place") - 1) * F.col("cuts") / F.col("n")).cast("int")
    return rows.select("vec_id", "label", "vec", (F.col("slab") * F.col("cuts") + cut).alias("tile"),
                       (F.col("slabs") * F.col("cuts")).alias("shards"))


def _binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _pack(table: pa.Table) -> pa.Table:
    vec = table.column("vec").combine_chunks()
    vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
    size = np.diff(vec.offsets.to_numpy())
    dim = int(size.max(initial=0))
    rows = np.zeros((len(size), dim), np.int32)
    rows[np.arange(dim) < size[:, None]] = vec.flatten().to_numpy()
    tree = Tree.pack(rows, table.column("vec_id").to_numpy())
    low, high, least = (np.concatenate([b[i] for b in tree.boxes]) for i in range(3))
    head = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("label", "tile", "shards")}
    return pa.table({**head, "dim": pa.array([dim], pa.int32()), "ids": [_binary(tree.ids)], "rows": [_binary(tree.rows)],
                     "low": [_binary(low)], "high": [_binary(high)], "least": [_binary(least)]})


def build_index(rows: DataFrame) -> DataFrame:
    """One row per shard: its rows in tile order and the boxes of its tree, leaves first."""
    packed = tiles(rows).groupBy("label", "tile").applyInArrow(_pack, INDEX)
    return materialize(packed, "rtree-index")


def _matrix(raw: bytes, n: int, dim: int, width: int) -> np.ndarray:
    """n vectors of ``dim`` coordinates, widened with zeros."""
    return np.pad(np.frombuffer(raw, np.int32).reshape(n, dim), ((0, 0), (0, width - dim)))


def _tree(row: dict, width: int) -> Tree:
    ids, least = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["least"], np.int64)
    low, high = (_matrix(row[c], len(least), row["dim"], width) for c in ("low", "high"))
    boxes, at, n = [], 0, -(-len(ids) // LEAF)
    while n:
        boxes.append((low[at:at + n], high[at:at + n], least[at:at + n]))
        at, n = at + n, 0 if n == 1 else -(-n // FANOUT)
    return Tree(_matrix(row["rows"], len(ids), row["dim"], width), ids, boxes)


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pick_anchors(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            take = ids % every == 0
            if take.any():
                vectors = _matrix(row["rows"], len(ids), row["dim"], row["dim"])[take]
                out.append((row["label"], row["tile"], row["shards"], row["dim"], _binary(ids[take]), _binary(vectors), b"", b"", b""))
        yield from _table(out, BLOCK).to_batches()


def _search(shards: pa.Table, blocks: pa.Table, k: int, low_share: int, windows: bool) -> pa.Table:
    """The first k rows of a shard for every anchor of the blocks, or for each of its positives' windows."""
    out: list[tuple] = []
    if shards.num_rows and blocks.num_rows:
        shard, found = shards.to_pylist()[0], blocks.to_pylist()
        width = max(b["dim"] for b in [shard, *found])
        queries = [_matrix(b["rows"], len(b["ids"]) // 8, b["dim"], width) for b in found]
        tree = _tree(shard, width)
        tree.prepare(max(float(np.abs(q).max(initial=0)) for q in queries))
        for block, rows in zip(found, queries, strict=True):
            ids, key = np.frombuffer(block["ids"], np.int64).tolist(), (block["b_label"], block["b_tile"])
            if not windows:
                for at, q in enumerate(rows):
                    hits = tree.search(q, [-np.inf], [np.inf], k)[0]
                    out += [(*key, at, 0, ids[at], None, None, i, s) for s, i in hits]
                continue
            counts = np.frombuffer(block["n_positives"], np.int64)
            ends = np.cumsum(counts)
            positives = list(zip(np.frombuffer(block["positive_ids"], np.int64).tolist(),
                                 np.frombuffer(block["positive_scores"], np.int64).tolist(), strict=True))
            for at, q in enumerate(rows):
                own = [(w, i, s) for w, (i, s) in enumerate(positives[ends[at] - counts[at]:ends[at]]) if s >= 0]
                if own:
                    hits = tree.search(q, [-(-low_share * s // 100) for _, _, s in own], [s for _, _, s in own], k)
                    out += [(*key, at, w, ids[at], i, s, n_id, n_s) for (w, i, s), h in zip(own, hits, strict=True) for n_s, n_id in h]
    return _table(out, HIT)


def _keep_positives(blocks: pa.Table, hits: pa.Table, k: int) -> pa.Table:
    """Blocks with every anchor's first k rows besides itself."""
    out = []
    by_anchor: dict[int, list[tuple[int, int]]] = {}
    for at, s, i in sorted(zip(*(hits.column(c).to_pylist() for c in ("at", "score", "id")), strict=True), key=lambda r: (r[0], -r[1], r[2])):
        by_anchor.setdefault(at, []).append((i, s))
    for block in blocks.to_pylist():
        ids = np.frombuffer(block["ids"], np.int64)
        rows = _matrix(block["rows"], len(ids), block["dim"], block["dim"]).astype(np.int64)
        chosen = []
        for at, own in enumerate(zip(ids.tolist(), (rows * rows).sum(axis=1).tolist(), strict=True)):
            found = by_anchor.get(at, [])
            if own in found:
                found.remove(own)
            chosen.append(found[:k])
        flat = np.array([x for c in chosen for x in c], np.int64).reshape(-1, 2)
        out.append((*(block[c] for c in ("label", "tile", "shards", "dim", "ids", "rows")), _binary(flat[:, 0]), _binary(flat[:, 1]),
                    _binary(np.array([len(c) for c in chosen], np.int64))))
    return _table(out, BLOCK)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(*ANCHOR, "which").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(index: DataFrame, parts, blocks: DataFrame, groups: int, search) -> DataFrame:
    """Hits of blocks (label, tile, part of the shard to search) in the shards."""
    shards = index.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    n = max(1, min(groups, MOST_TASKS))  # one group is much work for few bytes, so partitions aren't merged by size
    left, right = (x.repartition(n, *PAIR).groupBy(*PAIR) for x in (shards, blocks))
    return left.cogroup(right).applyInArrow(search, HIT)


def mine(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, low_share: int = 80, vec_id: str = "vec_id",
         vector: str = "embedding", label: str = "label", relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor (ids divisible by
    ``anchor_every``) and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other
    labels that score from ``low_share`` per cent of the positive's score up to it."""
    index = build_index(points(vectors, vec_id, vector, label, relabel_every, labels))
    blocks = materialize(index.select(*[c for c in index.columns if c not in ("low", "high", "least")])
                         .mapInArrow(lambda it: _pick_anchors(it, anchor_every), BLOCK), "anchor-blocks")
    # positives: every block with the shards of its label
    parts = F.ceil(F.col("shards") / GROUP_BLOCKS).cast("int")
    own = blocks.select(F.col("label").alias("b_label"), F.col("tile").alias("b_tile"), "label", (F.col("tile") % parts).alias("part"),
                        "shards", "dim", "ids", "rows", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("tile"))
    n_shards = index.count()
    hits = _meet(index, parts, own, n_shards, lambda s, b: _search(s, b, positives + 1, low_share, False))
    hits = _best(hits, positives + 1).select(F.col("b_label").alias("label"), F.col("b_tile").alias("tile"), "at", "score", "id")
    chosen = blocks.groupBy("label", "tile").cogroup(hits.groupBy("label", "tile")).applyInArrow(
        lambda b, h: _keep_positives(b, h, positives), BLOCK)
    chosen = materialize(chosen, "anchor-positives")
    # negatives: every block with the shards of the other labels
    n_parts = max(1, -(-n_shards // GROUP_BLOCKS))
    bucket = F.pmod(F.xxhash64("label", "tile"), F.lit(PAIR_BUCKETS)).cast("int")
    targets = index.select(F.col("label").alias("t_label"), F.col("tile").alias("t_tile"), bucket.alias("bucket"))
    other = chosen.select(F.col("label").alias("b_label"), F.col("tile").alias("b_tile"),
                          F.pmod(F.xxhash64("label", "tile"), F.lit(n_parts)).cast("int").alias("part"), "dim", "ids", "rows",
                          "positive_ids", "positive_scores", "n_positives",
                          F.explode(F.sequence(F.lit(0), F.lit(PAIR_BUCKETS - 1))).alias("bucket"))
    other = other.join(targets, "bucket").where("t_label <> b_label").drop("bucket").withColumnsRenamed({"t_label": "label", "t_tile": "tile"})
    found = _meet(index, F.lit(n_parts), other, n_shards * n_parts, lambda s, b: _search(s, b, negatives, low_share, True))
    return _best(found, negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                          F.col("score").alias("negative_score"))
