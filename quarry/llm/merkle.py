"""Merkle manifest of a table: a digest tree per source, a tree over the sources, proofs for every row.

H is sha256 in lowercase hex of the concatenated inputs, digests entering as
hex text.  A row's leaf is H of its fields, each ``-`` if null and otherwise
its UTF-8 byte count, ``:`` and the value.  A source's leaves ascend by id
(ties by leaf); while several nodes remain, every ``ARITY`` consecutive ones
become their H, the last run being shorter where they don't divide.  What
remains is the source's subroot; the subroots, by source (null first), form
the root in the same way.

The tree is kept as a postorder append log: a node is written when its last
child is, so the log only grows.  A node's place in it follows from the sizes
of the subtrees completed before it (``place``), without any index.

* Builders.  A builder takes ``ARITY ** BUILD_LEVELS`` consecutive leaves of a
  source, an aligned subtree, whose nodes are one unbroken stretch of the
  log, and writes them in completion order.  The subtree tops are the leaves
  of the next tier of builders, until one node is left.  A source of any size
  is spread over its builders; leaves are numbered by range partition
  (``operators.ranks``), so no source is sorted in one task.
* Proofs.  Paths are handed down tier by tier: a builder reads its nodes'
  siblings at their closed-form places and passes what lies above on to its
  children.  The lowest tier folds every leaf up to the root.

Defined cases: a null id is smallest and its row is never tampered with; null
sources form a source of their own; equal ids are ordered by leaf, and
repeated rows are leaves of their own; texts of any length are hashed whole;
an empty table gives no rows and no root; extra columns are ignored.  Ids
and lengths are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import pick, quoted
from quarry.operators.ranks import arrange
from quarry.session import materialize

ARITY = 3
#: Levels that one builder completes: 3^7 = 2187 leaves.
BUILD_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


# --- the shape of a tree ------------------------------------------------------

def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    h = 0
    while ARITY ** h < leaves:
        h += 1
    return h


def place(level: int, index: int, leaves: int, top: int) -> int:
    """Postorder position of the node in a tree of ``leaves`` leaves whose highest level is ``top``: the
    nodes completed before it, counted per level from the number of leaves then written."""
    end = min((index + 1) * ARITY ** level, leaves)
    before = -1
    for j in range(top + 1):
        size = ARITY ** j
        if j > level:
            before += (end - 1) // size
        else:
            before += -(-end // size) if end == leaves else end // size
    return before


def siblings(level: int, index: int, leaves: int) -> tuple[int, list[int]]:
    """The node's number in its run, and the indices of the run's other nodes."""
    first = index - index % ARITY
    last = min(first + ARITY, -(-leaves // ARITY ** level))
    return index - first, [i for i in range(first, last) if i != index]


def proof_places(index: int, leaves: int) -> list[int]:
    """Log positions of all siblings on the way from a leaf to the top, level by level."""
    top = height(leaves)
    out = []
    for level in range(top):
        out += [place(level, i, leaves, top) for i in siblings(level, index, leaves)[1]]
        index //= ARITY
    return out


def digest_of(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(n.hex().encode() for n in nodes)).digest()


def complete(leaves: list[bytes], top: int) -> bytes:
    """A subtree's nodes in completion order: every leaf, and after it each node that it completes."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(top + 1)]
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        open_runs[0].append(leaf)
        for level in range(top):
            if len(open_runs[level]) < ARITY and i + 1 < len(leaves):
                break
            if open_runs[level]:
                node = digest_of(open_runs[level])
                open_runs[level] = []
                open_runs[level + 1].append(node)
                log.append(node)
    return b"".join(log)


# --- leaves ------------------------------------------------------------------

def _encoded(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_encoded(v) for v in values]).cast("binary"), 256))


def tree_key(source: Column) -> Column:
    """Sources as text without nulls, in the same order: null first, then by bytes."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source.cast("string")))


# --- builders ----------------------------------------------------------------

BUILT = "tree string, block bigint, n bigint, nodes binary"


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    tree, block, n = (table.column(c)[0].as_py() for c in ("tree", "block", "n"))
    nodes = complete(table.column("node").to_pylist(), min(BUILD_LEVELS, height(n)))
    return pa.table({"tree": [tree], "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64()),
                     "nodes": pa.array([nodes], pa.binary())})


def _block() -> Column:
    return F.floor(F.col("at") / F.lit(ARITY ** BUILD_LEVELS)).cast("bigint")


def build_tiers(rows: DataFrame) -> list[DataFrame]:
    """rows: tree, at (index among the tree's ``n`` leaves), n, node.  One table per tier: tree, block,
    n (the tier's leaves), nodes (the builder's subtree in completion order, leaves included)."""
    tiers = []
    while True:
        built = rows.select("tree", _block().alias("block"), "at", "n", "node").groupBy("tree", "block").applyInArrow(_build, BUILT)
        tiers.append(materialize(built, "merkle-tier"))
        size = F.lit(ARITY ** BUILD_LEVELS)
        larger = tiers[-1].where(F.col("n") > size)
        if larger.isEmpty():
            return tiers
        rows = larger.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / size).cast("bigint").alias("n"),
                             F.expr(f"substring(nodes, -{DIGEST}, {DIGEST})").alias("node"))


def roots(tiers: list[DataFrame]) -> DataFrame:
    """tree, node: the node that remains of every tree."""
    done = [t.where(F.col("n") <= ARITY ** BUILD_LEVELS) for t in tiers]
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out.select("tree", F.expr(f"substring(nodes, -{DIGEST}, {DIGEST})").alias("node"))


def append_log(tiers: list[DataFrame]) -> DataFrame:
    """The whole log: tree, position, node, one row per node."""
    def batches(tier: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                places, nodes = [], []
                for level, index, node in _subtree(row, tier):
                    if tier == 0 or level > 0:
                        places.append(place(tier * BUILD_LEVELS + level, index, row["leaves"], height(row["leaves"])))
                        nodes.append(node)
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(nodes), pa.string()), pa.array(places, pa.int64()),
                                                  pa.array(nodes, pa.binary())], names=["tree", "position", "node"])

    sizes = tiers[0].groupBy("tree").agg(F.max("n").alias("leaves"))
    out = None
    for t, table in enumerate(tiers):
        part = table.join(sizes, "tree").mapInArrow(lambda it, t=t: batches(t, it), "tree string, position bigint, node binary")
        out = part if out is None else out.unionByName(part)
    return out


def _subtree(row: dict, tier: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, index in the tier, node) of a builder's nodes."""
    n, block, nodes = row["n"], row["block"], row["nodes"]
    full = ARITY ** BUILD_LEVELS
    here, top = min(full, n - block * full), min(BUILD_LEVELS, height(n))
    for level in range(top + 1):
        for i in range(-(-here // ARITY ** level)):
            at = place(level, i, here, top) * DIGEST
            yield level, block * (full // ARITY ** level) + i, nodes[at:at + DIGEST]


# --- proofs ------------------------------------------------------------------
# A path is a run of levels: the node's number in its run, the number of siblings, the siblings.

class Subtree:
    """A builder's nodes, read at their closed-form places."""

    def __init__(self, n: int, block: int, nodes: bytes):
        full = ARITY ** BUILD_LEVELS
        self.leaves, self.top, self.nodes = min(full, n - block * full), min(BUILD_LEVELS, height(n)), nodes
        self.places = [[place(level, i, self.leaves, self.top) for i in range(-(-self.leaves // ARITY ** level))]
                       for level in range(self.top + 1)]

    def node(self, level: int, index: int) -> bytes:
        at = self.places[level][index] * DIGEST
        return self.nodes[at:at + DIGEST]

    def path(self, index: int) -> bytes:
        out = []
        for level in range(self.top):
            own, others = siblings(level, index, self.leaves)
            out.append(bytes([own, len(others)]))
            out += [self.node(level, i) for i in others]
            index //= ARITY
        return b"".join(out)


def read_path(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        own, n = path[at], path[at + 1]
        at += 2
        yield own, [path[at + i * DIGEST:at + (i + 1) * DIGEST] for i in range(n)]
        at += n * DIGEST


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for own, others in read_path(path):
        node = digest_of([*others[:own], node, *others[own:]])
    return node


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            tree = Subtree(row["n"], row["block"], row["nodes"])
            first = row["block"] * ARITY ** BUILD_LEVELS
            yield pa.RecordBatch.from_arrays([
                pa.array([row["tree"]] * tree.leaves, pa.string()), pa.array(range(first, first + tree.leaves), pa.int64()),
                pa.array([tree.path(i) + row["path"] for i in range(tree.leaves)], pa.binary())], names=["tree", "at", "path"])


def with_paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier's builders with the path from their top on; ``above``: tree, path of its root."""
    down = None
    for table in reversed(tiers):
        done = table.where(F.col("n") <= ARITY ** BUILD_LEVELS).join(above, "tree")
        if down is not None:
            rest = table.where(F.col("n") > ARITY ** BUILD_LEVELS).join(down, (table.tree == down.tree) & (table.block == down["at"]))
            done = done.unionByName(rest.select(*[table[c] for c in table.columns], "path"))
        if table is tiers[0]:
            return done
        down = materialize(done.mapInArrow(_hand_down, "tree string, at bigint, path binary"), "merkle-paths")
    raise AssertionError("no tier")


PROVED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(rows: pa.Table, built: pa.Table) -> pa.Table:
    out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
    if rows.num_rows:
        at = built.select(["n", "block", "nodes", "path", "subroot", "root"]).to_pylist()[0]
        tree, first = Subtree(at["n"], at["block"], at["nodes"]), at["block"] * ARITY ** BUILD_LEVELS
        for row in rows.select(["doc_id", "at", "changed"]).to_pylist():
            index = row["at"] - first
            leaf, path = tree.node(0, index), tree.path(index) + at["path"]
            others = [s for _, run in read_path(path) for s in run]
            root = fold(row["changed"] or leaf, path)
            for name, value in (("doc_id", row["doc_id"]), ("leaf", leaf.hex()), ("subroot", at["subroot"].hex()),
                                ("root", at["root"].hex()), ("proof_sha256", digest_of(others).hex()),
                                ("folded_root", root.hex()), ("verified", root == at["root"])):
                out[name].append(value)
    return pa.table({"doc_id": pa.array(out.pop("doc_id"), pa.int64()), "verified": pa.array(out.pop("verified"), pa.bool_()),
                     **{c: pa.array(v, pa.string()) for c, v in out.items()}}).select(
        ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


class Manifest:
    """Trees over the rows of ``docs``.  ``changed`` may give a leaf to verify instead of the row's own."""

    def __init__(self, docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source",
                 changed: Column | None = None):
        pick(docs)  # ships the package
        leaves = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), tree_key(quoted(source)).alias("tree"),
                             leaf_digest([quoted(c) for c in fields]).alias("node"),
                             (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
        ordered = arrange(leaves, ["doc_id", "node"], keys=["tree"]).with_windows("number", total="n")
        self.rows = ordered.withColumn("at", F.col("number") - 1)
        self.tiers = build_tiers(self.rows)
        self.subroots = roots(self.tiers)
        sources = arrange(self.subroots, ["tree"]).with_windows("number", total="n")
        self.sources = sources.select("tree", "node", (F.col("number") - 1).alias("at"), "n")
        self.top = build_tiers(self.sources.select(F.lit("").alias("tree"), "at", "n", "node"))
        self.root = roots(self.top)

    def source_paths(self) -> DataFrame:
        """tree, subroot, root, path: how every source's subroot leads to the root."""
        built = with_paths(self.top, self.root.select("tree", F.lit(b"").alias("path")))
        down = built.mapInArrow(_hand_down, "tree string, at bigint, path binary").select("at", "path")
        root = self.root.first()  # one digest
        named = self.sources.select("tree", F.col("node").alias("subroot"), "at", F.lit(root and root["node"]).cast("binary").alias("root"))
        return materialize(named.join(down, "at").drop("at"), "merkle-sources")

    def proofs(self) -> DataFrame:
        """Per row: doc_id, leaf, subroot, root, proof_sha256 (H of all siblings up to the root), folded_root (from the
        changed leaf, where there is one), verified."""
        up = self.source_paths()
        built = with_paths(self.tiers, up.select("tree", "path")).join(up.select("tree", "subroot", "root"), "tree")
        rows = self.rows.select("tree", _block().alias("block"), "doc_id", "at", "changed")
        return rows.groupBy("tree", "block").cogroup(built.groupBy("tree", "block")).applyInArrow(_prove, PROVED)


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, with every second row by crc32 of its id tampered with: its text loses its
    line breaks."""
    tampered = F.crc32(quoted("doc_id").cast("bigint").cast("string").cast("binary")) % 2 == 0
    values = [F.replace(quoted(c), F.lit("\n"), F.lit("")) if c == "text" else quoted(c) for c in FIELDS]
    return Manifest(docs, changed=F.when(tampered, leaf_digest(values))).proofs()
