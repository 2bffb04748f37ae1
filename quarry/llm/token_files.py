"""Token-id shards in patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id; every partition becomes one
shard.  A shard is a sequence of blocks of ``BLOCK`` ids.  A block stores its
ids minus the block's minimum, packed with a width that holds a given
percentile of them; larger ones are exceptions, kept beside the block with
their places.  Behind the blocks stand the index of block starts, with each
block's minimum, width and exception count, then the index of documents.

Layout (little-endian): magic, blocks, block index, document index, footer
(number of ids, of blocks, of documents, place of the block index, magic).

Defined cases: null texts are empty; an empty table makes no shard; rows with
the same id stand beside each other, in the order of their texts; rows
without an id come first.  Document ids are integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textvec as V
from quarry.llm.base import parts_for, pick, text_bytes
from quarry.llm.shared_files import locate, new_file
from quarry.llm.tokenizers_io import plain_encoder
from quarry.session import scratch_path, ship_package

MAGIC = b"PFORIDS1"
BLOCK = 512
GROUP = 2048  # blocks that are packed or read at once
PERCENTILE = 95
INDEX = np.dtype([("place", "<u8"), ("least", "<u4"), ("width", "u1"), ("patches", "<u2"), ("count", "<u2")])
DOCS = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n_ids", "<u8")])
FOOTER = np.dtype([("n_ids", "<u8"), ("n_blocks", "<u8"), ("n_docs", "<u8"), ("index_at", "<u8"), ("magic", "S8")])
SHARD_BYTES = 32 << 20


def bit_widths(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value, 0 for 0."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, list[bytes]]:
    """Pack ids in blocks; only the last block may be short.  Returns index entries (places relative to
    the first block) and each block's bytes."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[:len(ids)] = ids
    grid = padded.reshape(n_blocks, BLOCK)
    least = grid.min(axis=1)
    delta = grid - least[:, None]
    rank = min(BLOCK - 1, BLOCK * percentile // 100)
    width = bit_widths(np.partition(delta, rank, axis=1)[:, rank])
    index = np.zeros(n_blocks, INDEX)
    index["least"], index["width"], index["count"] = least, width, BLOCK
    if n_blocks:
        index["count"][-1] = len(ids) - BLOCK * (n_blocks - 1)
    blocks: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        part = delta[rows].astype(np.uint64)
        outside = part >= np.uint64(1 << int(w))
        index["patches"][rows] = outside.sum(axis=1)
        low = part & np.uint64((1 << int(w)) - 1)
        bits = (low[:, :, None] >> np.arange(w, dtype=np.uint64)).astype(np.uint8) & 1
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for i, row in enumerate(rows):
            at = np.flatnonzero(outside[i])
            blocks[row] = packed[i].tobytes() + at.astype("<u2").tobytes() + part[i, at].astype("<u4").tobytes()
    sizes = np.array([len(b) for b in blocks], np.int64)
    index["place"] = np.cumsum(sizes) - sizes
    return index, blocks


def unpack_blocks(index: np.ndarray, raw: bytes) -> np.ndarray:
    """Ids of consecutive blocks; ``raw`` holds their bytes."""
    grid = np.zeros((len(index), BLOCK), np.uint32)
    data = np.frombuffer(raw, np.uint8)
    place = (index["place"] - index["place"][0]).astype(np.int64) if len(index) else np.zeros(0, np.int64)
    for w in np.unique(index["width"]):
        rows = np.flatnonzero(index["width"] == w)
        n = BLOCK * int(w) // 8
        if n:
            bits = np.unpackbits(data[place[rows][:, None] + np.arange(n)], axis=1, bitorder="little")
            weights = np.uint32(1) << np.arange(w, dtype=np.uint32)
            grid[rows] = (bits.reshape(len(rows), BLOCK, int(w)) * weights).sum(axis=2, dtype=np.uint32)
    for row in np.flatnonzero(index["patches"]):
        k, at = int(index["patches"][row]), int(place[row]) + BLOCK * int(index["width"][row]) // 8
        where = np.frombuffer(raw, "<u2", k, at)
        grid[row, where] = np.frombuffer(raw, "<u4", k, at + 2 * k)
    grid += index["least"][:, None]
    keep = np.arange(BLOCK) < index["count"][:, None]
    return grid[keep]


class ShardWriter:
    """Streams ids to a shard; holds one group of blocks and the indexes."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.index: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK * GROUP:
            self._flush(False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.held])
        cut = len(ids) if whole else len(ids) // BLOCK * BLOCK
        for lo in range(0, cut, BLOCK * GROUP):
            part = ids[lo:min(cut, lo + BLOCK * GROUP)]
            index, blocks = pack_blocks(part)
            index["place"] += self.at
            payload = b"".join(blocks)
            self.out.write(payload)
            self.at += len(payload)
            self.index.append(index)
        self.n_ids += cut
        self.held, self.n_held = [ids[cut:]], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        index = np.concatenate([np.zeros(0, INDEX), *self.index])
        docs = np.concatenate([np.zeros(0, DOCS), *self.docs])
        self.out.write(index.tobytes())
        self.out.write(docs.tobytes())
        foot = np.array([(self.n_ids, len(index), len(docs), self.at, MAGIC)], FOOTER)
        self.out.write(foot.tobytes())
        self.n_docs = len(docs)


def read_shard(uri: str) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """The document index of a shard, and its ids a group of blocks at a time."""
    store, path = locate(uri)
    size = store.get_file_info(path).size
    f = store.open_input_file(path)
    foot = np.frombuffer(f.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
    if foot["magic"] != MAGIC:
        raise ValueError(f"{uri} is no token-id shard")
    at, n = int(foot["index_at"]), int(foot["n_blocks"])
    index = np.frombuffer(f.read_at(n * INDEX.itemsize, at), INDEX)
    docs = np.frombuffer(f.read_at(int(foot["n_docs"]) * DOCS.itemsize, at + n * INDEX.itemsize), DOCS)

    def groups() -> Iterator[np.ndarray]:
        for lo in range(0, n, GROUP):
            part = index[lo:lo + GROUP]
            end = int(index["place"][lo + GROUP]) if lo + GROUP < n else at
            start = int(part["place"][0])
            yield unpack_blocks(part, f.read_at(end - start, start))
        f.close()

    return docs, groups()


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    enc = plain_encoder(tokenizer)
    shard = TaskContext.get().partitionId()
    uri = f"{folder}/shard-{shard:06d}.pfor"
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    if first is None:
        return
    with new_file(uri) as out:
        w = ShardWriter(out)
        for batch in _chain(first, batches):
            keys = batch.column("doc_id")
            for lo, hi, data, offs in V.text_runs(batch.column("text")):
                ids, bounds = enc.encode(data, offs)
                entries = np.zeros(hi - lo, DOCS)
                own = keys.slice(lo, hi - lo)
                entries["is_null"] = own.is_null().to_numpy(zero_copy_only=False)
                entries["doc_id"] = own.fill_null(0).to_numpy(zero_copy_only=False)
                entries["n_ids"] = np.diff(bounds) + 1
                w.add(entries, np.insert(ids, bounds[1:], end_id).astype(np.uint32))
        w.close()
    yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "n_docs": [w.n_docs], "n_ids": [w.n_ids]})


def _chain(first, rest):
    yield first
    yield from rest


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id",
                 text: str = "text", shard_bytes: int = SHARD_BYTES) -> list:
    """Encode all texts, each followed by ``end_id``, into shards below ``folder`` in ascending order
    of ids.  Returns one row per shard (shard, uri, n_docs, n_ids), in order."""
    src = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    n = parts_for(text_bytes(src), shard_bytes)
    parts = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    made = parts.mapInArrow(partial(_write_batches, folder=folder, tokenizer=tokenizer, end_id=end_id),
                            "shard bigint, uri string, n_docs bigint, n_ids bigint")
    return sorted(made.collect(), key=lambda r: r.shard)


def _read_batches(batches: Iterator[pa.RecordBatch], digest: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            docs, groups = read_shard(uri)
            sizes = docs["n_ids"].astype(np.int64)
            starts = start + np.cumsum(sizes) - sizes
            done: list = []
            held = np.zeros(0, np.uint32)
            for group in groups:
                held = np.concatenate([held, group])
                bounds = np.concatenate([[0], np.cumsum(sizes[len(done):])])
                whole = int(np.searchsorted(bounds, len(held), side="right")) - 1
                done += digest(held, bounds[:whole + 1])
                held = held[bounds[whole]:]
            ids = pa.array(docs["doc_id"], pa.int64(), mask=docs["is_null"].astype(bool))
            for lo in range(0, len(docs), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, 50_000), pa.array(starts[lo:lo + 50_000]), pa.array(sizes[lo:lo + 50_000]),
                     pa.array(done[lo:lo + 50_000], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])


def crc32_of_ids(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    raw = memoryview(ids.astype("<u4").tobytes())
    return [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def read_digests(spark: SparkSession, shards: list) -> DataFrame:
    """Per document, read back from the shards: doc_id, start (ids before it in all shards), n_tokens
    and the crc32 of its ids.  One task per shard; memory: one group of blocks, the largest document and
    the shard's document index."""
    ship_package(spark)
    rows, start = [], 0
    for s in shards:
        rows.append((s.uri, start))
        start += s.n_ids
    frame = spark.createDataFrame(rows, "uri string, start bigint")
    if len(rows) > 1:
        frame = frame.repartition(len(rows))
    return frame.mapInArrow(partial(_read_batches, digest=crc32_of_ids),
                            "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards (to a fresh shared folder unless one is named) and read their digests back."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    return read_digests(spark, write_shards(docs, folder, tokenizer, end_id, doc_id, text))
