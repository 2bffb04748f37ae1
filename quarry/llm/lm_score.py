"""Scores of texts by a context-tree model of their bytes, beside a word model.

Texts are read with A-Z lower-cased.  The model (``context_tree``) predicts
each byte from the ``DEPTH`` bytes before it, and the end of the text after
its last byte; a text's score is the log10 of its chance, so it divided by
-log10(2) and the number of bytes is the code length per byte.  The word
model beside it adds 0.1 to every count of a word or of the end.

Both learn from the rows that are not held out, in four steps:

1. One scan cuts the rows into chunks, in the order they are read.  A chunk is
   written with its texts, and lists its distinct grams (context and byte)
   and words, with how often its training rows hold them.
2. Cells of the model, dealt by the two nearest context bytes or by the word,
   gather the lists: their union with summed counts, and every list as places
   in the union.  Their trees report what depth 1 needs: at most 256 x 255
   nodes, which are summed in Spark and come to the driver.
3. The cells answer each chunk's lists: the log chance of every gram, the
   training count of every word.
4. Chunks sum the answers over their texts.

A gram or word enters a shuffle once per chunk, however often it occurs; texts
and lists (byte planes of differences) are written compressed.

Defined cases: null texts are empty, and an empty text is one end; rows
without an id are held out; repeated rows are scored one by one, and count as
often as they occur; a text much longer than a run is read in pieces that end
between words; without training rows every decision has a chance of 1/2; an
empty table gives no rows; extra columns are ignored.  Words and their counts
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import context_tree as C
from quarry.llm import textvec as V
from quarry.llm.base import parts_for, pick, quoted, text_bytes
from quarry.session import materialize

CHUNK_BYTES = 8 << 20
#: Lists of a chunk's runs are merged when they hold so many keys.
PENDING = 1 << 19
RANGES = 16
RUN_BYTES = 1 << 18
U64 = np.uint64
#: Stands for the end among the words' hashes.
END = U64(0xE0D0_0F0F_7E57_0001)
GRAMS, WORDS = 0, 1
#: What cells report: counts by (context byte, byte), sums by node, tokens, distinct tokens.
BY_BYTE, BY_NODE, TOKENS, DISTINCT = range(4)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] = LOWER[0x61:0x7B]

#: A chunk's texts (cell -1: bytes, lengths, ids, marks) and its lists (keys, counts).
SENT = "chunk string, cell int, keys binary, counts binary, ids binary, marks binary"
GATHERED = ("cell int, keys binary, counts binary, chunks array<string>, places array<binary>, told_what binary, told_keys binary, "
            "told_n binary, told_s binary")
REPORTED = "what int, key bigint, n bigint, s double"
ANSWERED = "chunk string, cell int, found binary"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
TEXTS = -1
HELD, NO_ID = 1, 2
_zstd = pa.Codec("zstd", compression_level=3)


def squeeze(a: np.ndarray) -> bytes:
    raw = pa.py_buffer(np.ascontiguousarray(a))
    return raw.size.to_bytes(8, "little") + _zstd.compress(raw, asbytes=True) if raw.size else b""


def unsqueeze(raw) -> bytes:
    raw = memoryview(raw)
    return _zstd.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True) if len(raw) else b""


def planes(a: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, lowest bytes first, so that the mostly empty high planes compress."""
    return squeeze(a.astype(U64).view(np.uint8).reshape(-1, 8).T)


def from_planes(raw) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(raw), np.uint8).reshape(8, -1).T).reshape(-1).view(U64)


def differences(a: np.ndarray) -> bytes:
    return planes(np.diff(a.astype(U64), prepend=U64(0)))


def from_differences(raw) -> np.ndarray:
    return np.cumsum(from_planes(raw), dtype=U64)


def pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """A run as (bytes, rows' offsets, the bytes before it, does it end its rows?); a single row that is longer
    than a run is cut after separators."""
    lo, edge = 0, np.full(C.DEPTH, C.EDGE, np.uint8)
    if len(offs) == 2:
        cuts = np.flatnonzero(V.SPACE[data]) + 1 if len(data) > V.RUN_BYTES else np.zeros(0, np.int64)
        while len(data) - lo > V.RUN_BYTES:
            i = max(np.searchsorted(cuts, lo + V.RUN_BYTES, side="right") - 1, np.searchsorted(cuts, lo, side="right"))
            if i >= len(cuts) or cuts[i] >= len(data):
                break
            before = np.concatenate([edge, data[max(lo - C.DEPTH, 0):lo]])[-C.DEPTH:]
            yield data[lo:cuts[i]], np.array([0, cuts[i] - lo]), before, False
            lo = int(cuts[i])
    before = np.concatenate([edge, data[max(lo - C.DEPTH, 0):lo]])[-C.DEPTH:]
    yield data[lo:], np.clip(offs - lo, 0, None), before, True


def grams_of(data: np.ndarray, offs: np.ndarray, before: np.ndarray, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all bytes, and of the end of every row if ``ends``, and the row of each."""
    n, size = len(offs) - 1, np.diff(offs)
    row = np.repeat(np.arange(n), size)
    ext = np.full(len(data) + n * (C.DEPTH + 1), C.EDGE, np.uint8)
    ext[:C.DEPTH] = before
    ext[np.arange(len(data)) + row * (C.DEPTH + 1) + C.DEPTH] = data
    row = np.repeat(np.arange(n), size + ends)
    return C.pack(ext)[np.arange(len(row)) + row * (C.DEPTH + (not ends))], row


def keys_of(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, keys, rows) of a run's grams and words, piece by piece."""
    for part, rows, before, ends in pieces(data, offs):
        yield GRAMS, *grams_of(part, rows, before, ends)
        first, last, bounds = V.word_spans(part, rows)
        keys, row = V.span_hashes(part, first, last), V.rows_of(bounds)
        if ends:
            n = len(rows) - 1
            keys, row = np.append(keys, np.full(n, END)), np.append(row, np.arange(n))
        yield WORDS, keys, row


def _heads(k: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], k[1:] != k[:-1]])[:len(k)]


class Counted:
    """Distinct keys, with how often training rows hold them."""

    def __init__(self):
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, trains: np.ndarray) -> None:
        order = np.argsort(keys)
        k = keys[order]
        heads = np.flatnonzero(_heads(k))
        if len(heads):
            self.pending.append((k[heads], np.add.reduceat(trains[order], heads, dtype=np.int64)))
            self.size += len(heads)
            if self.size > PENDING + (len(self.pending[0][0]) if len(self.pending) > 1 else 0):
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """All pending lists as one; merged range by range of keys, so that little is held twice."""
        if len(self.pending) != 1:
            largest = max((p[0] for p in self.pending), key=len, default=np.zeros(0, U64))
            cuts = largest[np.arange(1, RANGES) * len(largest) // RANGES] if len(largest) else largest
            bounds = [np.concatenate([[0], np.searchsorted(k, cuts), [len(k)]]) for k, _ in self.pending]
            done = [(np.zeros(0, U64), np.zeros(0, np.int64))]
            for i in range(len(cuts) + 1):
                parts = [(k[b[i]:b[i + 1]], c[b[i]:b[i + 1]]) for (k, c), b in zip(self.pending, bounds, strict=True)]
                done += [C.sum_by(*(np.concatenate(x) for x in zip(*parts, strict=True)))] if parts else []
            self.pending = []
            self.pending = [tuple(np.concatenate(x) for x in zip(*done, strict=True))]
        self.size = len(self.pending[0][0])
        return self.pending[0]


class Placed:
    """Distinct keys, and where they stand: per piece its keys, their places, and the rows."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(keys)
        k = keys[order]
        head = _heads(k)
        at = np.empty(len(k), np.int32)
        at[order] = np.cumsum(head, dtype=np.int32) - 1
        own, n = np.unique_counts(rows)
        self.parts.append((k[head], at, own, n) if (rows[1:] >= rows[:-1]).all() else (k[head], at, rows, np.ones(1, np.int64)))

    def close(self) -> np.ndarray:
        keys = np.sort(np.concatenate([np.zeros(0, U64), *[p[0] for p in self.parts]]))
        self.keys = keys[_heads(keys)]
        return self.keys

    def sums(self, values: np.ndarray, n_rows: int) -> np.ndarray:
        """Per row, the sum of the values of its keys."""
        out = np.zeros(n_rows)
        for found, at, rows, n in self.parts:
            own = values[np.searchsorted(self.keys, found)]
            out += np.bincount(np.repeat(rows, n), weights=own[at], minlength=n_rows)
        return out


def dealt(keys: np.ndarray, kind: int, shards: int) -> Iterator[tuple[int, list[slice]]]:
    """Each cell and the slices of the sorted keys that go to it: all grams of two nearest context bytes to
    one, a range of words' hashes to one."""
    if kind == GRAMS:
        near = C.context_of(keys, C.SPLIT)
        heads = np.flatnonzero(_heads(near))
        cell = (V.mix(near[heads] + U64(1)) % U64(shards)).astype(np.int64)
    else:
        cell = ((keys >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)
        heads = np.flatnonzero(_heads(cell))
        cell = cell[heads]
    ends = np.append(heads[1:], len(keys))
    order = np.argsort(cell, kind="stable")
    groups = np.flatnonzero(_heads(cell[order]))
    for a, b in zip(groups, np.append(groups[1:], len(order)), strict=True):
        yield kind * shards + int(cell[order[a]]), [slice(int(heads[i]), int(ends[i])) for i in order[a:b]]


def _send(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    task, number = TaskContext.get().partitionId(), 0
    lists, texts, sizes, ids, marks, n_bytes = [Counted(), Counted()], [], [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal lists, texts, sizes, ids, marks, n_bytes, number
        name = f"{task}-{number}"
        raw = squeeze(np.concatenate(texts))
        texts, found = [], []
        found.append((name, TEXTS, raw, planes(np.concatenate(sizes)), np.concatenate(ids).tobytes(), np.concatenate(marks).tobytes()))
        for kind in (GRAMS, WORDS):
            keys, counts = lists[kind].merge()
            lists[kind] = Counted()
            found += [(name, cell, differences(np.concatenate([keys[x] for x in at])), planes(np.concatenate([counts[x] for x in at])), None, None)
                      for cell, at in dealt(keys, kind, shards)]
        sizes, ids, marks, n_bytes, number = [], [], [], 0, number + 1
        pa.default_memory_pool().release_unused()
        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4]
        yield from _table(found, list(zip(("chunk", "cell", "keys", "counts", "ids", "marks"), kinds, strict=True))).to_batches()

    for batch in batches:
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        no_id = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        own = batch.column("doc_id").fill_null(0).to_numpy()
        for lo, hi, data, offs in V.text_runs(batch.column("text"), RUN_BYTES):
            folded, trains = LOWER[data], ~held[lo:hi]
            for kind, keys, rows in keys_of(folded, offs):
                lists[kind].add(keys, trains[rows])
            texts.append(folded)
            sizes.append(np.diff(offs))
            ids.append(own[lo:hi])
            marks.append((held[lo:hi] * HELD + no_id[lo:hi] * NO_ID).astype(np.uint8))
            n_bytes += len(folded)
            if n_bytes >= CHUNK_BYTES:
                yield from flush()
    if marks:
        yield from flush()


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], schema=pa.schema(schema))


def _gather(table: pa.Table, shards: int) -> pa.Table:
    """One row per cell: the union of its lists, the lists as places in it (words': their counts), the report."""
    cell = table.column("cell")[0].as_py()
    lists = [from_differences(x.as_buffer()) for x in table.column("keys")]
    counts = [from_planes(x.as_buffer()).astype(np.int64) for x in table.column("counts")]
    keys, counts = C.sum_by(np.concatenate(lists), np.concatenate(counts))
    at = [np.searchsorted(keys, x) for x in lists]
    if cell >= shards:
        told = np.array([TOKENS, DISTINCT]), np.zeros(2, np.int64), np.array([counts.sum(), (counts > 0).sum()]), np.zeros(2)
        places, keys, counts = [planes(counts[x]) for x in at], keys[:0], counts[:0]
    else:
        byte_keys, n, nodes, sums = C.Tree(keys, counts).report()
        told = (np.repeat([BY_BYTE, BY_NODE], [len(byte_keys), len(nodes)]), np.concatenate([byte_keys, nodes]).astype(np.int64),
                np.append(n, np.zeros(len(nodes), np.int64)), np.append(np.zeros(len(byte_keys)), sums))
        places = [differences(x) for x in at]
    return pa.table({"cell": pa.array([cell], pa.int32()), "keys": [differences(keys)], "counts": [planes(counts)],
                     "chunks": [table.column("chunk").to_pylist()], "places": pa.array([places], pa.list_(pa.binary())),
                     **{f"told_{c}": [x.tobytes()] for c, x in zip(("what", "keys", "n", "s"), told, strict=True)}})


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        what, key, n, s = (np.concatenate([np.zeros(0, t), *[np.frombuffer(x.as_buffer(), t) for x in batch.column(c)]])
                           for c, t in (("told_what", np.int64), ("told_keys", np.int64), ("told_n", np.int64), ("told_s", float)))
        yield pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), pa.array(key), pa.array(n), pa.array(s)], names=["what", "key", "n", "s"])


def _answer(batches: Iterator[pa.RecordBatch], shards: int, upper: C.Upper) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["cell"] < shards:
                tree = C.Tree(from_differences(row["keys"]), from_planes(row["counts"]).astype(np.int64))
                found = tree.log_chances(upper).astype(np.float32)
                row["places"] = [found[from_differences(x)].tobytes() for x in row["places"]]
            yield pa.RecordBatch.from_arrays([pa.array(row["chunks"], pa.string()), pa.array([row["cell"]] * len(row["chunks"]), pa.int32()),
                                              pa.array(row["places"], pa.binary())], names=["chunk", "cell", "found"])


def _score(sent: pa.Table, answers: pa.Table, shards: int, tokens: int, distinct_tokens: int) -> pa.Table:
    pa.default_memory_pool().release_unused()
    row = sent.to_pylist()[0]
    sizes, marks = from_planes(row["counts"]).astype(np.int64), np.frombuffer(row["marks"], np.uint8)
    offs, n = np.concatenate([[0], np.cumsum(sizes)]), len(sizes)
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(unsqueeze(row["keys"]))])
    placed = [Placed(), Placed()]
    for lo, _, data, part in V.text_runs(texts, RUN_BYTES):
        for kind, keys, rows in keys_of(data, part):
            placed[kind].add(keys, rows + lo)
    found = dict(zip(answers.column("cell").to_pylist(), answers.column("found"), strict=True))

    def values(kind: int, read) -> np.ndarray:
        keys = placed[kind].close()
        out = np.zeros(len(keys))
        for cell, slices in dealt(keys, kind, shards):
            answer, at = read(found[cell].as_buffer()), 0
            for x in slices:
                out[x] = answer[at:at + x.stop - x.start]
                at += x.stop - x.start
        return out

    chance = values(GRAMS, lambda x: np.frombuffer(x, np.float32))
    score = placed[GRAMS].sums(chance, n)
    count, words = values(WORDS, from_planes), placed[WORDS]
    base = words.sums(np.log10((count + 0.1) / (tokens + 0.1 * (distinct_tokens + 1))), n)
    return pa.table({"doc_id": pa.array(np.frombuffer(row["ids"], np.int64), mask=marks & NO_ID > 0), "held_out": marks & HELD > 0,
                     "n_tokens": words.sums(np.ones(len(count)), n).astype(np.int64),
                     "n_known": words.sums((count > 0).astype(float), n).astype(np.int64), "train_tokens": np.full(n, tokens, np.int64),
                     "base_score": base, "score": score})


def held_out(doc_id: Column, folds: int) -> Column:
    """Rows whose crc32 of the id as text leaves no remainder, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def score_texts(docs: DataFrame, folds: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens (words and the end), n_known (of them, met in training), train_tokens,
    base_score (word model) and score (context-tree model), log10 of the text's chance."""
    src = pick(docs, doc_id=doc_id, text=text).withColumn("held_out", held_out(quoted("doc_id"), folds))
    src = src.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    shards = parts_for(text_bytes(src), CHUNK_BYTES, 12)
    sent = materialize(src.mapInArrow(lambda it: _send(it, shards), SENT), "model-lists")
    lists = sent.where(F.col("cell") != TEXTS).select("chunk", "cell", "keys", "counts")
    gathered = materialize(lists.groupBy("cell").applyInArrow(lambda t: _gather(t, shards), GATHERED), "model-cells")
    told = gathered.select("told_what", "told_keys", "told_n", "told_s").mapInArrow(_report, REPORTED).groupBy("what", "key").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # at most 2^16 + 256 x 255 + 2 rows
    upper = _upper([r for r in told if r["what"] in (BY_BYTE, BY_NODE)])
    tokens, kinds = (next((r["n"] for r in told if r["what"] == w), 0) for w in (TOKENS, DISTINCT))
    answers = gathered.select("cell", "keys", "counts", "chunks", "places").mapInArrow(lambda it: _answer(it, shards, upper), ANSWERED)
    texts = sent.where(F.col("cell") == TEXTS).select("chunk", "keys", "counts", "ids", "marks")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda d, a: _score(d, a, shards, tokens, kinds), SCORED)


def _upper(told: list) -> C.Upper:
    parts = [[r for r in told if r["what"] == w] for w in (BY_BYTE, BY_NODE)]
    keys, nodes = (np.array([r["key"] for r in p], np.int64) for p in parts)
    return C.Upper(keys, np.array([r["n"] for r in parts[0]], np.int64), nodes, np.array([r["s"] for r in parts[1]], float))
