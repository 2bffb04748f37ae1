"""Byte-level BPE by a rank map: encoding and decoding.

A text is cut by the tokenizer's pattern into words.  Within a word's bytes,
the adjacent pair whose joined bytes have the lowest rank is merged, leftmost
first, until no pair has a rank.  The fold runs on distinct words only.

Two forms of the fold give the same ids:

* ``encode_words``: Spark higher-order functions fold the merges over byte
  arrays of a column of distinct words, with a literal rank map.
* ``RankFold``: the same fold over the distinct words of a run of documents at
  once, inside Arrow batches.  ``encode_documents`` uses it, because bringing
  the ids of a corpus-wide table of distinct words back to its documents
  would shuffle every text and every distinct word of every partition (README
  has the figures).

Decoding concatenates the binary pieces of the ids.

Defined cases: null texts are empty; repeated rows are encoded each; extra
columns are ignored; words longer than ``LONG`` bytes take a heap instead of
the array fold, with the same order of merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textvec as V
from quarry.llm.base import pick, quoted
from quarry.llm.pieces import PieceEncoder, gather
from quarry.llm.tokenizers_io import read_ranks

LONG = 256
NONE = np.int64(1 << 40)
BUCKETS = 8192


# --------------------------------------------------------------- higher-order functions
def rank_buckets(ranks: dict[bytes, int], buckets: int = BUCKETS) -> str:
    """The rank map as JSON for a literal: tokens (hex) dealt to small maps by crc32, because a lookup
    in one large map would scan it."""
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        maps[zlib.crc32(key.encode()) % buckets][key] = rank
    return json.dumps(maps)


def fold_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """array<int> of ids of a word (string column), by folding ranked merges over its bytes."""
    table = F.from_json(F.lit(rank_buckets(ranks)), "array<map<string,int>>")

    def rank(part: Column) -> Column:
        at = F.pmod(F.crc32(part.cast("binary")), F.lit(BUCKETS)).cast("int")
        return F.try_element_at(F.get(table, at), part)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def merged(parts: Column, found: Column) -> Column:
        at = F.array_position(found, F.array_min(found)).cast("int")
        pair = F.concat(F.get(parts, at - 1), F.get(parts, at))
        return F.when(F.array_min(found).isNull(), parts).otherwise(
            F.concat(F.slice(parts, F.lit(1), at - 1), F.array(pair), F.slice(parts, at + 2, F.size(parts))))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                            lambda i: rank(F.concat(F.get(parts, i - 1), F.get(parts, i))))
        return F.when(F.size(parts) < 2, parts).otherwise(let(pairs, lambda found: merged(parts, found)))

    octets = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit("(..)"), F.lit(1))
    rounds = F.when(F.size(octets) > 1, F.sequence(F.lit(1), F.size(octets) - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(F.aggregate(rounds, octets, step), rank)


def encode_words(words: DataFrame, ranks_path: str, word: str = "word") -> DataFrame:
    """Distinct non-null words with their ids: word, ids."""
    return words.select(quoted(word).alias("word")).where("word is not null").distinct().withColumn(
        "ids", fold_words(F.col("word"), read_ranks(ranks_path)))


# --------------------------------------------------------------------- inside batches
class RankFold:
    """The fold over many words at once; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:i]] << 20 | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], NONE)

    def fold(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._fold_long(w)
        if short:
            t = self.byte_ids[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
            w = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
            done_t, done_w = [], []
            r = np.full(len(t), NONE)
            r[:-1] = np.where(w[:-1] == w[1:], self._ranks(t[:-1], t[1:]), NONE)
            while len(t):
                head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                size = np.diff(np.append(head, len(t)))
                least = np.minimum.reduceat(r, head)
                live = np.repeat(least < NONE, size)
                done_t.append(t[~live])
                done_w.append(w[~live])
                best = np.flatnonzero(live & (r == np.repeat(least, size)))
                at = best[np.concatenate([[True], w[best[1:]] != w[best[:-1]]])] if len(best) else best
                t[at] = r[at]
                live[at + 1] = False
                at = at - np.cumsum(~live)[at]
                t, w, r = t[live], w[live], r[live]
                for p in (at - 1, at):
                    p = p[p >= 0]
                    nxt = np.minimum(p + 1, len(t) - 1)
                    r[p] = np.where((p + 1 < len(t)) & (w[p] == w[nxt]), self._ranks(t[p], t[nxt]), NONE)
            t, w = np.concatenate(done_t), np.concatenate(done_w)
            order = np.argsort(w, kind="stable")
            cuts = np.searchsorted(w[order], np.arange(len(short) + 1))
            t = t[order]
            for j, i in enumerate(short):
                out[i] = t[cuts[j]:cuts[j + 1]]
        return out

    def _fold_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[k], i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (k := ids[i] << 20 | ids[i + 1]) in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (k := ids[x] << 20 | ids[y]) in self.pairs:
                    heapq.heappush(heap, (self.pairs[k], x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int64)


class RankCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        ranks = read_ranks(ranks_path)
        self.find = regex.compile(pattern).findall
        self.fold = RankFold(ranks)
        top = max(ranks.values()) + 1
        pieces = [b""] * top
        for token, i in ranks.items():
            pieces[i] = token
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_pool = np.frombuffer(b"".join(pieces), np.uint8)
        decimals = [b"%d " % i for i in range(top)]
        self.dec_size = np.array([len(d) for d in decimals], np.int64)
        self.dec_start = np.cumsum(self.dec_size) - self.dec_size
        self.dec_pool = np.frombuffer(b"".join(decimals), np.uint8)
        self.encoder = PieceEncoder(self._encode_texts, self.piece_size)

    def _encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        words = [[w.encode() for w in self.find(t)] for t in texts]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        folded = self.fold.fold(list(distinct))
        return [np.concatenate([folded[distinct[w]] for w in ws]) if ws else np.zeros(0, np.int64) for ws in words]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the index of each id's first byte (one more entry than ids)."""
        sizes = self.piece_size[ids]
        return gather(self.piece_pool, self.piece_start[ids], sizes), np.concatenate([[0], np.cumsum(sizes)])

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal text of all ids, each followed by a space, and the index of each id's first character."""
        sizes = self.dec_size[ids]
        return gather(self.dec_pool, self.dec_start[ids], sizes), np.concatenate([[0], np.cumsum(sizes)])


_codecs: dict = {}


def codec(ranks_path: str, pattern: str) -> RankCodec:
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = RankCodec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


def _ids_batches(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = codec(ranks_path, pattern).encoder
    for batch in batches:
        for lo, hi, data, offs in V.text_runs(batch.column("text")):
            ids, bounds = enc.encode(data, offs)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], names=["doc_id", "ids"])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""
    src = pick(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_ids_batches, ranks_path=ranks_path, pattern=pattern),
                          f"doc_id {kind}, ids array<int>")


def _decoded_batches(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(ranks_path, pattern)
    for batch in batches:
        ids = batch.column("ids")
        bounds = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False)
        sizes = np.concatenate([[0], np.cumsum(c.piece_size[flat])])
        for lo, hi, *_ in V.text_runs(pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(ids), [None, pa.py_buffer(sizes[bounds].astype(np.int64)),
                                              pa.py_buffer(bytes(int(sizes[-1])))])):
            raw, at = c.decode(flat[bounds[lo]:bounds[hi]])
            cuts = at[bounds[lo:hi + 1] - bounds[lo]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo),
                 pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cuts.astype(np.int32)),
                                                                    pa.py_buffer(raw.tobytes())])],
                names=["doc_id", "decoded"])


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) from doc_id, ids (null ids: empty)."""
    src = pick(encoded, doc_id="doc_id", ids="ids").withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<int>")))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_decoded_batches, ranks_path=ranks_path, pattern=pattern),
                          f"doc_id {kind}, decoded binary")


def _digest_batches(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    c = codec(ranks_path, pattern)

    def sha(raw: memoryview, a: int, b: int) -> str:
        return hashlib.sha256(raw[a:b]).hexdigest()

    for batch in batches:
        for lo, hi, data, offs in V.text_runs(batch.column("text")):
            ids, bounds = c.encoder.encode(data, offs)
            dec, dec_at = c.decimals(ids)
            raw, raw_at = c.decode(ids)
            dec, raw = memoryview(dec.tobytes()), memoryview(raw.tobytes())
            d, r = dec_at[bounds].tolist(), raw_at[bounds].tolist()
            n = hi - lo
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, n), pa.array(np.diff(bounds)),
                 pa.array([sha(dec, d[i], max(d[i], d[i + 1] - 1)) for i in range(n)]),
                 pa.array([sha(raw, r[i], r[i + 1]) for i in range(n)])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, sha256 of the decimal ids joined by spaces, sha256
    of the decoded bytes."""
    src = pick(docs, doc_id=doc_id, text=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(partial(_digest_batches, ranks_path=ranks_path, pattern=pattern),
                          f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
