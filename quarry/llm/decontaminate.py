"""Benchmark decontamination by latent semantic retrieval.

1. The benchmark's words span the term space; words that stand in more than a
   given share of all passages are left out, except that every item keeps its
   rarest ones.  Passages are overlapping windows of ``WINDOW`` words of the
   documents.  A first pass counts in how many passages each term stands, and
   in how many of them alone: places with a third of an item's other rare
   terms around them are left out, so an item that has leaked often doesn't
   make its own terms common.
2. A second pass keeps the places of terms (documents with fewer than
   ``LEAST_TERMS`` can hold no item).  The leading right singular vectors of
   the passages' TF-IDF matrix A (weights 1/sqrt(count)) come from a randomised SVD: Spark sums
   A'(A X) over the tasks, first for a random X, then for its orthonormal
   basis; only matrices of terms by rank reach the driver.
3. Candidate search: passages whose latent vector has a cosine of at least
   ``COSINE`` with an item's; terms weigh by the inverse frequency log(passages
   / count alone).
4. Candidates are decided on the text around the passage: the longest common
   subsequence of words must cover ``COVER`` of the item.  Cover of ``SURE``,
   or one run of ``COVER`` of the item and at least ``LEAST_RUN`` words word
   for word, decides by itself, wherever in the item it stands.  Weaker
   paraphrases must cover ``COVER`` of the item's answer, too, its last
   sentence.

Words are runs of letters and digits, A-Z folded.  An item longer than two
passages is searched for by parts of passage size, each with a vector of its
own, and decided as a whole.  Items are handled in blocks of at most
``ITEM_BLOCK`` items and ``BLOCK_WORDS`` words (an item longer than that has its
own), so what tasks receive is bounded whatever the benchmark's size.

Defined cases: null texts are empty; items of fewer words than ``LEAST_TERMS``
say nothing and match nothing; documents are told apart by id and text, so rows
without an id are searched as well, and repeated rows are reported once (rows
without an id that hold the same item: once, with the best measures); texts of
any length are searched whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textvec as V
from quarry.llm.base import pick, quoted
from quarry.session import materialize

STEP = 16
WINDOW = 3 * STEP
LEAST_TERMS = 3
COMMON_SHARE = 0.002
KEPT_RAREST = 6
KEPT_SHARE = (40, 100)
RANK = 192
OVERSAMPLING = 16
COSINE = 0.5
COVER = (60, 100)
SURE = (80, 100)
LEAST_RUN = 8
ITEM_BLOCK = 256
BLOCK_WORDS = 2 * WINDOW * ITEM_BLOCK
LINK_SHARE = 16
U64 = np.uint64

SEPARATORS = np.ones(256, bool)
SEPARATORS[0x30:0x3A] = SEPARATORS[0x41:0x5B] = SEPARATORS[0x61:0x7B] = SEPARATORS[0x80:] = False


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run, and the index of each row's first word."""
    starts, ends, bounds = V.word_spans(data, offs, SEPARATORS)
    if not len(starts):
        return np.zeros(0, U64), bounds
    return V.span_hashes(data, starts, ends, lower=True), bounds


def hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]


class Terms:
    """Sorted word hashes with their numbers; ``find`` gives the number of each word or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(keys & U64((1 << 18) - 1)).astype(np.int64)] = True

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words that are terms, and their numbers."""
        at = np.flatnonzero(self.maybe[(words & U64((1 << 18) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        t = np.minimum(np.searchsorted(self.keys, words[at]), len(self.keys) - 1)
        hit = self.keys[t] == words[at]
        return at[hit], t[hit]


def windows(row: np.ndarray, pos: np.ndarray, term: np.ndarray, least: int = 1) -> tuple[np.ndarray, ...]:
    """Deal term places to the passages that contain them: (row and step of every passage with at least
    ``least`` places, first entry of each passage, terms of all entries)."""
    step = pos // STEP
    parts = WINDOW // STEP
    keys, terms = [], []
    for back in range(parts):
        ok = step >= back
        keys.append(((row[ok].astype(np.int64) << 32) | (step[ok] - back)))
        terms.append(term[ok])
    key, t = np.concatenate(keys), np.concatenate(terms)
    order = np.argsort(key, kind="stable")
    key, t = key[order], t[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(key)))
    use = size >= least
    t = t[np.repeat(use, size)]
    size = size[use]
    return key[heads[use]] >> 32, key[heads[use]] & 0xFFFFFFFF, np.cumsum(size) - size, t


class Links:
    """The items that each term belongs to, for terms that stand in few items; ``least[i]`` of these terms
    together tell that item i is around."""

    def __init__(self, vocabulary: np.ndarray, hashed: list[np.ndarray]):
        own = [np.searchsorted(vocabulary, np.unique(h)) for h in hashed]
        term = np.concatenate(own)
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        few = np.bincount(term, minlength=len(vocabulary))[term] <= max(2, len(own) // LINK_SHARE)
        term, item = term[few], item[few]
        self.least = np.maximum(LEAST_TERMS, -(-np.bincount(item, minlength=len(own)) // 3))
        order = np.argsort(term, kind="stable")
        self.item = item[order]
        self.first = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))

    def explained(self, row: np.ndarray, pos: np.ndarray, term: np.ndarray) -> np.ndarray:
        """For every term place: do other terms of an item that it belongs to stand around it?"""
        out = np.zeros(len(term), bool)
        size = self.first[term + 1] - self.first[term]
        place = np.repeat(np.arange(len(term)), size)
        item = self.item[np.repeat(self.first[term] - np.cumsum(size) + size, size) + np.arange(len(place))]
        cell = row.astype(np.int64) << 32 | pos // WINDOW
        for back in (0, 1):  # every place lies in two cells of two windows each
            _, which = np.unique(cell - back, return_inverse=True)
            group = which[place] * len(self.least) + item
            key = V.distinct(group * len(self.first) + term[place]) // len(self.first)
            key, n = np.unique(key, return_counts=True)
            key = key[n >= self.least[key % len(self.least)]]
            if len(key):
                at = np.minimum(np.searchsorted(key, group), len(key) - 1)
                out[place[key[at] == group]] = True
        return out


def _passage_counts(row: np.ndarray, pos: np.ndarray, term: np.ndarray, n_terms: int) -> np.ndarray:
    """In how many passages each term stands: a place at one step is in the passages that begin there and up to
    two steps before, of which those of the place before it are known."""
    parts = WINDOW // STEP
    key = V.distinct((row.astype(np.int64) * n_terms + term) << 24 | pos // STEP)
    own, step = key >> 24, key & 0xFFFFFF
    again = np.concatenate([[False], own[1:] == own[:-1]])[:len(own)]
    new = np.minimum(parts, np.where(again, np.diff(step, prepend=0), step + 1))
    return np.bincount(own % n_terms, weights=new, minlength=n_terms).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch], terms: Terms, links: Links) -> Iterator[pa.RecordBatch]:
    """Passages of each term: all of them, and those where it stands without an item around it; the number of
    all passages at term -1."""
    counts, alone, n = np.zeros(len(terms.keys), np.int64), np.zeros(len(terms.keys), np.int64), 0
    for batch in batches:
        for _, _, data, offs in V.text_runs(batch.column("text")):
            words, bounds = word_hashes(data, offs)
            n += int((-(-np.diff(bounds) // STEP)).sum())
            at, t = terms.places(words)
            if not len(at):
                continue
            row = np.searchsorted(bounds, at, side="right") - 1
            pos = at - bounds[row]
            leak = links.explained(row, pos, t)
            mixed = np.bincount(row, leak, len(offs) - 1)[row] > 0
            plain = _passage_counts(row[~mixed], pos[~mixed], t[~mixed], len(counts))
            counts += plain + _passage_counts(row[mixed], pos[mixed], t[mixed], len(counts))
            mixed &= ~leak
            alone += plain + _passage_counts(row[mixed], pos[mixed], t[mixed], len(counts))
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"term": np.append(full, -1), "n": np.append(counts[full], n), "alone": np.append(alone[full], n)})


def choose_terms(alone: np.ndarray, n_passages: int, vocabulary: np.ndarray, hashed: list[np.ndarray]) -> np.ndarray:
    """Terms that are not common by themselves, and every item's rarest ones."""
    chosen = alone <= max(WINDOW // STEP, COMMON_SHARE * n_passages)
    for h in hashed:
        own = np.searchsorted(vocabulary, np.unique(h))
        kept = max(KEPT_RAREST, -(-len(own) * KEPT_SHARE[0] // KEPT_SHARE[1]))
        chosen[own[np.argsort(alone[own], kind="stable")[:kept]]] = True
    return chosen


def _place_batches(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("key")
        for lo, _, data, offs in V.text_runs(batch.column("text")):
            words, bounds = word_hashes(data, offs)
            at, t = terms.places(words)
            row = np.searchsorted(bounds, at, side="right") - 1
            enough = np.bincount(row, minlength=len(offs) - 1)[row] >= LEAST_TERMS
            at, t, row = at[enough], t[enough], row[enough]
            if not len(at):
                continue
            own, row_of = np.unique(row, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.take(pa.array(lo + own))], pa.list_(ids.type)),
                 *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (row_of, at - bounds[row], t)]],
                names=["ids", "row", "pos", "term"])


def _passages(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        row, pos, term = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("row", "pos", "term"))
        yield batch.column("ids")[i].values, *windows(row, pos, term, LEAST_TERMS)


def _latent(heads: np.ndarray, term: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Rows of A X: sums of the weighted rows of X over each passage's terms."""
    return np.add.reduceat(weighted[term], heads, axis=0)


def _gram_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's share of A'(A X), in blocks of rows."""
    weighted = (weights[:, None] * x).astype(np.float32)
    total = np.zeros(x.shape, np.float64)
    for batch in batches:
        for _, _, _, heads, term in _passages(batch):
            for lo in range(0, len(heads), 8192):
                h = heads[lo:lo + 8192]
                end = heads[lo + 8192] if lo + 8192 < len(heads) else len(term)
                t = term[h[0]:end]
                y = _latent(h - h[0], t, weighted)
                entry = np.repeat(np.arange(len(h)), np.diff(np.append(h, end)))
                order = np.argsort(t, kind="stable")
                st = t[order]
                first = np.flatnonzero(np.concatenate([[True], st[1:] != st[:-1]]))
                total[st[first]] += np.add.reduceat(y[entry[order]], first, axis=0)
    total *= weights[:, None]
    blocks = [(i, total[i:i + 512].astype(np.float32).tobytes()) for i in range(0, len(total), 512)]
    yield pa.RecordBatch.from_pydict({"block": [b for b, _ in blocks], "part": [p for _, p in blocks]})


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p.as_buffer(), np.float32).astype(np.float64) for p in table.column("part"))
    return pa.table({"block": [table.column("block")[0].as_py()], "part": [total.tobytes()]})


def _gram(places: DataFrame, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    # every task hands on a whole partial sum, so there are no more tasks than twice the cores
    few = places.coalesce(2 * max(4, places.sparkSession.sparkContext.defaultParallelism))
    parts = few.mapInArrow(partial(_gram_batches, weights=weights, x=x), "block bigint, part binary")
    rows = parts.groupBy("block").applyInArrow(_sum_blocks, "block bigint, part binary").collect()
    out = np.zeros(x.shape)
    for r in rows:
        part = np.frombuffer(r.part, np.float64).reshape(-1, x.shape[1])
        out[r.block:r.block + len(part)] = part
    return out


def right_singular_vectors(places: DataFrame, weights: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors of the passages' weighted term matrix, by a randomised SVD with one
    power iteration."""
    d = len(weights)
    width = min(d, rank + OVERSAMPLING)
    x = np.random.default_rng(seed).standard_normal((d, width))
    q, _ = np.linalg.qr(_gram(places, weights, x))
    z = _gram(places, weights, q)
    values, u = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-9]
    return q @ u[:, keep]


def _search_batches(batches: Iterator[pa.RecordBatch], weighted: np.ndarray, items: np.ndarray,
                    numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, row, step, heads, term in _passages(batch):
            for lo in range(0, len(heads), 8192):
                h = heads[lo:lo + 8192]
                end = heads[lo + 8192] if lo + 8192 < len(heads) else len(term)
                p = _latent(h - h[0], term[h[0]:end], weighted)
                p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
                cos = p @ items.T
                i, j = np.nonzero(cos >= COSINE)
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[lo + i])), pa.array(numbers[j]), pa.array(step[lo + i] * STEP),
                         pa.array(cos[i, j].astype(np.float64))], names=["key", "item", "at", "cosine"])


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    prev = np.zeros(len(b) + 1, np.int32)
    for x in a:
        now = prev.copy()
        now[1:] = np.maximum(now[1:], prev[:-1] + (b == x))
        prev = np.maximum.accumulate(now)
    return int(prev[-1])


def common_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of words that stands in both."""
    prev, best = np.zeros(len(b) + 1, np.int32), 0
    for x in a:
        now = np.zeros_like(prev)
        now[1:] = np.where(b == x, prev[:-1] + 1, 0)
        best, prev = max(best, int(now.max())), now
    return best


def covers(n: int, of: int, share: tuple[int, int]) -> bool:
    return n * share[1] >= of * share[0]


def sure(item: np.ndarray, near: np.ndarray, n: int) -> bool:
    """Is a common subsequence of n words a leak whether or not it holds the answer?"""
    if covers(n, len(item), SURE):
        return True
    run = common_run(item, near)
    return run >= LEAST_RUN and covers(run, len(item), COVER)


def answer_of(text: str) -> np.ndarray:
    """Words of the item's last sentence; of the whole item if it is one sentence."""
    pieces = [p for p in text.replace("!", ".").replace("?", ".").split(".") if len(hashes_of(p)) >= LEAST_TERMS]
    return hashes_of(pieces[-1]) if pieces else hashes_of(text)


def _decide_batches(batches: Iterator[pa.RecordBatch], items: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        found = batch.column("found")
        for _lo, hi, data, offs in V.text_runs(batch.column("text")):
            words, bounds = word_hashes(data, offs)
            for r in range(_lo, hi):
                own = words[bounds[r - _lo]:bounds[r - _lo + 1]]
                best: dict[int, tuple] = {}
                for c in found[r].as_py():
                    item, answer = items[c["item"]]
                    near = own[max(0, c["at"] - len(item)):c["at"] + WINDOW + len(item)]
                    n = lcs(item, near)
                    if not covers(n, len(item), COVER):
                        continue
                    m = lcs(answer, near)
                    if covers(m, len(answer), COVER) or sure(item, near, n):
                        best[c["item"]] = max(best.get(c["item"], (0,)), (n, m, c["cosine"], len(item), len(answer)))
                out += [(r, k, *v) for k, v in best.items()]
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(cols[0])), batch.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[5], pa.int64()), pa.array(cols[3], pa.int64()),
                 pa.array(cols[6], pa.int64()), pa.array(cols[4], pa.float64())],
                names=["key", "doc_id", "item", "common_words", "item_words", "answer_common", "answer_words", "cosine"])


def parts_of(words: np.ndarray) -> list[np.ndarray]:
    """An item's words as parts that a passage can hold; items of up to two passages stay whole."""
    return [words] if len(words) <= 2 * WINDOW else np.array_split(words, -(-len(words) // WINDOW))


RESULT = ("item bigint, common_words bigint, item_words bigint, answer_common bigint, answer_words bigint, cosine double")


def _block(docs: DataFrame, items: list[tuple[int, str]], kind: str) -> DataFrame:
    """Leaks of one block of items in docs (key, doc_id, text): key, doc_id, item (number) and the measures."""
    empty = docs.sparkSession.createDataFrame([], f"key bigint, doc_id {kind}, {RESULT}")
    hashed = {n: hashes_of(t) for n, t in items}
    hashed = {n: h for n, h in hashed.items() if len(h) >= LEAST_TERMS}
    if not hashed:
        return empty
    vocabulary = np.unique(np.concatenate(list(hashed.values())))
    own = list(hashed.values())
    rows = docs.select("text").mapInArrow(partial(_count_batches, terms=Terms(vocabulary), links=Links(vocabulary, own)),
                                          "term bigint, n bigint, alone bigint")
    counts, alone, n_passages = np.zeros(len(vocabulary)), np.zeros(len(vocabulary)), 0
    for r in rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone")).collect():
        if r.term < 0:
            n_passages = r.n
        else:
            counts[r.term], alone[r.term] = r.n, r.alone
    chosen = choose_terms(alone, n_passages, vocabulary, own)
    terms = Terms(vocabulary[chosen])
    weights = 1 / np.sqrt(np.maximum(counts[chosen], 1))
    rarity = np.log((n_passages + 2) / (alone[chosen] + 1))
    places = materialize(docs.select("key", "text").mapInArrow(partial(_place_batches, terms=terms),
                                         "ids array<bigint>, row array<int>, pos array<int>, term array<int>"), "term-places")
    if places.isEmpty():
        return empty
    vectors = right_singular_vectors(places, weights, min(RANK, len(weights)))
    weighted = (rarity[:, None] * vectors).astype(np.float32)
    parts = [(n, part) for n in sorted(hashed) for part in parts_of(hashed[n])]
    numbers = np.array([n for n, _ in parts], np.int64)
    latent = np.stack([weighted[terms.places(part)[1]].sum(axis=0) for _, part in parts])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    found = places.mapInArrow(partial(_search_batches, weighted=weighted, items=latent.astype(np.float32), numbers=numbers),
                              "key bigint, item bigint, at bigint, cosine double")
    found = found.groupBy("key").agg(F.collect_list(F.struct("item", "at", "cosine")).alias("found"))
    found = materialize(found, "leak-candidates")
    full = {n: (hashed[n], answer_of(t)) for n, t in items if n in hashed}
    return docs.join(found, "key").select("key", "doc_id", "text", "found").mapInArrow(
        partial(_decide_batches, items=full), f"key bigint, doc_id {kind}, {RESULT}")


def row_key(doc_id: str, text: str) -> Column:
    """Tells documents apart, also those without an id."""
    return F.xxhash64(quoted(doc_id), quoted(text))


def blocks_of(items: Iterator, id_and_text: Callable) -> Iterator[list[tuple]]:
    """Consecutive items, no more than ITEM_BLOCK and, unless one alone is longer, BLOCK_WORDS words."""
    block, size = [], 0
    for row in items:
        key, text = id_and_text(row)
        n = len(hashes_of(text))
        if block and (len(block) == ITEM_BLOCK or size + n > BLOCK_WORDS):
            yield block
            block, size = [], 0
        block.append((key, text))
        size += n
    if block:
        yield block


def _keyed_leaks(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """Leaks of docs (key, doc_id, text) with the item's own id; None if there are no items."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in blocks_of(items.orderBy("item_id", "text").toLocalIterator(), lambda r: (r.item_id, r.text)):
        found = _block(docs, [(i, t) for i, (_, t) in enumerate(block)], kind)
        names = docs.sparkSession.createDataFrame([(i, k) for i, (k, _) in enumerate(block)],
                                                  f"item bigint, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "item").drop("item")  # at most ITEM_BLOCK rows
        out = found if out is None else out.unionByName(found)
    return out


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return pick(benchmark, item_id=item_id, text=item_text).where("item_id is not null and text is not null").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, common_words (of the item, by
    longest common subsequence), item_words, answer_common, answer_words, cosine."""
    src = pick(docs, doc_id=doc_id, text=text).withColumn("key", row_key("doc_id", "text"))
    items = _items(benchmark, item_id, item_text)
    out = _keyed_leaks(src, items)
    if out is None:
        names = ", ".join(f"{c} bigint" for c in ("common_words", "item_words", "answer_common", "answer_words"))
        kinds = [d.schema[c].dataType.simpleString() for d, c in ((src, "doc_id"), (items, "item_id"))]
        return src.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, {names}, cosine double")
    best = F.max(F.struct("common_words", "answer_common", "cosine", "item_words", "answer_words")).alias("b")
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", *[f"b.{c}" for c in ("common_words", "item_words", "answer_common", "answer_words", "cosine")])


def clean_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item was found, with or without an id."""
    src = pick(docs, doc_id=doc_id, text=text).withColumn("key", row_key("doc_id", "text"))
    found = _keyed_leaks(src, _items(benchmark, "item_id", "text"))
    if found is None:
        return docs
    rows = docs.select(row_key(doc_id, text).alias("key"), F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    return rows.join(found.select("key").distinct(), "key", "left_anti").select("row.*")
