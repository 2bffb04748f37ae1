"""Removal of long byte strings that also start in an earlier document.

A sparse enhanced suffix array over anchors, dealt to tasks by anchor:

0. Whole copies.  A document whose whole text an earlier one has is found by a
   hash of the text (128 bits and the length); it takes no part in the rest.
1. Anchors.  Every window of ``LENGTH`` bytes holds the leftmost least hash of
   its ``GRAM``-byte strings at a place that depends on its bytes only, so
   equal windows have an anchor at the same place.  Chunks of documents send
   their distinct anchor hashes (48 bits, to preselect) to buckets, which answer with those that
   several documents have.
2. Contexts.  For these anchors a chunk sends each distinct context (the bytes
   around the anchor that any window over it can reach) once, with the
   smallest and largest document it occurs in.
3. Intervals.  A bucket sorts the contexts as suffixes at their anchors, takes
   the longest-common-prefix array and stack-scans it into the tree of LCP
   intervals.  An interval's members share a right side; grouping them by
   their left side, one byte more at a time, tests left-extension diversity:
   while a longer left side keeps the same members the repeat grows, where
   they part a maximal repeat ends.  The answer to a context is a list of
   (shortest left reach, longest left reach, first document) for the maximal
   repeat groups it belongs to, whatever the number of members.
4. Each chunk removes from its documents what the answers cover.

Anchors that more than ``HOT`` chunks share have their windows compared one by
one instead, each dealt by its own hash, so a passage that stands in a third
of all documents is spread over all tasks.  Bytes are compared by 64-bit
hashes together with the anchor's own hash.

Defined cases: null texts are empty; rows without an id are left whole and
count as no earlier document; rows with the same id are one document as far
as "earlier" goes; extra columns are ignored.  Document ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textvec as V
from quarry.llm.base import parts_for, pick, text_bytes
from quarry.session import materialize

LENGTH = 50
GRAM = 25
REACH = LENGTH - GRAM
CHUNK_BYTES = 4 << 20
LEAST_CHUNKS = 24
HOT = 48
U64 = np.uint64


def anchors(spans: V.SpanHasher, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and rows of the anchors of all windows within rows."""
    n = len(spans.total) - GRAM
    w = LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none.astype(U64), none
    h = V.mix((spans.total[GRAM:] - spans.total[:-GRAM]) * spans.down[:n])
    least = (h & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    size = 1
    while size < w:
        step = min(size, w - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    row_end = np.repeat(offs[1:], np.diff(offs))[:len(least)]
    at = (least[np.arange(len(least)) + LENGTH <= row_end] & U64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none, none.astype(U64), none
    at = V.distinct(at[np.concatenate([[True], at[1:] != at[:-1]])])
    return at, h[at], np.searchsorted(offs, at, side="right") - 1


class Chunk:
    """A chunk's rows, a run at a time.  ``extra`` may name rows that are whole copies, by id and text hash."""

    def __init__(self, table: pa.Table, extra: pa.Table):
        self.table = table
        ids, ths = ([np.asarray(x, np.int64) for x in extra.column(n).to_pylist() if x is not None] for n in ("ids", "ths"))
        none = [np.zeros(0, np.int64)]
        self.copies = np.sort(self._key(np.concatenate(none + ids), np.concatenate(none + ths)))

    @staticmethod
    def _key(ids: np.ndarray, ths: np.ndarray) -> np.ndarray:
        return V.mix(ids.view(U64)) + ths.view(U64)

    def runs(self) -> Iterator[tuple]:
        """lo, hi, bytes, offsets, ids, takes part, is a whole copy."""
        if not self.table.num_rows:
            return
        table = self.table.combine_chunks()
        ids = table.column("doc_id").chunk(0)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        named = ~ids.is_null().to_numpy(zero_copy_only=False)
        copy = np.zeros(len(values), bool)
        if len(self.copies):
            key = self._key(values, table.column("th").to_numpy())
            at = np.minimum(np.searchsorted(self.copies, key), len(self.copies) - 1)
            copy = named & (self.copies[at] == key)
        for lo, hi, data, offs in V.text_runs(table.column("text")):
            yield lo, hi, data, offs, values[lo:hi], (named & ~copy)[lo:hi], copy[lo:hi]


def pack48(h: np.ndarray) -> bytes:
    """The upper 48 bits of every hash."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack48(raw) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.reshape(-1).view("<u8").astype(U64)


UPPER = U64(0xFFFFFFFFFFFF0000)


def reaches(at: np.ndarray, row: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the row left of the anchor and from it on, as far as windows reach."""
    return np.minimum(at - offs[row], REACH), np.minimum(offs[row + 1] - at, LENGTH)


def context_keys(spans: V.SpanHasher, at: np.ndarray, gap: int, h: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of the bytes left of the anchor and behind its gram; ``gap`` is the distance from the anchor to
    the latter (0 where the gram's bytes are left out)."""
    sides = spans(at - left, at) + spans(at + gap, at + gap + right - GRAM) * U64(0x9FB21C651E98DF25)
    return V.mix(sides ^ V.mix(h) ^ (left * 64 + right).astype(U64))


def window_keys(spans: V.SpanHasher, start: np.ndarray, h: np.ndarray, reach: int) -> np.ndarray:
    return V.mix(spans(start, start + LENGTH) ^ V.mix(h + U64(reach + 1)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and one past the last place of every stretch of equal values."""
    if len(values):
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
        yield from zip(heads, [*heads[1:], len(values)], strict=True)


def dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of ascending keys that belong to one bucket."""
    own = bucket_of(keys, buckets)
    for a, b in stretches(own):
        yield int(own[a]), slice(a, b)


def distinct_with_docs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, the index of one holder, the smallest and the largest document."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if not len(heads):
        return k, heads, d, d
    return k[heads], order[heads], np.minimum.reduceat(d, heads), np.maximum.reduceat(d, heads)


def _table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema)


ANCHORS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("shared", pa.binary())])
COMMON = pa.schema([("chunk", pa.int32()), ("hashes", pa.binary()), ("hot", pa.binary())])
CONTEXTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("body", pa.binary()), ("reach", pa.binary()), ("first", pa.binary()),
                      ("several", pa.binary())])
ANSWERS = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("runs", pa.binary()), ("first", pa.binary()), ("hot", pa.binary())])
#: What a chunk sends: contexts, windows of hot anchors, and the hot anchors themselves, which come back as they are.
IN_CONTEXT, IN_WINDOW, HOT_ANCHORS = range(3)
SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
#: A context's bytes: those before the anchor, then those behind its gram.
SIDES = np.concatenate([np.arange(REACH), np.arange(REACH + GRAM, REACH + LENGTH)])
RUN = np.dtype([("lo", "u1"), ("hi", "u1")])


def _send_anchors(table: pa.Table, extra: pa.Table, buckets: int) -> pa.Table:
    if not table.num_rows:
        return ANCHORS.empty_table()
    hashes, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _, _, data, offs, ids, part, _ in Chunk(table, extra).runs():
        spans = V.SpanHasher(data)
        at, h, row = anchors(spans, offs)
        keep = part[row]
        k, _, lo, hi = distinct_with_docs(h[keep] & UPPER, ids[row[keep]])
        hashes += [k, k[lo != hi]]
        docs += [lo, hi[lo != hi]]
    k, _, lo, hi = distinct_with_docs(np.concatenate(hashes), np.concatenate(docs))
    chunk = table.column("chunk")[0].as_py()
    rows = [(b, chunk, pack48(k[s]), np.packbits((lo != hi)[s]).tobytes()) for b, s in dealt(k, buckets)]
    return _table(dict(zip(ANCHORS.names, zip(*rows), strict=True)) if rows else {n: [] for n in ANCHORS.names}, ANCHORS)


def _common_anchors(table: pa.Table) -> pa.Table:
    parts = [unpack48(x.as_buffer()) for x in table.column("hashes")]
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(p) for p in parts])
    h = np.concatenate(parts)
    shared = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)).astype(bool)
                             for x, p in zip(table.column("shared"), parts, strict=True)])
    order = np.argsort(h, kind="stable")
    h, chunk, shared = h[order], chunk[order], shared[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(heads, len(h)))
    several = np.repeat((size > 1) | np.logical_or.reduceat(shared, heads), size)
    hot = np.repeat(size > HOT, size)
    h, chunk, hot = h[several], chunk[several], hot[several]
    order = np.argsort(chunk, kind="stable")
    h, chunk, hot = h[order], chunk[order], hot[order]
    rows = [(int(chunk[a]), pack48(h[a:b]), np.packbits(hot[a:b]).tobytes()) for a, b in stretches(chunk)]
    return _table(dict(zip(COMMON.names, zip(*rows), strict=True)) if rows else {n: [] for n in COMMON.names}, COMMON)


def _send_contexts(docs: pa.Table, common: pa.Table, buckets: int) -> pa.Table:
    out: list[tuple] = []
    known = [unpack48(x.as_buffer()) for x in common.column("hashes") if x.is_valid]
    if not docs.num_rows or not known:
        return CONTEXTS.empty_table()
    chunk = docs.column("chunk")[0].as_py()
    hot = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)) for x in common.column("hot") if x.is_valid]
    hot = np.concatenate([x[:len(k)] for x, k in zip(hot, known, strict=True)]).astype(bool)
    known = np.concatenate(known)
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    ctx: list[list[np.ndarray]] = []
    win: list[list[np.ndarray]] = []
    for _, _, data, offs, ids, part, _ in Chunk(docs, common).runs():
        spans = V.SpanHasher(data)
        at, h, row = anchors(spans, offs)
        where = np.minimum(np.searchsorted(known, h & UPPER), len(known) - 1)
        keep = part[row] & (known[where] == h & UPPER)
        at, h, row, is_hot = at[keep], h[keep], row[keep], hot[where[keep]]
        left, right = reaches(at, row, offs)
        doc = ids[row]
        for reach in range(REACH + 1) if is_hot.any() else ():
            ok = is_hot & (left >= reach) & (right >= LENGTH - reach)
            k, _, lo, hi = distinct_with_docs(window_keys(spans, at[ok] - reach, h[ok], reach), doc[ok])
            win.append([k, lo, hi])
        cool = ~is_hot
        at, h, left, right, doc = at[cool], h[cool], left[cool], right[cool], doc[cool]
        k, i, lo, hi = distinct_with_docs(context_keys(spans, at, GRAM, h, left, right), doc)
        at, h, left, right = at[i], h[i], left[i], right[i]
        padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        body = padded[at[:, None] + SIDES]
        ctx.append([k, h, body, np.stack([left, right], axis=1).astype(np.uint8), lo, hi])
    if win:
        out.append((chunk % buckets, chunk, HOT_ANCHORS, pack48(known[hot]), b"", b"", b"", b""))
    for kind, parts in ((IN_CONTEXT, ctx), (IN_WINDOW, win)):
        if not parts:
            continue
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        k, i, lo, _ = distinct_with_docs(cols[0], cols[-2])
        _, _, _, hi = distinct_with_docs(cols[0], cols[-1])
        several = lo < hi
        if kind == IN_WINDOW:
            out += [(b, chunk, IN_WINDOW, k[s].tobytes(), b"", b"", lo[s].tobytes(), np.packbits(several[s]).tobytes())
                    for b, s in dealt(k, buckets)]
            continue
        h, body, reach = cols[1][i], cols[2][i], cols[3][i]
        order = np.argsort(h, kind="stable")
        h, body, reach, lo, several = (x[order] for x in (h, body, reach, lo, several))
        out += [(b, chunk, IN_CONTEXT, h[s].tobytes(), body[s].tobytes(), reach[s].tobytes(), lo[s].tobytes(),
                 np.packbits(several[s]).tobytes()) for b, s in dealt(h, buckets)]
    return _table(dict(zip(CONTEXTS.names, zip(*out), strict=True)) if out else {n: [] for n in CONTEXTS.names}, CONTEXTS)


def lcp_intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """Stack scan of an LCP array (lcp[i]: common prefix of suffixes i - 1 and i): rows (depth, depth of the
    parent or ``least`` - 1, first suffix, one past the last) of the intervals of depth at least ``least``."""
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (depth, first suffix), depths ascending
    floor = least - 1
    for i, depth in enumerate([*lcp[1:].tolist(), 0], 1):
        first = i - 1
        if depth < least:
            depth = floor
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, max(depth, stack[-1][0] if stack else floor), first, i))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return np.array(out, np.int64).reshape(-1, 4)


def suffix_order(h: np.ndarray, body: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (from their anchors on, ``right`` bytes each) in order, and the LCP array; suffixes of
    one anchor share its gram, suffixes of different anchors nothing."""
    n = len(h)
    tail = LENGTH - GRAM
    text = np.zeros((n, -(-tail // 8) * 8), np.uint8)
    text[:, :tail] = body[:, REACH:]
    text[:, :tail][np.arange(tail) >= right[:, None] - GRAM] = 0
    words = text.view(">u8").astype(U64)
    order = np.lexsort([right, *[words[:, j] for j in range(words.shape[1] - 1, -1, -1)], h])
    t, r = text[order, :tail], right[order]
    lcp = np.zeros(n, np.int64)
    differ = t[1:] != t[:-1]
    same = GRAM + np.where(differ.any(axis=1), differ.argmax(axis=1), tail)
    lcp[1:] = np.minimum(np.minimum(same, r[1:]), r[:-1])
    lcp[1:][h[order][1:] != h[order][:-1]] = 0
    return order, lcp


def repeat_groups(h: np.ndarray, body: np.ndarray, reach: np.ndarray, first: np.ndarray,
                  last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeat groups of the contexts: (context, shortest left reach, longest left reach, first
    document) for every context and every group it belongs to whose documents are not all one."""
    left, right = reach[:, 0].astype(np.int64), reach[:, 1].astype(np.int64)
    order, lcp = suffix_order(h, body, right)
    alone = last > first  # a context may repeat within its chunk only
    tree = lcp_intervals(lcp, GRAM)
    # a context by itself is an interval down to its own right side
    depth_of = np.maximum(lcp, np.append(lcp[1:], 0))
    own = np.flatnonzero((right[order] > depth_of) & alone[order])
    tree = np.concatenate([tree, np.stack([right[order][own], np.maximum(depth_of[own], GRAM - 1), own, own + 1],
                                          axis=1).reshape(-1, 4)])
    found: list[tuple[np.ndarray, ...]] = []
    mark = V.mix(np.arange(len(h), dtype=U64) + U64(77))
    left_hash = np.zeros(len(h), U64)
    prev: tuple | None = None
    open_lo = np.zeros(len(h), np.int64)
    open_first = np.zeros(len(h), np.int64)
    open_set = np.zeros(len(h), U64)
    is_open = np.zeros(len(h), bool)

    def close(which: np.ndarray, hi: int) -> None:
        i = np.flatnonzero(which)
        if len(i):
            found.append((i, open_lo[i].copy(), np.full(len(i), hi), open_first[i].copy()))
        is_open[i] = False

    for o in range(REACH + 1):
        if o:
            left_hash = V.mix(left_hash * U64(257) + body[:, REACH - o] + U64(1))
        level = LENGTH - o
        alive = np.flatnonzero((tree[:, 0] >= level) & (tree[:, 1] < level))
        size = tree[alive, 3] - tree[alive, 2]
        ends = np.cumsum(size)
        place = np.repeat(tree[alive, 2] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        members = order[place]
        interval = np.repeat(np.arange(len(alive)), size)
        ok = left[members] >= o
        members, interval = members[ok], interval[ok]
        now = np.zeros(len(h), bool)
        if len(members):
            key = V.mix(left_hash[members] * U64(0x9FB21C651E98DF25) + V.mix(interval.astype(U64) + U64(1 << 32)))
            sort = np.argsort(key, kind="stable")
            m, k = members[sort], key[sort]
            heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            n = np.diff(np.append(heads, len(k)))
            lo = np.repeat(np.minimum.reduceat(first[m], heads), n)
            hi = np.repeat(np.maximum.reduceat(last[m], heads), n)
            group = np.repeat(np.add.reduceat(mark[m], heads), n)
            use = lo < hi
            m, lo, group = m[use], lo[use], group[use]
            now[m] = True
            fresh = np.zeros(len(h), bool)
            fresh[m] = ~is_open[m] | (open_set[m] != group)
            close(is_open & (fresh | ~now), o - 1)
            f = fresh[m]
            open_lo[m[f]], open_first[m[f]], open_set[m[f]] = o, lo[f], group[f]
            is_open[m] = True
        else:
            close(is_open, o - 1)
    close(is_open, REACH)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _answer(table: pa.Table) -> pa.Table:
    rows: list[tuple] = []
    kinds = table.column("kind").to_numpy()
    for kind in (IN_CONTEXT, IN_WINDOW, HOT_ANCHORS):
        part = table.filter(pa.array(kinds == kind))
        if not part.num_rows:
            continue
        if kind == HOT_ANCHORS:
            rows += [(c, b"", b"", b"", h) for c, h in zip(part.column("chunk").to_pylist(), part.column("hashes").to_pylist(), strict=True)]
            continue
        cells = [np.frombuffer(x.as_buffer(), U64) for x in part.column("hashes")]
        chunk = np.repeat(part.column("chunk").to_numpy(), [len(x) for x in cells])
        own = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in part.column("first")])
        last = own + np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(c))
                                     for x, c in zip(part.column("several"), cells, strict=True)])
        keys = np.concatenate(cells)
        if kind == IN_CONTEXT:
            h = keys
            body = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column("body")])
            reach = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column("reach")]).reshape(-1, 2)
            left, right = reach[:, 0].astype(np.int64), reach[:, 1].astype(np.int64)
            keys = np.concatenate([context_keys(V.SpanHasher(body[a * len(SIDES):b * len(SIDES)]), np.arange(b - a) * len(SIDES) + REACH, 0,
                                                h[a:b], left[a:b], right[a:b])
                                   for a, b in ((a, min(a + 20_000, len(h))) for a in range(0, len(h), 20_000))])
            i, lo, hi, first = repeat_groups(h, body.reshape(-1, len(SIDES)), reach, own, last)
        else:
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            first = np.empty(len(keys), np.int64)
            first[order] = np.repeat(np.minimum.reduceat(own[order], heads), np.diff(np.append(heads, len(k))))
            i = np.arange(len(keys))
            lo = hi = np.full(len(keys), 255)
        use = first < last[i]
        i, lo, hi, first = i[use], lo[use], hi[use], first[use]
        order = np.argsort(chunk[i], kind="stable")
        i, lo, hi, first = i[order], lo[order], hi[order], first[order]
        own = chunk[i]
        for a, b in stretches(own):
            runs = np.empty(b - a, RUN)
            runs["lo"], runs["hi"] = lo[a:b], hi[a:b]
            rows.append((int(own[a]), keys[i[a:b]].tobytes(), runs.tobytes(), first[a:b].astype(np.int64).tobytes(), b""))
    return _table(dict(zip(ANSWERS.names, zip(*rows), strict=True)) if rows else {n: [] for n in ANSWERS.names}, ANSWERS)


def _matches(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index in keys, index in the sorted known keys) of equal keys."""
    a, b = np.searchsorted(known, keys, side="left"), np.searchsorted(known, keys, side="right")
    n = b - a
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(keys)), n), np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
    keys, runs, first = (np.concatenate([np.zeros(0, t), *[np.frombuffer(x.as_buffer(), t) for x in answers.column(n) if x.is_valid]])
                         for n, t in (("keys", U64), ("runs", RUN), ("first", np.int64)))
    order = np.argsort(keys, kind="stable")
    keys, runs, first = keys[order], runs[order], first[order]
    whole = np.flatnonzero(runs["lo"] < 255)
    single = np.flatnonzero(runs["lo"] == 255)
    hot = np.sort(np.concatenate([np.zeros(0, U64), *[unpack48(x.as_buffer()) for x in answers.column("hot") if x.is_valid]]))
    tables = []
    ids_of = docs.combine_chunks().column("doc_id").chunk(0) if docs.num_rows else pa.array([], pa.int64())
    for lo, hi, data, offs, ids, part, copy in Chunk(docs, answers).runs():
        edge = np.zeros(len(data) + 1, np.int64)
        if len(keys):
            spans = V.SpanHasher(data)
            at, h, row = anchors(spans, offs)
            keep = part[row]
            at, h, row = at[keep], h[keep], row[keep]
            left, right = reaches(at, row, offs)
            if len(whole):
                i, j = _matches(context_keys(spans, at, GRAM, h, left, right), keys[whole])
                j = whole[j]
                late = ids[row[i]] > first[j]
                i, j = i[late], j[late]
                np.add.at(edge, at[i] - runs["hi"][j], 1)
                np.add.at(edge, at[i] - runs["lo"][j] + LENGTH, -1)
            # only hot anchors have windows
            near = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h & UPPER), len(hot) - 1)] == h & UPPER) if len(hot) and len(single) else single[:0]
            for reach in range(REACH + 1) if len(near) else ():
                ok = near[(left[near] >= reach) & (right[near] >= LENGTH - reach)]
                i, j = _matches(window_keys(spans, at[ok] - reach, h[ok], reach), keys[single])
                i, j = ok[i], single[j]
                i = i[ids[row[i]] > first[j]]
                np.add.at(edge, at[i] - reach, 1)
                np.add.at(edge, at[i] - reach + LENGTH, -1)
        gone = (np.cumsum(edge)[:-1] > 0) | np.repeat(copy, np.diff(offs))
        starts_flag, ends_flag = gone.copy(), gone.copy()
        starts_flag[1:] &= ~gone[:-1]
        ends_flag[:-1] &= ~gone[1:]
        full = offs[:-1] < offs[1:]
        starts_flag[offs[:-1][full]] = gone[offs[:-1][full]]
        ends_flag[offs[1:][full] - 1] = gone[offs[1:][full] - 1]
        a, b = np.flatnonzero(starts_flag), np.flatnonzero(ends_flag) + 1
        bounds = np.searchsorted(a, offs)
        base = np.repeat(offs[:-1], np.diff(bounds))
        spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(a - base), pa.array(b - base)], names=["start", "end"]))
        kept = np.concatenate([[0], np.cumsum(~gone)])[offs]
        body = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(kept.astype(np.int32)),
                                                                  pa.py_buffer(data[~gone].tobytes())])
        tables.append(pa.table([ids_of.slice(lo, hi - lo), pa.array(np.diff(offs)),
                                spans, body], schema=SPANS))
    return pa.concat_tables(tables) if tables else SPANS.empty_table()


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<struct<start: bigint, end: bigint>>')}" for f in schema)


def _whole_copies(rows: DataFrame) -> DataFrame:
    """chunk, ids, ths: per chunk, the rows whose whole text (of at least ``LENGTH`` bytes) an earlier
    document has.  Only hashes travel; a text's copies are combined map-side."""
    light = rows.select("chunk", "doc_id", "th", F.xxhash64(F.lit("second"), "text").alias("t2"), F.octet_length("text").alias("n"))
    light = light.where((F.col("n") >= LENGTH) & F.col("doc_id").isNotNull())
    texts = light.groupBy("th", "t2", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = light.join(texts, ["th", "t2", "n"]).where("doc_id > first")
    found = materialize(later.select("chunk", "doc_id", "th"), "whole-copies")
    return found.groupBy("chunk").agg(F.collect_list("doc_id").alias("ids"), F.collect_list("th").alias("ths"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (the maximal removed runs of bytes), kept (the bytes left) of every row."""
    src = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    n = parts_for(text_bytes(src), CHUNK_BYTES, LEAST_CHUNKS)
    buckets = n
    th = F.xxhash64("text")
    rows = src.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", th)), F.lit(n)).cast("int")).withColumn("th", th)
    chunks = rows.repartition(n, "chunk")
    copies = _whole_copies(rows)

    def send_anchors(table: pa.Table, extra: pa.Table) -> pa.Table:
        return _send_anchors(table, extra, buckets)

    def send_contexts(table: pa.Table, known: pa.Table) -> pa.Table:
        return _send_contexts(table, known, buckets)

    sent = chunks.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(send_anchors, _ddl(ANCHORS))
    common = sent.groupBy("bucket").applyInArrow(_common_anchors, _ddl(COMMON)).unionByName(copies, allowMissingColumns=True)
    contexts = chunks.groupBy("chunk").cogroup(common.groupBy("chunk")).applyInArrow(send_contexts, _ddl(CONTEXTS))
    answers = contexts.groupBy("bucket").applyInArrow(_answer, _ddl(ANSWERS)).unionByName(copies, allowMissingColumns=True)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut, _ddl(SPANS))
