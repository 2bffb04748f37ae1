"""Vectorised text primitives that run inside Arrow batches on the executors.

A batch's string column is cut into runs of whole rows of a bounded number
of bytes; words, lines and their 64-bit hashes are then found with NumPy on
the run's bytes, without a Python loop over rows.  Null texts count as
empty.  A row longer than the bound forms a run of its own, so texts are
always seen whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
LOWER_KEYS = BYTE_KEYS.copy()
LOWER_KEYS[0x41:0x5B] = BYTE_KEYS[0x61:0x7B]
BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2^64
_pow = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int, which: str = "up") -> np.ndarray:
    """BASE**i (``up``) or its inverse (``down``) for i < n, modulo 2^64."""
    if len(_pow[which]) < n:
        step = BASE if which == "up" else pow(BASE, -1, 2**64)
        full = np.full(max(n, RUN_BYTES + 1), step, U64)
        full[0] = 1
        _pow[which] = np.cumprod(full)
    return _pow[which][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise hashes so that every output bit depends on every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_runs(column, max_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string or binary column into runs of rows [lo, hi): yields lo, hi, the run's bytes and
    the rows' offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    wide = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) \
        else pa.large_binary()
    if column.null_count:
        column = column.fill_null("" if wide == pa.large_string() else b"")
    column = column.cast(wide)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over [offs[i], offs[i+1]) for every row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def word_spans(data: np.ndarray, offs: np.ndarray,
               separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are no separators, by default ASCII white space): starts, ends, and the
    index of each row's first word (one more entry than rows).  Words never span rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~separators[data]
    full = offs[:-1] < offs[1:]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offs[:-1][full]
    first[at] = inside[at]
    at = offs[1:][full] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines (pieces between newlines; every row has at least one): starts, ends, first line of each row."""
    cuts = np.flatnonzero(data == 0x0A)
    n_lines = np.diff(np.searchsorted(cuts, offs)) + 1
    bounds = np.concatenate([[0], np.cumsum(n_lines)])
    starts = np.empty(bounds[-1], np.int64)
    ends = np.empty(bounds[-1], np.int64)
    head = np.zeros(bounds[-1], bool)
    head[bounds[:-1]] = True
    starts[head] = offs[:-1]
    starts[~head] = cuts + 1
    tail = np.zeros(bounds[-1], bool)
    tail[bounds[1:] - 1] = True
    ends[tail] = offs[1:]
    ends[~tail] = cuts
    return starts, ends, bounds


class SpanHasher:
    """64-bit hashes of spans of a run's bytes (A-Z folded if ``lower``), from prefix sums made once;
    equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        n = len(data)
        keyed = (LOWER_KEYS if lower else BYTE_KEYS)[data]
        keyed *= powers(n)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(keyed, out=self.total[1:])
        self.down = powers(n + 1, "down")

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.down[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the spans of one run."""
    return SpanHasher(data, lower)(starts, ends)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word hashes from each word on (len(words) - k + 1 of them, across rows)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= U64(0xC2B2AE3D27D4EB4F)
        h += words[i:n + i]
    return mix(h)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys, by sorting: quicker on large arrays than by hashing."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)]]


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of every item, from each row's first item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key: does it occur twice or more, and is this a later occurrence of it?"""
    n = len(keys)
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    later = np.zeros(n, bool)
    later[order[1:]] = same
    twice = np.zeros(n, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles (A-Z folded); fewer words make one
    shingle of the whole sequence, no words make an empty set."""
    starts, ends, bounds = word_spans(data, offs)
    if not len(starts):
        for _ in range(len(offs) - 1):
            yield np.zeros(0, U64)
        return
    words = span_hashes(data, starts, ends, lower=True)
    grams = gram_hashes(words, k)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            yield gram_hashes(words[a:b], int(b - a)) + U64(b - a)
        else:
            yield np.zeros(0, U64)
