"""Exact tokenizer encoding of whole texts through a bounded cache of pieces.

The pre-split patterns of byte-level BPE always end a token right before a
single space or newline that stands between two non-space characters.  Texts
are cut there, each distinct piece is encoded once by the tokenizer, and a
document's ids are the concatenation of its pieces' ids.  Where any other
white space stands no cut is made, which is coarser and always safe.  Finding
the pieces, looking them up and concatenating ids work on a whole run of rows
at once.  Pieces are recognised by a 64-bit hash of their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from quarry.llm import textvec as V

U64 = np.uint64
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = False
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def solid_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes that are no part of a white-space character (Unicode White_Space and U+001C..1F)."""
    solid = _SOLID[data]
    at = np.flatnonzero(_LEADS[data])
    if len(at):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = data[at], padded[at + 1], padded[at + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) \
            | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) \
            | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        solid[at[two | three]] = False
        solid[at[two | three] + 1] = False
        solid[at[three] + 2] = False
    return solid


def piece_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that tile the rows: starts, ends, and whether the piece can follow another one in a joined
    text (it starts with a cut's space and ends in a non-space)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    solid = solid_bytes(data)
    cut = np.zeros(n, bool)
    cut[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & solid[:-2] & solid[2:]
    row_at = offs[:-1][offs[:-1] < offs[1:]]
    cut[row_at] = False
    cut[row_at[1:] - 1] = False
    regular = cut.copy()
    cut[row_at] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends, regular[starts] & solid[ends - 1]


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of pool[starts[i]:starts[i] + sizes[i]] over i."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


class PieceEncoder:
    """``encode_joined`` turns a text into ids; ``id_bytes[i]`` is the number of bytes of id i, by which
    a joined text's ids are dealt back to its pieces.

    Memory is bounded: the cache is emptied when it holds ``max_entries`` pieces."""

    def __init__(self, encode_texts: Callable[[list[str]], list[np.ndarray]], id_bytes: np.ndarray,
                 max_entries: int = 1_000_000, join: int = 256):
        self.encode_texts, self.id_bytes = encode_texts, id_bytes
        self.max_entries, self.join = max_entries, join
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots_of = np.zeros(1 << 17, U64), np.zeros(1 << 17, np.int32)
        self.n, self.used = 0, 0
        self.hashes = np.zeros(1 << 15, U64)
        self.start, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.pool = np.zeros(1 << 17, np.uint32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry number of every hash, -1 where unknown."""
        mask = len(self.keys) - 1
        out = np.full(len(h), -1, np.int64)
        slot = (h & U64(mask)).astype(np.int64)
        rest = np.arange(len(h))
        while len(rest):
            k = self.keys[slot]
            hit = k == h[rest]
            out[rest[hit]] = self.slots_of[slot[hit]]
            go = ~hit & (k != 0)
            rest, slot = rest[go], (slot[go] + 1) & mask
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (h & U64(mask)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            placed = free & (self.keys[slot] == h)
            self.slots_of[slot[placed]] = entry[placed]
            h, entry, slot = h[~placed], entry[~placed], (slot[~placed] + 1) & mask

    def _add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = self.n + len(h), self.used + len(ids)
        for name, need in (("hashes", n), ("start", n), ("size", n), ("pool", total)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[:len(old)] = old
                setattr(self, name, new)
        self.hashes[self.n:n], self.size[self.n:n] = h, sizes
        self.start[self.n:n] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used:total] = ids
        if 2 * n > len(self.keys):
            width = 1 << (4 * n - 1).bit_length()
            self.keys, self.slots_of = np.zeros(width, U64), np.zeros(width, np.int32)
            self._place(self.hashes[:n].copy(), np.arange(n, dtype=np.int32))
        else:
            self._place(h, np.arange(self.n, n, dtype=np.int32))
        self.n, self.used = n, total

    def _learn(self, raw: bytes, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, regular: np.ndarray) -> None:
        """Encode the unknown pieces: regular ones many at once, the others each by itself."""
        reg, odd = np.flatnonzero(regular), np.flatnonzero(~regular)
        groups = [reg[i:i + self.join] for i in range(0, len(reg), self.join)] + [odd[i:i + 1] for i in range(len(odd))]
        texts = [b"".join(raw[starts[j]:ends[j]] for j in g).decode() for g in groups]
        for g, ids in zip(groups, self.encode_texts(texts), strict=True):
            done = np.cumsum(self.id_bytes[ids])
            want = np.cumsum(ends[g] - starts[g])
            last = np.searchsorted(done, want)
            if len(ids) and not np.array_equal(done[last], want):
                raise ValueError("a token crosses a cut, or the tokenizer changes the text's bytes")
            self._add(h[g], np.asarray(ids, np.uint32), np.diff(last + 1, prepend=0))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a run, and the index of each row's first id (one more entry than rows)."""
        starts, ends, regular = piece_spans(data, offs)
        if self.n > self.max_entries:
            self.clear()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        h = V.span_hashes(data, starts, ends) | U64(1)
        entry = self._find(h)
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            new, at = np.unique(h[unknown], return_index=True)
            at = unknown[at]
            self._learn(data.tobytes(), new, starts[at], ends[at], regular[at])
            entry[unknown] = self._find(h[unknown])
        sizes = self.size[entry]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.pool, self.start[entry], sizes), total[np.searchsorted(starts, offs)]
