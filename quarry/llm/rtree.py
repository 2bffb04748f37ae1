"""R-tree over integer vectors, packed by sort-tile-recursive, for inner-product search.

Rows are cut into tiles by their coordinates of the largest spread, one after
the other; a leaf holds up to ``LEAF`` neighbouring rows, a node up to
``FANOUT`` children, and every node the least and greatest value of each
coordinate below it.  Against a query q, coordinate i of a box lies between
min(q_i lo_i, q_i hi_i) and max(q_i lo_i, q_i hi_i), so the sums bound the
inner products of all its rows.

``search`` visits boxes by falling upper bound.  A box is left out if it lies
outside every score window, or strictly below the kth row found so far (at
the kth row's score if all its ids are larger).
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 64
FANOUT = 16
#: Sums of products below this are exact in floating point.
EXACT = 2.0 ** 53


def tile_order(rows: np.ndarray, ids: np.ndarray, size: int = LEAF) -> np.ndarray:
    """Order in which consecutive ``size`` rows are neighbours: sort-tile-recursive over the coordinates by
    falling variance, as many as halve the rows down to a tile."""
    n, dim = rows.shape
    depth = min(dim, max(1, int(np.ceil(np.log2(max(n / size, 1))))))
    axes = np.argsort(-rows.astype(float).var(axis=0), kind="stable")[:depth] if n and dim else []
    parts = [np.lexsort([ids])]
    for k, axis in enumerate(axes):
        cut = []
        for part in parts:
            tiles = -(-len(part) // size)
            slabs = int(np.ceil(tiles ** (1 / (len(axes) - k)) - 1e-9))
            width = -(-tiles // max(slabs, 1)) * size  # whole tiles, so that only the last one is short
            part = part[np.lexsort([ids[part], rows[part, axis]])]
            cut += [part[i:i + width] for i in range(0, len(part), width)]
        parts = cut
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Tree:
    """Packed rows with their boxes.  ``boxes[0]`` are the leaves' (low, high, least id), the last the root's."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.rows, self.ids, self.boxes = rows, ids, boxes
        self.reach = float(np.abs(rows).max(initial=0))

    @classmethod
    def pack(cls, rows: np.ndarray, ids: np.ndarray) -> Tree:
        order = tile_order(rows, ids)
        rows, ids = rows[order], ids[order]
        heads, low, high, least = np.arange(0, len(rows), LEAF), rows, rows, ids
        boxes = []
        while len(heads):
            low, high, least = (f.reduceat(x, heads, axis=0) for f, x in ((np.minimum, low), (np.maximum, high), (np.minimum, least)))
            boxes.append((low, high, least))
            if len(low) == 1:
                break
            heads = np.arange(0, len(low), FANOUT)
        return cls(rows, ids, boxes)

    def prepare(self, reach: float) -> None:
        """Numbers as floats where every sum against queries up to ``reach`` is exact, else as whole numbers."""
        exact = self.reach * reach * self.rows.shape[1] < EXACT
        self.kind = np.float64 if exact else np.int64
        self.rows = self.rows.astype(self.kind)
        self.boxes = [(a.astype(self.kind), b.astype(self.kind), c) for a, b, c in self.boxes]

    def search(self, query: np.ndarray, lows: list, highs: list, k: int) -> list[list[tuple[int, int]]]:
        """Per window [low, high], the first k rows in it by falling inner product, then id: (score, id)."""
        found: list[list] = [[] for _ in lows]
        if not self.boxes:
            return found
        q = query.astype(self.kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        floors, last_ids, top = list(lows), [None] * len(lows), max(highs)
        least_floor = min(floors)
        heap = [(-np.inf, len(self.boxes) - 1, 0, -np.inf, 0)]
        while heap:
            bound, level, i, bottom, first_id = heapq.heappop(heap)
            if -bound < least_floor:
                break
            if not any(-bound >= f and bottom <= h and (last is None or -bound > f or first_id < last)
                       for f, h, last in zip(floors, highs, last_ids, strict=True)):
                continue
            if level:
                a, b = i * FANOUT, (i + 1) * FANOUT
                low, high, least = (x[a:b] for x in self.boxes[level - 1])
            else:
                low = None
            if low is not None:
                most, fewest = high @ up + low @ down, low @ up + high @ down
                for j in np.flatnonzero((most >= least_floor) & (fewest <= top)).tolist():
                    heapq.heappush(heap, (-most[j], level - 1, a + j, fewest[j], least[j]))
                continue
            a = i * LEAF
            scores = self.rows[a:a + LEAF] @ q
            near = np.flatnonzero((scores >= least_floor) & (scores <= top))
            if not len(near):
                continue
            rows = list(zip((-scores[near]).tolist(), self.ids[a + near].tolist(), strict=True))
            for w, (floor, high) in enumerate(zip(floors, highs, strict=True)):
                new = [r for r in rows if floor <= -r[0] <= high]
                if new:
                    found[w] = sorted(found[w] + new)[:k]
                    if len(found[w]) == k:
                        floors[w], last_ids[w] = -found[w][-1][0], found[w][-1][1]
            least_floor = min(floors)
        return [[(int(-s), i) for s, i in rows] for rows in found]
