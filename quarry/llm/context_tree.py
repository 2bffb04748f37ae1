"""Context-tree weighting over bytes, as arrays.

A gram is ``DEPTH`` context bytes and the byte they precede, packed into one
number: the nearest context byte on top, the byte itself lowest.  A byte is
eight binary decisions.  Each decision has a node for every depth 0 to
``DEPTH``: the nearest ``depth`` context bytes and the bits decided before it.
A node counts zeros and ones, whose Krichevsky-Trofimov estimate is

    P_kt(a, b) = G(a + 1/2) G(b + 1/2) / (pi G(a + b + 1))

and weighs it, half and half, against the product of its children's:

    P_w = 1/2 P_kt + 1/2 prod P_w(child),    P_w = P_kt at the last depth.

Both are over all training bytes.  The chance of the next decision mixes the
estimates of all depths by the weights that training left: a node stops with
weight P_kt / (2 P_w) and otherwise asks the next depth.  A child that
training never met knows nothing, so its parent's own estimate stands for it.

``Tree`` holds grams whose two nearest context bytes belong together, so all
nodes of depth 2 and more are whole in it; ``Upper`` holds depths 0 and 1,
which sum what the trees report, 256 x 255 nodes at most.
"""

from __future__ import annotations

import math

import numpy as np

DEPTH = 6
#: Depth from which on nodes belong to one tree.
SPLIT = 2
#: Stands before the first and after the last byte of a text; UTF-8 doesn't hold it.
EDGE = 0xFF
U64 = np.uint64
NODES = 255
_LGAMMA_HALF = np.concatenate([[0.5 * math.log(math.pi)], 0.5 * math.log(math.pi) + np.cumsum(np.log(np.arange(4096) + 0.5))])
_LGAMMA_ONE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4097)))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def _lgamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log G(n + shift) for whole n, small ones from the table."""
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    big = n >= len(table)
    if big.any():
        out[big] = _stirling(n[big] + shift)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the estimate of a whole sequence with so many zeros and ones."""
    return (_lgamma(zeros, _LGAMMA_HALF, 0.5) + _lgamma(ones, _LGAMMA_HALF, 0.5) - math.log(math.pi)
            - _lgamma(zeros + ones, _LGAMMA_ONE, 1.0))


def weigh(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P_w and the weight of stopping, from the node's own and its children's log estimates."""
    whole = np.logaddexp(kt, children) - math.log(2)
    return whole, np.exp(kt - math.log(2) - whole)


def pack(ext: np.ndarray) -> np.ndarray:
    """Grams of all places from ``DEPTH`` on in a run of bytes."""
    n = len(ext) - DEPTH
    gram = np.zeros(max(n, 0), U64)
    if n > 0:
        for back in range(1, DEPTH + 1):
            gram |= ext[DEPTH - back:DEPTH - back + n].astype(U64) << U64(8 * (DEPTH + 1 - back))
        gram |= ext[DEPTH:].astype(U64)
    return gram


def context_of(gram: np.ndarray, depth: int) -> np.ndarray:
    return gram >> U64(8 * (DEPTH + 1 - depth))


def sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[heads], np.add.reduceat(counts[order], heads) if len(k) else counts[:0]


class _Level:
    """Nodes of one depth: per decision ``k``, the node of every (context, byte) and the nodes' counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.node, self.zeros, self.ones, self.heads = [], [], [], []
        for k in range(8):
            path = keys >> U64(8 - k)
            head = np.concatenate([[True], path[1:] != path[:-1]])
            heads = np.flatnonzero(head)
            one = (keys >> U64(7 - k)) & U64(1) == 1
            ones = np.add.reduceat(np.where(one, counts, 0), heads)
            self.node.append(np.cumsum(head) - 1)
            self.heads.append(heads)
            self.ones.append(ones)
            self.zeros.append(np.add.reduceat(counts, heads) - ones)


class Tree:
    """All nodes of depth ``SPLIT`` and more over sorted distinct grams; grams that only texts to be
    scored hold have a count of 0."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams = grams
        counts = counts.astype(np.int64)
        self.levels: dict[int, _Level] = {}
        self.up: dict[int, np.ndarray] = {}
        keys, n = grams, counts
        for depth in range(DEPTH, SPLIT - 1, -1):
            self.levels[depth] = _Level(keys, n)
            short = (context_of(grams, depth - 1) << U64(8)) | (grams & U64(0xFF))
            below, self.up[depth - 1] = np.unique(short, return_inverse=True)
            n = np.bincount(self.up[depth - 1], weights=counts, minlength=len(below)).astype(np.int64)
            keys = below
        self.last = keys, n
        self._weigh()

    def _weigh(self) -> None:
        self.stop: dict[int, list[np.ndarray]] = {}
        for depth in range(DEPTH, SPLIT - 1, -1):
            level = self.levels[depth]
            kt = [log_kt(a, b) for a, b in zip(level.zeros, level.ones, strict=True)]
            if depth == DEPTH:
                self.whole = kt
            else:
                sums = [np.bincount(up, weights=w, minlength=len(x)) for up, w, x in zip(self._parents(depth), self.whole, kt, strict=True)]
                found = [weigh(x, s) for x, s in zip(kt, sums, strict=True)]
                self.whole = [x[0] for x in found]
                self.stop[depth] = [x[1] for x in found]

    def _parents(self, depth: int) -> list[np.ndarray]:
        """Per decision, the node of ``depth`` above every node one deeper."""
        above, deeper = self.levels[depth], self.levels[depth + 1]
        short = ((deeper.keys >> U64(16)) << U64(8)) | (deeper.keys & U64(0xFF))
        row = np.searchsorted(above.keys, short)
        return [above.node[k][row[deeper.heads[k]]] for k in range(8)]

    def report(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What depth 1 needs: (context byte, byte) keys with their counts, and node keys with the sums
        of log P_w over their children; a node key is context byte x 256 + node number."""
        level = self.levels[SPLIT]
        keys, sums = [], []
        for k in range(8):
            at = level.keys[level.heads[k]]
            number = U64((1 << k) - 1) + ((at & U64(0xFF)) >> U64(8 - k))
            keys.append(((at >> U64(16)) << U64(8)) | number)
            sums.append(self.whole[k])
        return *self.last, *sum_by(np.concatenate(keys), np.concatenate(sums))

    def log_chances(self, upper: Upper) -> np.ndarray:
        """log10 of the chance of every gram's byte after its context."""
        out = np.zeros(len(self.grams))
        byte = (self.grams & U64(0xFF)).astype(np.int64)
        near = context_of(self.grams, 1).astype(np.int64)
        for k in range(8):
            one = (byte >> (7 - k)) & 1 == 1
            chance, seen = np.full(len(byte), 0.5), np.zeros(len(byte), bool)
            for depth in range(DEPTH, SPLIT - 1, -1):
                level = self.levels[depth]
                node = level.node[k] if depth == DEPTH else level.node[k][self.up[depth]]
                a, b = level.zeros[k][node], level.ones[k][node]
                stop = self.stop[depth][k][node] if depth < DEPTH else None
                chance, seen = step(chance, seen, one, a, b, stop)
            number = (1 << k) - 1 + (byte >> (8 - k))
            for counts, stop in ((upper.near, upper.stop_near), (upper.root, upper.stop_root)):
                cell = (near, number) if counts.ndim == 3 else (number,)
                pair = counts[cell]
                chance, seen = step(chance, seen, one, pair[:, 0], pair[:, 1], stop[cell])
            out += np.log10(chance)
        return out


def step(chance: np.ndarray, seen: np.ndarray, one: np.ndarray, zeros: np.ndarray, ones: np.ndarray,
         stop: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """One depth up: mix the node's own estimate with the deeper chance."""
    total = zeros + ones
    own = (np.where(one, ones, zeros) + 0.5) / (total + 1.0)
    here = total > 0
    mixed = own if stop is None else np.where(seen, stop * own + (1 - stop) * chance, own)
    return np.where(here, mixed, chance), here


class Upper:
    """Depths 0 and 1, dense: counts per node (zeros, ones) and weights of stopping."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, nodes: np.ndarray, sums: np.ndarray):
        by_byte = np.zeros((256, 256), np.int64)
        by_byte[keys >> 8, keys & 0xFF] = counts
        self.near = np.zeros((256, NODES, 2), np.int64)
        for k in range(8):
            cells = by_byte.reshape(256, 1 << k, 2, -1).sum(axis=3)
            self.near[:, (1 << k) - 1:(2 << k) - 1] = cells
        self.root = self.near.sum(axis=0)
        below = np.zeros((256, NODES))
        below[nodes >> 8, nodes & 0xFF] = sums
        whole, self.stop_near = weigh(log_kt(self.near[..., 0], self.near[..., 1]), below)
        self.stop_root = weigh(log_kt(self.root[:, 0], self.root[:, 1]), whole.sum(axis=0))[1]
