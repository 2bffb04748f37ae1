"""R-tree search and hard negatives against plain scans."""

import math
import random

import numpy as np
import pytest

from quarry.llm import hard_negatives as H
from quarry.llm.rtree import LEAF, Tree, tile_order

SCHEMA = "vec_id long, embedding array<float>, label int, score string, tile int"


def brute(rows):
    sound = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [max(-H.LIMIT, min(H.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v]
            sound.append((i, ints, (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(sound):
        if i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, m) for b, (j, w, m) in enumerate(sound) if b != a]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            near = [r for r in scored if r[2] != label and 80 * s <= 100 * r[0] <= 100 * s][:5]
            out += [(i, j, rank, n, s, t) for rank, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.mine(df).collect())


@pytest.mark.parametrize("shard_rows", [40, 1 << 15])
def test_rows_of_all_kinds(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(H, "SHARD_ROWS", shard_rows)
    rng = random.Random(8)
    centre = [[rng.gauss(0, 0.4) for _ in range(12)] for _ in range(4)]
    rows = [(i * 5, [c + rng.gauss(0, 0.1) for c in centre[rng.randrange(4)]], rng.choice([1, 1, 1, 2, 3, 9])) for i in range(400)]
    rows += [(i + 3000, rows[7][1], rng.choice([1, 2])) for i in range(100)]          # one vector many times
    rows += [rows[20], rows[20], (100, rows[3][1], 2), (100, rows[40][1], 2)]             # repeated rows and ids
    rows += [(None, rows[0][1], 1), (4001, None, 1), (4002, rows[0][1], None), (4003, [0.1, None], 1), (4004, [math.nan] * 12, 1),
             (4005, [math.inf] * 12, 1), (4100, [], 2), (4200, [0.5, -0.25], 1), (4006, [0.0] * 12, 3), (4300, [0.3] * 20, 1)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert len(got) > 50


def test_large_components_stay_exact(spark):
    rows = [(i, [1e30 if i % 3 else -1e30, 1e5 + i, 7.0], i % 2) for i in range(0, 300, 4)]
    assert run(spark, rows) == brute(rows)


def test_nothing_to_mine(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0], 1)]) == []
    assert run(spark, [(101, [1.0], 1), (102, [1.0], 2)]) == []


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000, 5000])
def test_tree_search_equals_scan(n):
    rng = np.random.default_rng(n)
    rows, ids = rng.integers(-3, 4, (n, 6)).astype(np.int32), rng.permutation(n).astype(np.int64)
    tree = Tree.pack(rows, ids)
    assert sorted(tree.ids.tolist()) == list(range(n))
    assert len(tree.boxes[-1][0]) == 1
    low, high, least = tree.boxes[0]
    for i in range(len(low)):
        part = tree.rows[i * LEAF:(i + 1) * LEAF]
        assert (part >= low[i]).all()
        assert (part <= high[i]).all()
        assert least[i] == tree.ids[i * LEAF:(i + 1) * LEAF].min()
    tree.prepare(10.0)
    for _ in range(20):
        q = rng.integers(-4, 5, 6)
        scores = rows.astype(int) @ q
        lows, highs = [-np.inf, 5, 20, 8], [np.inf, 30, 22, 8]
        got = tree.search(q, lows, highs, 5)
        for w in range(4):
            order = [(int(scores[i]), int(ids[i])) for i in np.lexsort([ids, -scores]) if lows[w] <= scores[i] <= highs[w]]
            assert got[w] == order[:5]


def test_tiles_bring_neighbours_together():
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.integers(-1000, 1000, (32, 8)), LEAF, axis=0) + rng.integers(-3, 4, (32 * LEAF, 8))
    ids = rng.permutation(len(rows))
    tree = Tree.pack(rows, ids)
    low, high, _ = tree.boxes[0]
    assert np.median((high - low).max(axis=1)) <= 6
    tree.prepare(1e4)
    assert len(tile_order(rows[:0], ids[:0])) == 0
