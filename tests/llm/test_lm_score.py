"""The context-tree model against its definition, written as a recursion over dictionaries."""

import collections
import math
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import context_tree as C
from quarry.llm import lm_score as L
from quarry.llm import textvec as V

SCHEMA = "doc_id long, text string, score string, held_out int"


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def steps(text):
    raw = (text or "").translate(brute.FOLD).encode()
    whole = b"\xff" * C.DEPTH + raw + b"\xff"
    return [(whole[i - C.DEPTH:i][::-1], whole[i]) for i in range(C.DEPTH, len(whole))]


def bits(byte):
    return [(f"{byte:08b}"[:k], int(f"{byte:08b}"[k])) for k in range(8)]


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Model:
    def __init__(self, texts):
        self.count = collections.defaultdict(lambda: [0, 0])
        self.below = collections.defaultdict(set)
        for text in texts:
            for near, byte in steps(text):
                for prefix, bit in bits(byte):
                    for d in range(C.DEPTH + 1):
                        self.count[near[:d], prefix][bit] += 1
                        if d:
                            self.below[near[:d - 1], prefix].add(near[:d])
        self.known = {}

    def whole(self, near, prefix):
        if (near, prefix) not in self.known:
            own = kt(*self.count[near, prefix])
            if len(near) < C.DEPTH:
                under = sum(self.whole(c, prefix) for c in self.below[near, prefix])
                own = math.log((math.exp(own - max(own, under)) + math.exp(under - max(own, under))) / 2) + max(own, under)
            self.known[near, prefix] = own
        return self.known[near, prefix]

    def chance(self, near, prefix, bit, depth=0):
        at = self.count.get((near[:depth], prefix))
        if at is None:
            return None
        own = (at[bit] + 0.5) / (sum(at) + 1)
        if depth == C.DEPTH:
            return own
        deeper = self.chance(near, prefix, bit, depth + 1)
        if deeper is None:
            return own
        stop = 0.5 * math.exp(kt(*at) - self.whole(near[:depth], prefix))
        return stop * own + (1 - stop) * deeper

    def score(self, text):
        return sum(math.log10(self.chance(near, prefix, bit) or 0.5) for near, byte in steps(text) for prefix, bit in bits(byte))


def expected(rows):
    train = [t for i, t in rows if not held(i)]
    model = Model(train)
    tokens = [w for t in train for w in [*brute.words((t or "").translate(brute.FOLD)), None]]
    count, n, v = collections.Counter(tokens), len(tokens), len(set(tokens))
    out = []
    for i, t in rows:
        ws = [*brute.words((t or "").translate(brute.FOLD)), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, base, model.score(t)))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, L.score_texts(df).collect()), key=key), sorted(expected(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9), w
        assert g[6] == pytest.approx(w[6], rel=1e-5), w


def test_scores_of_all_kinds(spark):
    rng = random.Random(5)
    pool = ["the", "The", "ion", "stable", "x1", "é", "日本", "\n", "  ", "aaaa"]
    rows = [(i, rng.choice([" ", ""]).join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, "the ion"), (None, None), (61, None), (62, ""), (63, "the the"), (63, "the the"), (64, " \t\n"), (65, "zq" * 300)]
    check(spark, rows)


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(200) if held(i)][:4]
    check(spark, [(ids[0], "abc"), (ids[1], None), (ids[2], "ab ab")])
    assert L.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_better_than_words_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in L.score_texts(df).collect() if r.held_out]
    assert len(rows) > 60
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_long_rows_in_pieces(monkeypatch):
    monkeypatch.setattr(V, "RUN_BYTES", 64)
    rng = random.Random(6)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(80)), "y" * 500, "a " + "z" * 200 + " b", "short", ""]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        offs = np.array([0, len(data)])
        parts = list(L.pieces(data, offs))
        assert b"".join(p[0].tobytes() for p in parts) == t.encode()
        assert [p[3] for p in parts] == [False] * (len(parts) - 1) + [True]
        assert all(p[0].tobytes().endswith(b" ") for p in parts[:-1])
        got = np.concatenate([L.grams_of(*p)[0] for p in parts])
        ext = np.concatenate([np.full(C.DEPTH, C.EDGE, np.uint8), data, np.array([C.EDGE], np.uint8)])
        assert (got == C.pack(ext)).all()
    assert len(list(L.pieces(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0])])))) > 3


def test_numbers_travel_as_planes():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (L.from_differences(L.differences(a)) == a).all()
    assert len(L.from_differences(L.differences(a[:0]))) == 0


def test_chances_of_all_bytes_sum_to_one():
    rng = np.random.default_rng(2)
    near = np.unique(C.pack(rng.integers(97, 100, 40).astype(np.uint8)) >> np.uint64(8))
    grams = ((near[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)).ravel()
    counts = np.where(rng.random(len(grams)) < 0.1, rng.integers(1, 5000, len(grams)), 0)
    tree = C.Tree(grams, counts)
    keys, n, nodes, sums = tree.report()
    chance = 10 ** tree.log_chances(C.Upper(keys.astype(int), n, nodes.astype(int), sums))
    assert chance.reshape(-1, 256).sum(axis=1) == pytest.approx(np.ones(len(near)))


def test_estimate_of_large_counts():
    a, b = np.array([0, 1, 4094, 4096, 10**6, 3]), np.array([0, 0, 5, 4097, 7, 10**7])
    assert C.log_kt(a, b) == pytest.approx([kt(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])


def test_keys_of_runs():
    texts, trains = pa.array(["a a b", None, "b"]), np.array([True, True, False])
    counted, placed = [L.Counted(), L.Counted()], [L.Placed(), L.Placed()]
    for lo, _, data, offs in V.text_runs(texts):
        for kind, keys, rows in L.keys_of(L.LOWER[data], offs):
            counted[kind].add(keys, trains[rows + lo])
            placed[kind].add(keys, rows + lo)
    words, counts = counted[L.WORDS].merge()
    assert counts.tolist() == [{"a": 2, "b": 1, None: 2}[w] for w in _by_hash(["a", "b", None])]
    assert (placed[L.WORDS].close() == words).all()
    assert placed[L.WORDS].sums(np.ones(3), 3).tolist() == [4, 1, 2]
    grams, counts = counted[L.GRAMS].merge()
    assert counts.sum() == 7
    assert (placed[L.GRAMS].close() == grams).all()
    assert placed[L.GRAMS].sums(np.ones(len(grams)), 3).tolist() == [6, 1, 2]


def _by_hash(words):
    hashes = {w: L.END if w is None else V.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words}
    return sorted(words, key=hashes.get)


def test_lists_merge_when_they_grow(monkeypatch):
    monkeypatch.setattr(L, "PENDING", 50)
    rng, counted, want = np.random.default_rng(4), L.Counted(), np.zeros(300, int)
    for _ in range(40):
        keys, trains = rng.integers(0, 300, 30).astype(np.uint64), rng.random(30) < 0.5
        counted.add(keys, trains)
        np.add.at(want, keys[trains].astype(int), 1)
    keys, counts = counted.merge()
    assert counts.tolist() == want[keys.astype(int)].tolist()
    assert len(L.Counted().merge()[0]) == 0
