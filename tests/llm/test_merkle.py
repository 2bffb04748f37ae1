"""The Merkle manifest against a plain recursive tree."""

import hashlib
import random
import zlib

import pytest

from quarry.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, `at` int"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    cells = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha(cells)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def walk(tree, i):
    path = []
    for level in tree[:-1]:
        first = i - i % 3
        path.append((i - first, [x for k, x in enumerate(level[first:first + 3], first) if k != i]))
        i //= 3
    return path


def brute(rows):
    """rows of SCHEMA's first five columns to the sorted result rows."""
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    trees = {}
    for r in rows:
        trees.setdefault(key(r), []).append(r)
    trees = {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for k, v in sorted(trees.items())}
    built = {k: levels([leaf(*r) for r in v]) for k, v in trees.items()}
    top = levels([t[-1][0] for t in built.values()])
    out = []
    for n, (k, v) in enumerate(trees.items()):
        for i, r in enumerate(v):
            path = walk(built[k], i) + walk(top, n)
            now = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = leaf(*r[:4], r[4].replace("\n", ""))
            for own, others in path:
                now = sha([*others[:own], now, *others[own:]])
            out.append((r[0], leaf(*r), built[k][-1][0], top[-1][0], sha([x for _, o in path for x in o]), now, now == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in M.audit(df).collect()), key=repr)


def test_rows_of_all_kinds(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "é", "", None, "B"]), rng.choice(["en", None]), rng.choice([1, None]),
             rng.choice([None, "", "x\ny", "plain", "ü\n" * 400, "long " * 9000 + "\n"])) for i in range(150)]
    rows += [(None, "a", None, None, "no id\n"), (None, None, None, None, None), (7, "a", "en", 1, "same id"),
             (200, "z", "en", 2, "alone\n"), (3, "b", "en", 1, "twice"), (3, "b", "en", 1, "twice")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2187, 2188, 4500])
def test_sources_larger_than_a_builder(spark, n):
    rows = [(i, "hot", "en", i % 7, f"t{i}\n") for i in range(n)] + [(i, f"s{i % 5}", None, None, "q") for i in range(n, n + 11)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert len(got) == n + 11


def test_empty_table(spark):
    assert M.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def post_order(n):
    """(level, index) of the nodes of a tree of n leaves, children first."""
    top = M.height(n)

    def visit(level, i):
        if level:
            for k in range(3 * i, min(3 * i + 3, -(-n // 3 ** (level - 1)))):
                yield from visit(level - 1, k)
        yield level, i

    return list(visit(top, 0))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100, 250])
def test_places_follow_completion_order(n):
    order = post_order(n)
    assert [M.place(level, i, n, M.height(n)) for level, i in order] == list(range(len(order)))
    leaves = [bytes([i % 256]) * 32 for i in range(n)]
    log = M.complete(leaves, M.height(n))
    tree = levels([x.hex() for x in leaves])
    assert [log[k * 32:k * 32 + 32].hex() for k in range(len(order))] == [tree[level][i] for level, i in order]


def test_log_answers_single_proofs(spark):
    n = 3000
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(n)]
    manifest = M.Manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    log = {r.position: bytes(r.node) for r in M.append_log(manifest.tiers).collect()}
    tree = levels([leaf(*r) for r in rows])
    assert sorted(log) == list(range(sum(map(len, tree))))
    for i in (0, 1, 2186, 2187, 2999):
        got = [log[p].hex() for p in M.proof_places(i, n)]
        assert got == [x for _, others in walk(tree, i) for x in others]
