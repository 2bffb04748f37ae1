"""Near duplicates, components and repeated byte strings against plain Python."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import near_dedup, repeats
from quarry.llm import textvec as V
from quarry.llm.components import components

rng = random.Random(12)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]


def prose(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def corpus():
    docs = {}
    base = [prose(rng.randint(20, 160)) for _ in range(30)]
    i = 0
    for b in base:
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            docs[i] = rng.choice([" ", "\n"]).join(w)
            i += 1
    passage = prose(80)
    for _ in range(25):  # a long shared passage does not make copies
        docs[i] = " ".join(prose(20) + passage + prose(rng.randint(5, 60)))
        i += 1
    chain = prose(60)
    for _ in range(12):  # neighbours are linked, the ends are not
        chain = chain[1:] + prose(1)
        docs[i] = " ".join(chain)
        i += 1
    for t in ("", " \n", "one two", "ONE two", "a b c d", "a b c d e", "A b c D e", "a b c d e f"):
        docs[i] = t
        i += 1
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_near_duplicates(spark, docs):
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in docs.items()], "doc_id long, text string, kept int, sig string").repartition(4)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df).collect()}
    want = brute.near_components(docs)
    assert len(got) == len(docs)
    for i, t in docs.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(brute.shingles(t)), want[i], want[i] == i), i


def test_large_group_of_near_copies_is_linked(spark):
    base = prose(200)
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(400 + i, " ".join(prose(50))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0} and all(got[i] == i for i in range(400, 440))


def test_blocks_find_links_the_rounds_missed(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute.near_components(docs)


def test_near_duplicates_defined_cases(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = "a b c d e f g"
    rows = near_dedup.near_duplicates(spark.createDataFrame([(3, same), (3, same), (1, same), (None, same), (7, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [
        (0, 0, True), (1, 1, True), (3, 1, False), (3, 1, False), (7, 7, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (100, 120), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 100: 50, 120: 50, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeat_docs():
    r = random.Random(5)
    words = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    shared, unicode_part = words(30), "üñé" * 40
    docs = {}
    for i in range(40):
        docs[i] = (words(r.randint(0, 30)) + (" " + shared[r.randint(0, 60):r.randint(70, 150)]) * r.randint(0, 2)
                   + words(r.randint(0, 10)) + (unicode_part[:r.randint(20, 100)] if i % 4 == 0 else "")).encode()
    docs |= {50: b"x" * 49, 51: b"x" * 50, 52: b"x" * 400, 53: b"", 54: docs[3], 55: docs[3] + docs[4], 56: b"ab" * 60,
             57: b"ba" * 60, 58: b"\0" * 60, 59: b"\0" * 55}
    return docs


def test_repeats(spark):
    docs = repeat_docs()
    df = spark.createDataFrame([(i, t.decode(), 1, "c") for i, t in docs.items()], "doc_id long, text string, chunk int, kept string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    want = brute.repeats(docs)
    assert len(got) == len(docs)
    for i, (spans, kept) in want.items():
        assert [(s.start, s.end) for s in got[i].spans] == spans, i
        assert bytes(got[i].kept) == kept and got[i].n_bytes == len(docs[i]), i


@pytest.mark.parametrize("hot", [-1, 2, 100])
def test_repeats_with_hot_anchors(hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = repeat_docs()
    chunks = [pa.table({"doc_id": pa.array([i for i in docs if i % 4 == c]), "text": pa.array([docs[i].decode() for i in docs if i % 4 == c]),
                        "chunk": pa.array([c] * sum(i % 4 == c for i in docs), pa.int32()),
                        "th": pa.array([hash(docs[i]) for i in docs if i % 4 == c])}) for c in range(4)]
    copies = {c: pa.table({"ids": pa.array([[i for i in (54,) if i % 4 == c]], pa.list_(pa.int64())),
                           "ths": pa.array([[hash(docs[i]) for i in (54,) if i % 4 == c]], pa.list_(pa.int64()))}) for c in range(4)}

    def with_copies(table, c):
        return pa.concat_tables([table, copies[c]], promote_options="default")

    def deal(tables, key):
        whole = pa.concat_tables(tables)
        keys = whole.column(key).to_numpy()
        return {k: whole.filter(pa.array(keys == k)) for k in np.unique(keys)}

    sent = deal([repeats._send_anchors(t, copies[c], 3) for c, t in enumerate(chunks)], "bucket")
    common = deal([repeats._common_anchors(t) for t in sent.values()], "chunk")
    contexts = deal([repeats._send_contexts(t, with_copies(common.get(c, repeats.COMMON.empty_table()), c), 3) for c, t in enumerate(chunks)], "bucket")
    answers = deal([repeats._answer(t) for t in contexts.values()], "chunk")
    want = brute.repeats(docs)
    for c, t in enumerate(chunks):
        for r in repeats._cut(t, with_copies(answers.get(c, repeats.ANSWERS.empty_table()), c)).to_pylist():
            assert r["kept"] == want[r["doc_id"]][1], r["doc_id"]


def test_repeats_defined_cases(spark):
    schema = "doc_id long, text string"
    assert repeats.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    t = "some text that is longer than fifty bytes, so that it can repeat"
    rows = repeats.remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes - len(r.kept)) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, len(t)), (3, 0)]


def test_lcp_intervals():
    got = sorted(map(tuple, repeats.lcp_intervals(np.array([0, 3, 5, 5, 2, 0, 4]), 2).tolist()))
    assert got == [(2, 1, 0, 5), (3, 2, 0, 4), (4, 1, 5, 7), (5, 3, 1, 4)]


def test_shingle_sets_sizes():
    texts = ["a b c d e f", "a b c d e f a b c d e f", "A a a a a a a", "x", None]
    sets = [s for *_, data, offs in V.text_runs(pa.array(texts)) for s in V.shingle_sets(data, offs, 5)]
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
