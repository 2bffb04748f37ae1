"""Quality ledger and line removal against plain Python."""

import random

import brute
import pytest

from quarry.llm import line_dedup, quality
from quarry.llm import textvec as V

ODD = [None, "", " \n\t ", "one", "a b c a b c a b c", "x\nx\n x\nx", "### $$$ a|b <c>", "é ü　ñ\x0bz", "w " * 3000,
       "A a A a", "\n\n\n", "tab\tsep\rret", "word " * 60 + "\nend", "12 34 56 " * 30]


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = ["the", "Of", "a", "##", "über", "x1", "\n", "\n", "  ", "\t", "%%%", "12", "longerword", "é"]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(ODD + random_texts(60, 1)))


def test_measures_and_verdict(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, n_words string, kept int")
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(df)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        for name, value in brute.measures(t).items():
            assert got[i][name] == value, (t, name)
        assert got[i].kept == brute.quality_kept(t), t


def test_kept_documents_keep_their_columns(spark, rows):
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, n_words string, `fail_bits` int")
    out = quality.keep_documents(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {i for i, t in rows if brute.quality_kept(t)}
    assert quality.keep_documents(df.limit(0)).count() == 0


def test_ablation_counts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    entries = quality.ledger(df).cache()
    bits = [r.fail_bits & quality.POLICIES["v2"] for r in entries.collect()]
    for r in quality.ablation(entries, "v2").collect():
        bit = next(1 << x.bit for x in quality.RULES if x.name == r.rule)
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_failed_only_this == sum(b == bit for b in bits)
        assert r.n_kept_without == sum(b & ~bit == 0 for b in bits)
    assert sum(r.n_docs for r in quality.signature_counts(entries).collect()) == len(rows)


def test_runs_see_whole_rows():
    import pyarrow as pa
    texts = ["a" * 50, None, "", "b c", "d" * 200, "e"]
    seen = []
    for lo, hi, data, offs in V.text_runs(pa.array(texts).slice(1), max_bytes=60):
        seen += [data[offs[i]:offs[i + 1]].tobytes().decode() for i in range(hi - lo)]
        starts, ends, bounds = V.word_spans(data, offs)
        assert len(bounds) == hi - lo + 1 and len(starts) == len(ends)
    assert seen == [t or "" for t in texts[1:]]


def lines_input():
    rng = random.Random(4)
    docs = []
    for i in range(150):
        body = [f"own line {i} {k} {rng.random()}" for k in range(rng.randint(1, 6))]
        if i % 3 == 0:
            body.insert(0, "All rights reserved")
        if i % 11 == 0:
            body.append("rare footer")
        if i % 7 == 0:
            body += ["", "  "]
        docs.append((i, "\n".join(body), f"s{i % 20}" if i % 13 else None))
    docs += [(900 + i, "copied page\nsecond line", f"s{i}") for i in range(15)]
    docs += [(2000, None, "s1"), (2001, "", "s2"), (2002, "All rights reserved", "s3"), (2003, "All rights reserved", None)]
    return docs


def test_line_removal(spark):
    docs = lines_input()
    df = spark.createDataFrame([(*d, "z", "q") for d in docs], "doc_id long, text string, source string, n_lines string, h1 string")
    for spare in (None, (1, 2)):
        got = {r.row.doc_id: r for r in line_dedup.remove_lines(df, min_sites=10, spare_share=spare).collect()}
        want = brute.line_dedup(docs, spare=spare is not None)
        assert len(got) == len(docs)
        for i, (n, gone, text) in want.items():
            assert (got[i].n_lines, got[i].n_removed, got[i].row.text) == (n, gone, text), i
        assert got[0].row.n_lines == "z"
        assert got[905].row.text == ("copied page\nsecond line" if spare else "")


def test_line_removal_threshold_is_exact(spark):
    docs = [(i, f"at threshold\nown {i} a\nown {i} b", f"s{i}") for i in range(300)]
    docs += [(1000 + i, f"below it\nown {i} c\nown {i} d", f"s{i}") for i in range(299)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.row.doc_id: r.n_removed for r in line_dedup.remove_lines(df, min_sites=300).collect()}
    assert all(got[i] == 1 for i in range(300)) and not any(got[1000 + i] for i in range(299))


def test_line_removal_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.remove_lines(df).count() == 0
    twice = spark.createDataFrame([(1, "a b\nc", "s")] * 3, "doc_id long, text string, source string")
    assert line_dedup.remove_lines(twice, min_sites=1).count() == 3
