"""The corpus pipeline against plain Python, and the queries' SQL."""

import os
import sys

import brute
import duckdb
import public_tokenizers as P
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from quarry.llm import queries  # noqa: E402
from quarry.llm.tokenizers_io import read_ranks  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [d for d in docs if brute.quality_kept(d[1])]
    lines = brute.line_dedup(docs)
    texts = {i: lines[i][2] for i, *_ in docs}
    component = brute.near_components(texts)
    texts = {i: t for i, t in texts.items() if component[i] == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(brute.holds(t, x) for x in items)}
    assert set(got) == set(texts)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(got[i].n_tokens == len(enc.encode_ordinary(t)) for i, t in texts.items())


def test_stages_defined_cases(spark):
    schema = "doc_id long, text string, source string, h1 string, n_words int"
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "s", "h", 1), (1, text, "s", "h", 1), (None, text, None, None, None), (2, None, "s", "h", 1), (3, "", "s", "h", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), schema)
        assert sorted((r.doc_id or 0) for r in docs.collect()) == ([0, 1] if data else [])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
