"""Encoding, token files and token counts against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, token_counts, token_files
from quarry.llm import textvec as V
from quarry.llm.tokenizers_io import json_encoder, plain_encoder, read_ranks

RANKS, VOCAB = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
PLAIN = Tokenizer.from_file(VOCAB)
TOK = Tokenizer.from_file(VOCAB)
TOK.encode_special_tokens = True
rng = random.Random(8)
ODD = [None, "", " ", "\n", "\n\n", "a  b", "x\n\ny\n\n", "x\n\n\n y", "  lead", "trail ", "t\t x", "a \n b", " x y  z",
       "don't it's 's x'll", "a b c  d e—f 　 g", "<|endoftext|> <|endoftext|>", "a" * 3000, "ab" * 700,
       "".join(rng.choice("abcdefgh") for _ in range(4000)), "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(2000)),
       "\U0001f600 \U0001f468‍\U0001f469 é", "x\x1cy \x85 z", "1234567890 12,34.5"]


def encoded(encoder, texts):
    out = []
    for _, _, data, offs in V.text_runs(pa.array(texts, pa.string())):
        ids, at = encoder.encode(data, offs)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def test_odd_texts_as_the_libraries_encode_them():
    assert encoded(bpe.codec(RANKS, P.PATTERN).encoder, ODD) == [TIK.encode_ordinary(t or "") for t in ODD]
    assert encoded(json_encoder(VOCAB), ODD) == [e.ids for e in TOK.encode_batch([t or "" for t in ODD], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab c\n\t'sé  —1.Z"), max_size=40), max_size=6))
def test_pieces_never_change_an_encoding(texts):
    assert encoded(bpe.codec(RANKS, P.PATTERN).encoder, texts) == [TIK.encode_ordinary(t) for t in texts]


def test_special_strings_as_the_plain_call_encodes_them():
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "no <|endof", "text|> no", "<|endoftext|><|endoftext|>x", "z"]
    assert encoded(plain_encoder(VOCAB), texts) == [e.ids for e in PLAIN.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_must_fit_their_files(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="take a larger width"):
        token_counts.write_flat(df, "/tmp/never-written", VOCAB, 70_000)


def test_cache_is_bounded():
    c = bpe.RankCodec(RANKS, P.PATTERN)
    c.encoder.max_entries = 5
    texts = [f"w{i} x{i} y{i}" for i in range(40)]
    for t in texts:
        assert encoded(c.encoder, [t]) == [TIK.encode_ordinary(t)]
    assert c.encoder.n < 20


def test_higher_order_fold_gives_the_same_ids(spark):
    words = [" the", "hello", " xylophone", "é", "中文", "a", "''", " 12345", "zzzzzzzz"]
    df = spark.createDataFrame([(w,) for w in [*words, None, "a"]], "word string")
    got = {r.word: r.ids for r in bpe.encode_words(df, RANKS).collect()}
    assert got == {w: TIK.encode_ordinary(w) for w in words}


def test_digests_and_round_trip(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*ODD, "same", "same"])], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.digest_documents(df, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = TIK.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded).decode() for r in
            bpe.decode_documents(bpe.encode_documents(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    assert bpe.digest_documents(df.limit(0), RANKS, P.PATTERN).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1300))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    index, blocks = token_files.pack_blocks(ids)
    assert np.array_equal(token_files.unpack_blocks(index, b"".join(blocks)), ids)


def test_outliers_are_exceptions():
    ids = np.arange(512, dtype=np.uint32) % 16
    ids[7] = 4_000_000_000
    index, blocks = token_files.pack_blocks(ids)
    assert index["width"][0] == 4 and index["patches"][0] == 1 and len(blocks[0]) == 512 * 4 // 8 + 6


def test_token_files_read_back(spark, tmp_path, monkeypatch):
    texts = [*ODD, *[f"document number {i} " * (i % 40) for i in range(200)]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i * 3 - 50, texts[i], i) for i in order]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = {r.doc_id: r for r in token_files.token_files(df, VOCAB).collect()}
    start = 0
    for i, t, _ in sorted(rows):
        ids = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_token_files_defined_cases(spark):
    schema = "doc_id long, text string"
    assert token_files.token_files(spark.createDataFrame([], schema), VOCAB).count() == 0
    rows = token_files.token_files(spark.createDataFrame([(5, "b"), (5, "a a"), (None, "zz"), (None, None)], schema), VOCAB).collect()
    assert [(r.doc_id, r.n_tokens) for r in sorted(rows, key=lambda r: r.start)] == [(None, 1), (None, 2), (5, 3), (5, 2)]


def test_long_document_crosses_groups(spark):
    text = " ".join(str(rng.randint(0, 10**6)) for _ in range(400_000))
    r = token_files.token_files(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), VOCAB).collect()
    assert sum(x.n_tokens for x in r) > token_files.BLOCK * token_files.GROUP
    want = np.array([*encoded(json_encoder(VOCAB), [text])[0], 2], "<u4")
    assert next(x for x in r if x.doc_id == 1).ids_crc32 == zlib.crc32(want.tobytes())


def test_token_counts_stitch_blocks(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, *[f"doc {i} " * (i % 30) for i in range(60)]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from quarry.session import scratch_path
    folder = scratch_path(spark, "flat-test")
    manifest = token_counts.write_flat(df, folder, VOCAB, 50256, block_ids=17)
    counts = token_counts.separator_scan(spark, folder, 50256)
    got = {r.doc_id: r for r in manifest.join(counts, ["stream", "ordinal"]).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].n_tokens == len(TOK.encode(t or "", add_special_tokens=False).ids) and got[i].terminated


def test_token_counts_tail_without_separator(spark):
    from quarry.llm.shared_files import new_file
    from quarry.session import scratch_path
    folder = scratch_path(spark, "flat-tail")
    blocks = {(0, 0): [1, 2, 9], (0, 1): [3, 4, 5], (0, 2): [6, 9, 9, 7], (1, 0): [8, 8]}
    for (a, b), ids in blocks.items():
        with new_file(f"{folder}/stream-{a:06d}-{b:06d}.ids") as out:
            out.write(np.array(ids, "<u2").tobytes())
    got = sorted((r.stream, r.ordinal, r.start, r.n_tokens, r.terminated) for r in token_counts.separator_scan(spark, folder, 9).collect())
    assert got == [(0, 0, 0, 2, True), (0, 1, 3, 4, True), (0, 2, 8, 0, True), (0, 3, 9, 1, False), (1, 0, 0, 2, False)]


def test_token_counts_defined_cases(spark):
    schema = "doc_id string, text string, stream string"
    assert token_counts.token_counts(spark.createDataFrame([], schema), VOCAB, 50256).count() == 0
    rows = token_counts.token_counts(spark.createDataFrame([("a", None, "s"), ("a", "x y", "s"), (None, "", "s")], schema), VOCAB, 50256)
    assert sorted((r.doc_id or "", r.n_tokens) for r in rows.collect()) == [("", 0), ("a", 0), ("a", 2)]
