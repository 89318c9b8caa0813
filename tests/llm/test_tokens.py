import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from moraine.llm import bpe, token_counts
from moraine.llm.common import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
TEXTS = st.lists(st.sampled_from(["a", "ab", " ", "  ", "\n", "\t", "the", "'st", "é", "ÀB", "́", "\xa0", "　", "\x1c", "\x85", "日本", "12", "!?", "<|endoftext|>", "<|startoftext|>", "İ", "Σ"]), max_size=60).map("".join)
SPECIAL_ROWS = [(1, None), (2, ""), (3, "  \n"), (4, "x <|endoftext|>  y"), (4, "x <|endoftext|>  y"), (None, "null id"), (5, "word " * 3000), (6, "z" * 30000), (7, "\x00 a")]


@pytest.fixture(scope="module")
def small_codec():
    return bpe.WordBpe(WORD, long_run=12, leaf=6, memo=200)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_codec_equals_library(small_codec, word, text):
    ids, decoded = small_codec.encode(text)
    want = word.encode(text, add_special_tokens=False).ids
    assert list(memoryview(ids).cast("I")) == want
    assert decoded.decode() == word.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeht", min_size=1, max_size=400))
def test_tree_concatenation_equals_library(small_codec, word, run):
    assert small_codec.tree.encode(run) == word.encode(run, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_equal_library(text):
    assert token_counts._pieces(BYTE).count([text]) == [len(Tokenizer_kept().encode(text, add_special_tokens=False).ids)]


def Tokenizer_kept(kept=[]):
    if not kept:
        kept.append(Tokenizer.from_file(BYTE))
    return kept[0]


def test_count_rows(spark, sf_small):
    docs = spark.createDataFrame(SPECIAL_ROWS, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "'x' as ids", "2 as n_bytes")
    got = sorted(map(tuple, token_counts.token_counts(docs, BYTE).collect()), key=repr)
    n = [len(Tokenizer_kept().encode(t or "", add_special_tokens=False).ids) for _, t in SPECIAL_ROWS]
    assert got == sorted([(d, len((t or "").encode()), k, k > 512) for (d, t), k in zip(SPECIAL_ROWS, n)], key=repr)
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in token_counts.op1_token_counts(spark, sf_small).collect():
        assert r.n_tokens == len(Tokenizer_kept().encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_codec_rows(spark, word, sf_small):
    docs = spark.createDataFrame(SPECIAL_ROWS, "doc_id bigint, text string")

    def want(d, t):
        ids = word.encode(t or "", add_special_tokens=False).ids
        decoded = word.decode(ids, skip_special_tokens=False)
        return d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    assert sorted(map(tuple, bpe.encode_documents(docs, WORD).collect()), key=repr) == sorted((want(d, t) for d, t in SPECIAL_ROWS), key=repr)
    assert bpe.encode_documents(docs.limit(0), WORD).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in bpe.op7_bpe_codec(spark, sf_small).collect():
        assert tuple(r) == want(r.doc_id, texts[r.doc_id])
