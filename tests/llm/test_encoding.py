"""Encoding against the vocabulary's own library, and its round trip."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitewise.llm import bpe_fst, encoding
from sitewise.llm.encoding_queries import QUERIES
from sitewise.session import table

FST = bpe_fst.Transducer(bpe_fst.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_fst.default_vocabulary())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


CASES = [
    "", " ", "\n\n  \t", "<|endoftext|> as text", "a" * 30_000, "ab" * 9_000 + "!" * 5_000, "it's we'RE they'll  I'd", "中文字符，测试" * 400, "🙂👍🏽❤️‍🩹", "é́​﻿", "\x00\x01\x7f", "١٢٣ ２３ ½", "Ω≈ç√∫˜µ", "def f(x):\n    return x**2  # ok", "     indented\n\n\n", "ZZZZzzzz" * 3000,
]


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_equals_library(library, text):
    ids = FST.encode(text)
    assert ids == library(text)
    assert bpe_fst.decode(FST, ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    if not hasattr(test_any_text, "lib"):
        test_any_text.lib = Tokenizer.from_file(bpe_fst.default_vocabulary())
        test_any_text.lib.encode_special_tokens = True
    ids = FST.encode(text)
    assert ids == test_any_text.lib.encode(text, add_special_tokens=False).ids
    assert bpe_fst.decode(FST, ids) == text


def test_forgetting_states_changes_nothing(library):
    small = bpe_fst.Transducer(bpe_fst.default_vocabulary(), max_states=50)
    for text in CASES:
        assert small.encode(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 7))
def test_utf8_stream_in_pieces(data, step):
    s = bpe_fst.Utf8Stream()
    got = "".join([*(s.feed(data[i : i + step]) for i in range(0, len(data), step)), s.finish()])
    assert got == data.decode("utf-8", "replace")


def test_tables(spark, small):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "y"), (3, "", None), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encoding.encode(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, FST.encode("hello world"))] * 2 + [(2, []), (3, []), (None, FST.encode("a"))], key=str)
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0
    assert encoding.token_counts(df, ["doc_id"], "text").agg(F.sum("n_tokens")).first()[0] == 5


def test_whole_corpus(spark, small, library):
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    for r in QUERIES["p6_ids"](spark, small).collect():
        assert r.ids == (library(docs[r.doc_id]) if docs[r.doc_id] else [])
    assert all(r.same for r in QUERIES["p6_round_trip"](spark, small).collect())
