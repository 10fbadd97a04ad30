import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumflow.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_odd_texts(library):
    for x in ["a" * 5000, "=-" * 2000, " " * 900 + "x", "<|endoftext|>", "\x00\x01", "日本語" * 300, "don't\r\n\t I'LL ", "👩‍💻🏳️‍🌈", "ab" * 3000, "ﬁ é"]:
        assert T.encoder().encode(x) == library(x), x[:20]
    assert T.encoder().encode(None) == T.encoder().encode("") == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab cdeing-_0'\n", max_size=200))
def test_any_text(text):
    from tokenizers import Tokenizer

    global _lib
    try:
        lib = _lib
    except NameError:
        lib = _lib = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
        lib.encode_special_tokens = True
    assert T.encoder().encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_in_spark(spark, library):
    rows = [(1, "hello world", 5), (2, None, 5), (3, "", 5), (1, "hello world", 5)]
    got = [(r.id, r.ids) for r in T.encode_texts(spark.createDataFrame(rows, "id bigint, t string, ids int"), "id", "t").orderBy("id").collect()]
    assert got == [(1, library("hello world")), (1, library("hello world")), (2, []), (3, [])]
