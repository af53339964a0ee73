import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaflow.llm import tokenizer as K

pytestmark = pytest.mark.skipif(not os.path.isfile(K.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def codec():
    return K.Codec(K.model_of())


@pytest.fixture(scope="module")
def other():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.VOCABULARY, "rb"))}
    return tiktoken.Encoding("other", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  \n", "a", "Hello  world's   end\r\n\tx", "µm 3.4–5.6 × café café", "水生菌 孢子 🍄‍🟫", "  ﻿", "<|endoftext|>", "0" * 500, "ab" * 3000, "\x00\x01\x7f", "don't DON'T '", "▁▁ x"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_another_library(codec, other, text):
    ids = codec.encode(text)
    assert ids == other.encode_ordinary(text) and codec.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, other, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = codec.encode(text)
    assert ids == other.encode_ordinary(text) and codec.decode(ids) == text


def test_table(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "two words", "c"), (3, "two words", "c")], "doc_id long, text string, decoded string")
    got = K.decode(K.encode(df.drop("decoded"))).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got][:2] == [[], []] and got[2].ids == got[3].ids and [r.decoded for r in got] == ["", "", "two words", "two words"]
    assert K.encode(df.limit(0).drop("decoded")).count() == 0
