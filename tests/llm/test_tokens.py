"""Tree concatenation against encoding in one go."""

import os

import pytest
from hypothesis import given, settings, strategies as st

from labloom.llm.tokens import TOKENIZER_DIR, encode, join_tree, load_encoder

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no vocabulary files here")
texts = st.text(st.sampled_from("ab 'st\n\tÉ中1,.—<|>") | st.characters(exclude_categories=["Cs"]), max_size=120)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(1, 17))
def test_join_is_exact(text, size):
    e = load_encoder()
    parts = [(text[i : i + size], e.encode_ordinary(text[i : i + size])) for i in range(0, len(text), size)] or [("", [])]
    assert join_tree(e, parts) == (text, e.encode_ordinary(text))


def test_frame(spark):
    e = load_encoder()
    data = ["", None, "a", " ", "x" * 3000, "word " * 2000, "word " * 2000, "no\nspace" * 400, "<|endoftext|> hello", "é" * 999 + " " + "中" * 999, " " * 5000, "a" + " " * 4000 + "b"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(data)] + [(5, data[5], "again")], "doc_id bigint, text string, ids string")
    for piece in (100, 777, 10**6):
        got = {}
        for r in encode(df, piece_chars=piece).collect():
            got.setdefault(r.doc_id, []).append(r.ids)
        assert {k: len(v) for k, v in got.items()} == {i: 1 + (i == 5) for i in range(len(data))}
        assert all(v[0] == (e.encode_ordinary(data[k]) if data[k] else []) for k, v in got.items())
        counts = {r.doc_id: r.n_tokens for r in encode(df, piece_chars=piece, counts=True).collect()}
        assert counts == {k: len(v[0]) for k, v in got.items()}
    assert encode(df.limit(0)).count() == 0
    assert encode(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_same_as_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("Dr. Vaising begs <|endoftext|> pas-\nsenger's £34 8s. 3d. ½", "  two  spaces\n\n", "日本語 テキスト"):
        assert t.encode(text, add_special_tokens=False).ids == load_encoder().encode_ordinary(text)
