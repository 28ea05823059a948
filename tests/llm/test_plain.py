"""Plain form, case by case and by its properties."""

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from labloom.llm.plain import changed_fields, connect, plain_fields, plain_query, to_plain

QUERY = plain_query()
CON = connect()


def plain(*texts):
    return to_plain(CON, [pa.array(texts, pa.string())], QUERY)[0].to_pylist()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｆｅｒｒｉｔｉｎ", "Ferritin"), ("ﬁbrin", "fibrin"), ("Plasmático", "Plasmático"), ("x​y⁠﻿\xadz", "xyz"), ("a\xa0b c　d", "a b c d"),
        ("Urеa", "Urea"), ("СОРР", "COPP"), ("Α-amylase", "A-amylase"), ("10.8 Η umol/l", "10.8 H umol/l"), ("Ｐｌａｓｍａ́", "Plasmá"), ("еá", "eá"), ("С反应蛋白", "C反应蛋白"),
        ("й", "й"), ("", ""), (None, None), ("plain - text", "plain - text"),
    ],
)
def test_brought_into_form(text, want):
    assert plain(text) == [want]


@pytest.mark.parametrize("text", ["Élevé", "Результат прилагается", "ТРОМБОЦИТЫ", "铁蛋白", "α-amylase", "β-carotene", "γ-glutamyl", "35.0 – 50 ≥ 3", "œstradiol", "кальцидіол"])
def test_in_form_already(text):
    assert plain(text) == [text]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=20), max_size=5))
def test_once_is_enough(texts):
    once = plain(*texts)
    assert plain(*once) == once
    assert all(unicodedata.normalize("NFC", t) == t for t in once)


def test_frame(spark):
    rows = [("1", "Ｆｅ", None, "ok", "x"), ("1", "Ｆｅ", None, "ok", "x"), ("2", None, None, None, None), ("3", "", "a\xa0b", "y" * 100_000 + "​", "z")]
    df = spark.createDataFrame(rows, "id string, a string, b string, c string, f0 string")
    got = sorted(map(tuple, changed_fields(df, ["a", "b", "c"]).collect()))
    assert got == [("1", "a"), ("1", "a"), ("3", "b"), ("3", "c")]
    p = {r.id: r for r in plain_fields(df, ["a", "b", "c"]).collect()}
    assert p["3"].c == "y" * 100_000 and p["2"].changed_fields == [] and p["3"].b == "a b"
    assert changed_fields(df.limit(0), ["a"]).count() == 0
