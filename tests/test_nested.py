"""Nested records against a parser that walks, and the grammar bitmaps against json."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from labloom.operators.nested import Index, node_rows, pack_columns, pack_rows, pack_tables

PACK = {
    "benchmark_id": "b1", "contract_version": "pack-v1", "lineage": {"id": "l1", "rule_pack_version": "r8", "mapping_threshold_config": {"default": "0.8", "overrides": {"A": 0.7, "B": None}}},
    "artifact_refs": {"patient_artifact": "/p", "job_status": None}, "metrics": {"m_ms": 3, "n": None}, "reports": {"r.json": {"payload": {"status": "ok", "checks": [{"metric": "x", "observed": 1, "baseline": 2, "history": [{"at": "t"}]}]}}},
}
LISTED = {
    "benchmark_id": "b1", "contract_version": "pack-v1", "lineage": {"id": "l1", "rule_pack_version": "r8", "mapping_threshold_config": {"default": "0.8", "overrides": [{"candidate_code": "A", "threshold": 0.7}, {"candidate_code": "B", "threshold": None}]}},
    "artifact_refs": [{"kind": "patient_artifact", "href": "/p"}, {"kind": "job_status", "href": None}], "metrics": [{"name": "m_ms", "value": 3}, {"name": "n", "value": None}],
    "reports": [{"report_name": "r.json", "payload": {"status": "ok", "checks": [{"metric": "x", "observed": 1, "baseline": 2}]}}],
}
WANT = [("pack", "", "b1"), ("lineage", "b1", "l1"), ("threshold", "l1", "default"), ("threshold", "l1", "A"), ("artifact_ref", "b1", "patient_artifact"), ("metric", "b1", "m_ms"), ("report", "b1", "r.json"), ("check", "r.json", "x")]


def flatten(texts):
    """(place in texts, pack_ord, child, parent_key, child_key, attributes) of every row."""
    rows = []
    for t in pack_columns(texts):
        columns = [t[c].tolist() if hasattr(t[c], "tolist") else t[c].to_pylist() for c in ("place", "pack_ord", "child", "parent_key", "child_key", "attributes")]
        rows += zip(*columns, strict=True)
    return rows


@pytest.mark.parametrize("shape", [lambda p: p, lambda p: [p], lambda p: {"proof_packs": [p]}, lambda p: {"envelope": {"sent": "x", "proof_pack": p}}, lambda p: json.dumps(p), lambda p: json.dumps([p])])
@pytest.mark.parametrize("pack", [PACK, LISTED])
def test_shapes(shape, pack):
    rows = flatten([json.dumps(shape(pack)).encode()])
    assert sorted(r[2:5] for r in rows) == sorted(WANT)
    assert {r[1] for r in rows} == {0}


def test_order_and_links():
    rows = flatten([json.dumps([PACK, None, LISTED | {"benchmark_id": "b2"}]).encode()])
    assert sorted({(r[1], r[4]) for r in rows if r[2] == "pack"}) == [(0, "b1"), (2, "b2")]


def test_not_whole():
    whole = json.dumps(PACK)
    for cut in (whole[:-1], whole[: len(whole) // 2], whole + "}", whole.replace(":", "", 1), "", " ", "nul", '{"benchmark_id": "x",}'):
        assert flatten([cut.encode()]) == []
    assert flatten([]) == []


def test_absent_and_odd():
    for p in ({"benchmark_id": None}, {"benchmark_id": "b", "lineage": None, "metrics": [], "reports": {}, "artifact_refs": None}, {"benchmark_id": "b", "metrics": [1, None, "x"], "lineage": {"id": None}}):
        assert len(flatten([json.dumps(p).encode()])) == (p["benchmark_id"] is not None)
    assert [r[4] for r in flatten([b'{"benchmark_id":"a\\u00e9\\"b","benchmark_id":"last"}'])] == ["last"]


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(values, st.lists(st.tuples(st.integers(0, 400), st.sampled_from(list('{}[]:,"\\1a \n\t-.tnu') + [""])), max_size=3), st.booleans())
def test_same_verdict_as_json(value, edits, ascii_only):
    text = json.dumps(value, ensure_ascii=ascii_only)
    for place, char in edits:
        text = text[: place % (len(text) + 1)] + char + text[place % (len(text) + 1) + (char == "") :]
    try:
        json.loads(text, parse_constant=lambda _: 1 / 0)
        ok = True
    except (ValueError, ZeroDivisionError):
        ok = False
    try:
        raw = text.encode()
    except UnicodeEncodeError:
        return
    got = Index([b"[1]", raw, b'{"a":1}'])
    assert got.ok.tolist() == [True, ok, True]


def test_frame(spark):
    rows = [(1, json.dumps(PACK), "x", "y"), (2, None, "x", "y"), (3, "{", "x", "y"), (4, json.dumps(PACK), None, None)]
    df = spark.createDataFrame(rows, "record_id bigint, payload string, child string, attributes string")
    got = pack_rows(df)
    assert got.groupBy("record_id").count().orderBy("record_id").collect() == [(1, 8), (4, 8)]
    t = pack_tables(df)
    assert t["lineage"].where("record_id = 1").first()["rule_pack_version"] == "r8"
    assert t["thresholds"].where("record_id = 1").agg(F.sum("threshold")).first()[0] == 1.5
    assert t["artifact_refs"].where("record_id = 1").first()["href"] == "/p"
    assert pack_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("layers", [0, 1, 4, 5, 6, 7, 9])
def test_any_number_of_string_layers(layers):
    text = json.dumps({"benchmark_id": "b", "lineage": {"id": "l"}})
    for _ in range(layers):
        text = json.dumps(text)
    assert sorted(r[2:5] for r in flatten([b"null", text.encode(), b'"["'])) == [("lineage", "b", "l"), ("pack", "", "b")]


def test_deep_and_long():
    deep = b"[" * 50_000 + json.dumps(PACK).encode() + b"]" * 50_000
    assert sorted(r[2:5] for r in flatten([deep])) == sorted(WANT)
    many = json.dumps([PACK | {"benchmark_id": f"b{i}"} for i in range(2000)]).encode()
    assert len(flatten([many])) == 8 * 2000


def test_attributes():
    rows = {r[2:5]: dict(r[5]) for r in flatten([json.dumps(PACK).encode(), b'{"benchmark_id":"x","a":1,"a":"\\u00e9","n":null,"o":{}}'])}
    assert rows["threshold", "l1", "default"] == {"value": "0.8"} and rows["lineage", "b1", "l1"] == {"id": "l1", "rule_pack_version": "r8"}
    assert rows["check", "r.json", "x"] == {"metric": "x", "observed": "1", "baseline": "2"} and rows["pack", "", "x"] == {"benchmark_id": "x", "a": "é"}


def test_packs_of_two_lists_are_told_apart(spark):
    both = json.dumps({"one": [{"benchmark_id": "b", "metrics": {"m": 1}}], "two": [{"benchmark_id": "b", "metrics": {"n": 1}}]})
    got = pack_rows(spark.createDataFrame([(1, both)], "record_id bigint, payload string"), attributes=False)
    assert sorted(map(tuple, got.select("pack_ord", "pack_no", "child_key").collect())) == [(0, 0, "b"), (0, 0, "m"), (0, 1, "b"), (0, 1, "n")]


def walked(value, node=0, parent=None, key=None, place=0):
    """node_rows by recursion: rows and the next free number."""
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "string" if isinstance(value, str) else "scalar"
    rows, at = [(node, parent, key, place, kind, value if kind == "string" else None if kind in ("object", "array") or value is None else json.dumps(value))], node + 1
    for i, (k, v) in enumerate(value.items() if kind == "object" else [(None, v) for v in value] if kind == "array" else ()):
        more, at = walked(v, at, node, k, i)
        rows += more
    return rows, at


def test_nodes(spark):
    good = [PACK, LISTED, [], {}, "x\n\"é", 1.5, None, [[], [None, {"": {"a\\": [True]}}]]]
    data = [(i, json.dumps(v)) for i, v in enumerate(good)] + [(100, None), (101, "{"), (102, ""), (103, json.dumps(PACK)[:-1])]
    df = spark.createDataFrame([(*d, "clash") for d in data], "record_id bigint, payload string, node string")
    got = {}
    for r in node_rows(df).orderBy("record_id", "node").collect():
        got.setdefault(r[0], []).append(tuple(r[1:]))
    assert got == {i: walked(v)[0] for i, v in enumerate(good)}
    assert node_rows(df.limit(0)).count() == 0
