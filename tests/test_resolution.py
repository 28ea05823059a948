"""Resolution, normalization, history, evidence and admitted rows on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from labloom.functions import lab
from labloom.operators import evidence as ev, resolution, routes
from labloom.sources import readers, writers

NAMES = [("GLU-1", "glucose", 1, ["mg/dl"], "glucose"), ("GLU-2", "glucose", 2, ["mmol/l"], "glucose"), ("HB", "hemoglobin", 3, [], "hemoglobin"), ("HB", "hemoglobin", 3, [], "red pigment"), ("X1", "first", 4, [], "shared word"), ("X2", "second", 5, [], "word shared"), ("X3", "third", 6, [], "hemoglobin")]


@pytest.fixture(scope="module")
def names(spark):
    df = spark.createDataFrame(NAMES, "candidate_code string, canonical_label string, ordinal int, expected_ucum_units array<string>, alias string")
    return df.withColumn("k", lab.label_key(F.col("alias")))


def test_resolve(spark, names):
    cases = [
        ("Glucose", "mg/dL", "GLU-1", None), ("glucose", " MMOL/L ", "GLU-2", None), ("glucose", None, None, "unit_required"), ("glucose", "", None, "unit_required"), ("glucose", "g/l", None, "unit_mismatch"),
        ("hemoglobin", None, "HB", None), ("pigment red", "x", "HB", None), ("word of nothing", None, None, "unsupported_alias"), ("", None, None, None), (None, None, None, None), ("serum", "x", None, None),
        ("shared word", None, "X1", None), ("word  shared", None, "X2", None), ("x" * 50_000, "y" * 50_000, None, "unsupported_alias"),
    ]
    df = spark.createDataFrame([(i, *c[:2], "clash") for i, c in enumerate(cases)], "id int, raw_analyte_label string, raw_unit_string string, reason2 string")
    got = {r.id: (r.candidate_code, r.reason) for r in resolution.resolve(df, names, F.col("raw_analyte_label"), F.col("raw_unit_string")).collect()}
    assert got == {i: c[2:] for i, c in enumerate(cases)}
    assert resolution.resolve(df.limit(0), names, F.col("raw_analyte_label"), F.col("raw_unit_string")).count() == 0
    none = resolution.resolve(df, names.limit(0), F.col("raw_analyte_label"), F.col("raw_unit_string"))
    assert none.where("candidate_code is not null").count() == 0 and none.count() == len(cases)


def test_ambiguous_words(spark, names):
    two = names.where("candidate_code in ('X1', 'X2')").withColumn("k", F.concat(F.lit("a "), "k"))
    df = spark.createDataFrame([(1, "word a shared", None)], "id int, l string, u string")
    assert resolution.resolve(df, two, F.col("l"), F.col("u")).first()["reason"] == "ambiguous_tokens"


def test_normalize(spark, names):
    rows = [
        (1, 0.89, "hemoglobin", "12 g/dL", 12.0, "g/dl"), (2, 0.9, "hemoglobin", "1.2.3", None, "g/dl"), (3, None, "hemoglobin", "Negative", None, "g/dl"), (4, 1.0, "zzz", "5", None, "fL"), (5, 1.0, "word shared", "5", 5.0, "mg/g creat"), (6, 1.0, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, extraction_confidence double, raw_analyte_label string, raw_value_string string, parsed_numeric_value double, raw_unit_string string")
    metrics = spark.createDataFrame([("HB", True, "adult"), ("X2", True, None)], "candidate_code string, numeric boolean, profile_id string")
    got = {r.id: tuple(r[1:]) for r in resolution.normalize(df, names, metrics).collect()}
    assert got == {
        1: ("unsupported", None, "low_extraction_confidence", None, None, None, None), 2: ("supported", "HB", "", 1.23, "adult", 1.23, "g/dL"), 3: ("partial", "HB", "missing_numeric_value", None, None, None, None),
        4: ("unsupported", None, "unsupported_alias", 5.0, None, 5.0, "fL"), 5: ("supported", "X2", "unresolved_reference_profile", 5.0, None, 5.0, "mg/g creat"), 6: ("unsupported", None, "", None, None, None, None),
    }


def test_comparable(spark):
    at = lambda n: dt.datetime(2025, 1, n)
    o = [
        ("a", "j1", at(1), "supported", 1.0, "mg", "s", None, "C", "d", "l"), ("b", "j2", at(2), "supported", 2.0, "mg", "s", None, "C", "d", "l"), ("c", "j2", at(3), "supported", 3.0, "g", "s", None, "C", "d", "l"),
        ("d", "j3", at(4), "unsupported", 4.0, "mg", "s", None, "C", "d", "l"), ("e", "j4", at(5), "unsupported", None, None, "s", None, "C", "d", "l"), ("f", "j5", at(6), "supported", 9.0, "mg", None, None, None, "d", "l"),
        ("g", "j6", at(7), "supported", 9.0, "mg", None, None, None, None, "l"), ("h", None, at(8), "supported", 1.0, "mg", "s", "m", None, " ", None),
    ]
    df = spark.createDataFrame(o, "id string, job_id string, created_at timestamp, support_state string, canonical_value double, canonical_unit string, specimen_context string, method_context string, accepted_analyte_code string, accepted_analyte_display string, raw_analyte_label string").withColumn("parsed_numeric_value", F.lit(None).cast("double"))
    got = {r.id: r.previous_id for r in resolution.comparable(df).collect()}
    # units and specimens must agree; without a unit any does; the latest of another job counts, unsupported ones don't; display, then label stand in for a code
    assert got == {"a": "b", "b": "a", "c": None, "d": "b", "e": "c", "f": None, "g": "f", "h": None}
    assert resolution.comparable(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "suppressed", "heading"),
    [("Risk: see the note", True, False), ("Glucose 5.6 mg/dL at risk", False, False), ("LIPID PANEL", False, True), ("electrolytes today", False, True), ("Electrolytes 5", False, False), ("Sodium", False, False), ("", False, False), (None, False, False), ("et al 2001", True, False), ("中文", False, False)],
)
def test_evidence(spark, text, suppressed, heading):
    r = spark.createDataFrame([(text,)], "t string").select(ev.suppressed_before_parsing(ev.compact(F.col("t"))).alias("s"), ev.heading_only(F.col("t")).alias("h"), ev.result_like(ev.compact(F.col("t")), F.lit(0.0)).alias("r")).first()
    assert (r.s, r.h) == (suppressed, heading) and r.r in (True, False)


def test_arbitration(spark):
    rows = [("very high risk", "1", None, None, None, "threshold_shadow"), ("very high risk", "1", 1.0, "mg", "1-2", None), ("", None, None, None, None, "label_noise"), ("ab", "", None, None, None, "label_noise"), ("abc", "", None, None, None, None), ("x " * 49, "1", None, None, None, "giant_hybrid_row"), (None, "1", 1.0, None, None, None)]
    df = spark.createDataFrame(rows, "t string, v string, n double, u string, r string, want string")
    assert df.where(~ev.arbitration(*[F.col(c) for c in "tvnur"]).eqNullSafe(F.col("want"))).count() == 0


def test_admitted(spark):
    rows = [(1, "k", "x"), (2, "k", "y"), (3, None, "z"), (4, "m", None), (5, None, None), (2, "k", "y")]
    good, bad = writers.admitted(spark.createDataFrame(rows, "i int, k string, v string"), ["k"], ["v"], ["i"])
    assert sorted(r.i for r in good.collect()) == [1, 3] and sorted((r.i, r.reject) for r in bad.collect()) == [(2, "duplicate_key"), (2, "duplicate_key"), (4, "null:v"), (5, "null:v")]


def test_uploads_without_extension_are_rejected(spark):
    files = spark.createDataFrame([("a/noext", bytearray(b"x"), 1, ""), ("a/b.pdf", bytearray(b"%PDF-1"), 6, "application/pdf"), ("a/c.pdf", bytearray(b"x"), 1, "text/plain"), ("a/.png", bytearray(b"x"), 1, None)], "path string, content binary, length long, mime_type string")
    got = {r.path: (r.lane_type, r.reject) for r in readers.classify_uploads(files).collect()}
    assert got["a/noext"] == (None, "unsupported_extension:missing") and got["a/b.pdf"] == ("trusted_pdf", None) and got["a/c.pdf"] == (None, "mime_type_mismatch:.pdf:text/plain")


def test_debug_dump_needs_both_gates(spark, tmp_path):
    df = spark.createDataFrame([(1, "f")], "i int, feed string")
    assert not writers.debug_dump(df, str(tmp_path / "d"), "feed", debug=True, allowed=False) and not (tmp_path / "d").exists()
    assert writers.debug_dump(df, str(tmp_path / "d"), "feed", debug=True, allowed=True) and (tmp_path / "d").exists()


def test_every_route_is_reached(spark):
    base = {"lab": 0, "summary": 0, "non_lab": 0, "composite": 0, "high": 0, "admin": 0, "health": 0, "extension": ".pdf", "pages": 2, "density": 0.1, "extractability": 0.9, "has_text": True, "has_image": False, "chars": 1000, "protected": False, "corrupt": False}
    scanned = {"has_text": False, "has_image": True, "chars": 10}
    changes = [
        {"protected": True, "corrupt": True}, {"pages": 0}, {"non_lab": 3, "lab": 2, "summary": 1}, {"summary": 2, "lab": 1}, {"summary": 2, "lab": 2, "health": 1, "pages": 10}, {"lab": 2, "high": 1, **scanned}, {"lab": 2, "composite": 2},
        {"extension": ".png"}, {"chars": 0, "has_text": False}, {"lab": 1, **scanned}, {"lab": 1}, scanned, {}, {"chars": 10},
    ]
    rows = [(i, *(base | c).values()) for i, c in enumerate(changes)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int'}" for k, v in base.items()))
    got = {r.i: (r.lane, r.document_class, r.reason) for r in routes.decided(df).collect()}
    assert got == {i: (d[0], d[1], d[4]) for i, d in enumerate(routes.DECISIONS)}
    conf = {r.i: r.confidence for r in routes.decided(df).collect()}
    assert conf[0] == 1.0 and conf[2] == 0.5 and conf[7] == 0.95 and conf[8] == 0.0 and conf[6] == 1.0


def test_route_scores(spark):
    df = spark.createDataFrame([(1, "Glucose  RESULT"), (1, "clinical\nsummary"), (1, None), (2, "")], "d int, t string")
    got = {r.d: (r.lab, r.summary, r.admin) for r in routes.scores(df, "d", "t").collect()}
    assert got == {1: (2, 1, 0), 2: (0, 0, 0)}


def test_block_routes(spark):
    cases = [
        ("Glucose 5.6 mmol/L", "parsed"), ("", "empty"), (None, "empty"), ("risk guideline", "excluded:ambiguous_block_classification"), ("very high risk", "excluded:threshold_block"), ("page  2", "excluded:ambiguous_block_classification"),
        ("dob mrn", "excluded:admin_block"), ("clinical history comment", "excluded:narrative_block"), ("page of", "excluded:header_footer_block"), ("hello there", "excluded:unknown_block_non_result"), ("中" * 50_000, "excluded:unknown_block_non_result"),
    ]
    x = ev.compact(F.col("t"))
    got = [r.r for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", ev.block_route(x, ev.role_scores(x), F.lit(0.0)).alias("r")).orderBy("i").collect()]
    assert got == [w for _, w in cases]
