"""Units: what is found, and edge cases."""

import pytest

from labloom.operators import units
from labloom.operators.units import alias_dictionary, another, other_units, recorded_units, unit_distance

RULES = [("A", ["umol/L", "mg/dL", "mg/L"], "umol/L", 100.0), ("E", ["U/L", "kU/L"], "U/L", None), ("H", ["m[IU]/L", "[IU]/L"], "m[IU]/L", None), ("W", ["10*9/L", "/uL"], "10*9/L", None)]
DIM = [("umol/L", "molar", 1e-6), ("mg/dL", "mass", 0.01), ("mg/L", "mass", 0.001), ("U/L", "act", 1.0), ("kU/L", "act", 1000.0), ("m[IU]/L", "arb", 0.001), ("[IU]/L", "arb", 1.0), ("10*9/L", "count", 1e9), ("/uL", "count", 1e6)]
SCHEMA = "id string, accepted_analyte_code string, raw_unit_string string, raw_value_string string, raw_text string, raw_reference_range string, value string, codes int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(RULES, "candidate_code string, expected_ucum_units array<string>, canonical_unit_ucum string, molar_weight double"), spark.createDataFrame(DIM, "ucum_code string, kind string, factor_to_base double")


def run(spark, tables, *rows):
    df = spark.createDataFrame([(str(i), *r, "clash", 1) for i, r in enumerate(rows)], SCHEMA)
    return {r.observation_id: r for r in recorded_units(df, *tables).collect()}


def test_places_and_spellings(spark, tables):
    got = run(
        spark,
        tables,
        ("A", "mg/dL", "1.5", None, None),
        ("A", None, "2,5 milligrams per litre", None, None),
        ("A", None, "12", "label 12 H MG/DL 3 - 4", "3 - 4"),
        ("A", None, "12", "label 3 - 4 mg per dL (x) 12", "3 - 4 mg per dL (x)"),
        ("A", "milligrms per decilitre", "1", None, None),
        ("E", "IU/L", "5", None, None),
        ("H", "IU/L", "5", None, None),
        ("W", "x10^9/L", "5", None, None),
        ("A", "score", "5", None, None),
        ("A", None, "5", "x 5", None),
        ("A", "µmol/L", "Trace", None, None),
    )
    want = ["mg/dL", "mg/L", "mg/dL", "mg/dL", "mg/dL", "U/L", "[IU]/L", "10*9/L", None, None, "umol/L"]
    assert [got[str(i)].recorded_unit for i in range(len(want))] == want
    assert got["0"].canonical_value == pytest.approx(150.0) and got["6"].canonical_value == pytest.approx(5000.0)
    assert got["10"].value is None and got["10"].canonical_value is None


def test_spaces_within_units_of_a_line(spark, tables):
    got = run(spark, tables, ("A", None, "12", "label | 12 L | mg / dL | 3 - 4", "3 - 4"), ("A", None, "12", "label 12 mg/100 mL", None), ("A", None, "12", "label 12 3 - 4 mg/100 mL (x y)", "3 - 4 mg/100 mL (x y)"), ("E", None, "7", "label 7 L U / L", None))
    assert [got[str(i)].recorded_unit for i in range(4)] == ["mg/dL", "mg/dL", "mg/dL", "U/L"]


def test_edges(spark, tables):
    got = run(spark, tables, (None, "mg/dL", "1", None, None), ("Z", "mg/dL", "1", None, None), ("A", None, None, None, None), ("A", "", "", "", ""), ("A", "mg/dL", "1", None, None))
    assert set(got) == {"2", "3", "4"}
    empty = spark.createDataFrame([], SCHEMA)
    assert recorded_units(empty, *tables).count() == 0
    assert other_units(empty, *tables).count() == 0
    assert recorded_units(empty, tables[0].limit(0), tables[1].limit(0)).count() == 0
    twice = spark.createDataFrame([("1", "A", "mg/dL", "1", None, None, "c", 1)] * 2, SCHEMA)
    assert other_units(twice, *tables).count() == 2


def test_dictionary_is_strict_on_short_symbols(spark):
    d = {r.key: [c.code for c in r.codes] for r in alias_dictionary(spark, spark.createDataFrame([("ug/l",), ("mgl",), ("mg/l",), ("nanogramms/l",), ("x" * 5000,)], "key string"), ["ug/L", "mg/L", "ng/L"]).collect()}
    assert d["ug/l"][0] == "ug/L" and d["mg/l"][0] == "mg/L"
    assert d["nanogramms/l"][0] == "ng/L" and "x" * 5000 not in d


def test_misread_short_symbols(spark, tables):
    misread = [("A", "mg/d1", "mg/dL"), ("A", "umo/L", "umol/L"), ("A", "umol/I", "umol/L"), ("E", "U/1", "U/L"), ("A", "umoll/L", "umol/L")]
    others = [("A", k) for k in ("mg/d", "ug/dL", "umol/g", "umol/d", "mumol/L", "mol/L", "ng/mL", "mg/kg", "mgl")] + [("E", "AU/L"), ("E", "U/g"), ("E", "1/L"), ("W", "10^8/L")]
    got = run(spark, tables, *[(a, u, "5", None, None) for a, u, _ in misread], *[(a, u, "5", None, None) for a, u in others])
    assert [got[str(i)].recorded_unit for i in range(len(got))] == [w for _, _, w in misread] + [None] * len(others)


def test_too_many_units_raise(spark, tables):
    many = spark.range(10_001).selectExpr("concat('u', id) as ucum_code", "'mass' as kind", "1.0D as factor_to_base")
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        recorded_units(rows, tables[0], many)



MISTYPED = [("A", "mq/dl", "mg/dL"), ("A", "mgd/l", "mg/dL"), ("A", "umo/l", "umol/L"), ("A", "umoi/l", "umol/L"), ("A", "umo1/l", "umol/L"), ("A", "umoll", "umol/L"), ("E", "u/ll", "U/L"), ("E", "iu/ll", "U/L"), ("A", "mgs per deciliters", "mg/dL"), ("A", "micro-moles per liter", "umol/L"), ("E", "enzyrne units/litre", "U/L")]


def test_mistyped_units_are_mapped_by_likeness(spark, tables):
    got = run(spark, tables, *[(a, u, "5", None, None) for a, u, _ in MISTYPED])
    assert [got[str(i)].recorded_unit for i in range(len(got))] == [w for _, _, w in MISTYPED]


def test_likeness_decides(spark, tables, monkeypatch):
    """Without the n-gram index and its distance the mistyped units are lost, and the plurals with them."""
    monkeypatch.setattr(units, "allowed", lambda length: -1.0)
    got = run(spark, tables, *[(a, u, "5", None, None) for a, u, _ in MISTYPED], ("A", "milligrams per litre", "5", None, None), ("A", "milligram per litre", "5", None, None))
    assert [got[str(i)].recorded_unit for i in range(len(got))] == [None] * (len(MISTYPED) + 1) + ["mg/L"]


def test_distance_is_weighted():
    assert unit_distance("mg/dl", "mg/dl") == 0 and unit_distance("mgs/dl", "mg/dl") == 0.25 == unit_distance("mq/dl", "mg/dl") and unit_distance("mgd/l", "mg/dl") == 0.5
    assert unit_distance("milligram/litre", "microgram/litre") > 2 and unit_distance("picogram/litre", "microgram/litre") > 2 and unit_distance("10^8/l", "10^9/l") > 2
    assert unit_distance("", "mg") > 2 and unit_distance("mg", "") > 2
    assert not another("grams/l", "gram/l") and another("ug/dl", "mg/dl") and not another("mgd/l", "mg/dl")


def test_a_long_dictionary_is_not_broadcast(spark, tables, monkeypatch):
    rows = [("A", u, "5", None, None) for _, u, _ in MISTYPED] * 3 + [("A", None, "5", None, None)] * 5
    want = run(spark, tables, *rows)
    monkeypatch.setattr(units, "MOST_BROADCAST", 0)
    assert run(spark, tables, *rows) == want
