"""Golden vectors of the scalar functions and of the grammar."""

import uuid

import pytest
from pyspark.sql import functions as F

from labloom.functions import lab
from labloom.operators import ranges
from labloom.operators.grammar import MeasurementRows, parse, register, rows
from labloom.operators.units import number, spellings


def one(spark, expr, *values, schema="a string"):
    return spark.createDataFrame([values or (None,)], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"), [("5.6", 5.6), ("5,6", 5.6), ("1,234", 1234.0), ("1.234", 1234.0), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("", None), ("abc", None), (None, None)]
)
def test_locale_number(spark, text, want):
    assert one(spark, lab.locale_number(F.col("a")), text)["value"] == want


@pytest.mark.parametrize(("text", "want"), [("< 180 mg/dL", 180.0), ("6,8", 68.0), ("70-99", None), ("1.2.3", 1.23), ("", None), (None, None)])
def test_clean_number(spark, text, want):
    assert one(spark, lab.clean_number(F.col("a")), text) == want


@pytest.mark.parametrize(("text", "want"), [("11 537", 11537.0), ("<14.5", 14.5), ("1,19", 1.19), ("≥ 2 mg", 2.0), ("4.5 10*9/L", 4.5), ("Trace", None), (None, None)])
def test_number_of_a_value(spark, text, want):
    assert one(spark, number(F.col("a")), text) == want


@pytest.mark.parametrize(("text", "want"), [("Glucose 180 mg/dL (70-99)", "70-99"), ("Glucose 180 mg/dL", None), (None, None)])
def test_last_range(spark, text, want):
    assert one(spark, lab.last_range(F.col("a")), text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("HbA1c NGSP %", "hba1c"), ("Total Cholesterol (mg/dL)", "total cholesterol"), ("Sélénium level", "selenium"), ("Hemoglobin A1c", "hba1c"), ("Na (mmol/L)", "na"), ("mg", "mg"), ("", ""), (None, "")],
)
def test_label_key(spark, text, want):
    assert one(spark, lab.label_key(F.col("a")), text) == want


def test_molar(spark):
    f = lambda v, a, b, n: one(spark, lab.molar_convert(F.col("v"), F.col("a"), F.col("b"), F.col("n")), v, a, b, n, schema="v double, a string, b string, n string")
    assert f(180.156, "mg/dL", "mmol/L", "glucose") == 10.0
    assert f(5.0, "mmol/L", "mg/dL", "cholesterol") == 193.325
    assert f(5.0, "mmol/L", "mg/dL", "unobtainium") is None
    assert f(5.0, "%", "%", None) == 5.0


def test_uuid5(spark):
    for name in ("job:1", "", "é" * 50):
        assert one(spark, lab.uuid5(F.col("a")), name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


@pytest.mark.parametrize(("text", "want"), [("(135-145)", (135.0, 145.0)), ("<5.7", (None, 5.7)), ("≥60", (60.0, None)), ("70–99", None), ("normal", None), ("", None), (None, None)])
def test_bounds(spark, text, want):
    got = one(spark, ranges.bounds(F.col("a")), text)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    ("value", "text", "want"),
    [(210.0, "Desirable: <200; Borderline: 200-239; High: >240", "abnormal"), (25.0, "Children : >16; Adult : 20 - 50", "normal"), (5.0, "<200", None), (None, "a: <2; b: >3", None)],
)
def test_band(spark, value, text, want):
    assert one(spark, ranges.band(F.col("v"), F.col("a")), value, text, schema="v double, a string") == want


GOLDEN = [
    ("WBC 02 5.4 x10E3/uL 3.4-10.8", "WBC", 5.4, "x10E3/uL", "3.4-10.8"),
    ("Glucose 115 H 65-99 mg/dL", "Glucose", 115.0, "mg/dL", "65-99 mg/dL"),
    ("Triglycerides 45 <150 mg/dL", "Triglycerides", 45.0, "mg/dL", "<150 mg/dL"),
    ("HDL Cholesterol 81 > OR = 46 mg/dL", "HDL Cholesterol", 81.0, "mg/dL", "> OR = 46 mg/dL"),
    ("Hemoglobin A1c 6.1 H <5.7 % of total Hgb", "Hemoglobin A1c", 6.1, "%", "<5.7"),
    ("Hemoglobin g/dL 13.0 - 16.5 Colorimetric 14.5", "Hemoglobin", 14.5, "g/dL", "13.0 - 16.5"),
    ("HBsAg S/Co Non Reactive : <1.0", "HBsAg", None, "S/Co", "<1.0"),
    ("ACR < 0.1 mg Alb/mmol < 3.5", "ACR", 0.1, "mg Alb/mmol", "< 3.5"),
    ("Glucose 180 mg/dL (70-99)", "Glucose", 180.0, "mg/dL", "70-99"),
]


@pytest.mark.parametrize(("line", "label", "value", "unit", "reference"), GOLDEN)
def test_measurement(line, label, value, unit, reference):
    p = parse(line)
    assert (p["label"], p["number"], p["unit"], p["reference"]) == (label, value, unit, reference)


def test_measurement_edges(spark):
    assert parse(None) is None and parse("") is None and parse("no value here") is None and parse("12") is None
    assert parse("ACR < 0.1 mg Alb/mmol < 3.5")["comparator"] == "<"
    assert [r["value"] for r in rows("HbA1c 葡萄糖血红蛋白 6.8% 51 mmol/mol")] == ["6.8", "51"]
    register(spark)
    got = spark.sql("SELECT value FROM measurement_rows('HbA1c x 6.8% 51 mmol/mol')").collect()
    assert [r.value for r in got] == ["6.8", "51"]
    assert MeasurementRows is not None


def test_spellings():
    assert {"mg/dl", "milligrams per decilitre", "mg%", "mg dl-1"} <= spellings("mg/dL")
    assert "nm" in spellings("nmol/L") and "x10^9/l" in spellings("10*9/L")
