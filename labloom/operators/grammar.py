"""The measurement line: label, value, unit, reference range and a second result out of one printed line.

A line is cut into spans first: intervals, comparator bounds, units, flags, numbers, words. What the spans are decides
what they mean: the value is the number that is in no interval or bound and stands nearest to a unit or a flag, a bound
before any value is the value's comparator, footnote numbers before another number are passed over. Given as a plain
function, as a table function for SQL and as an Arrow operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

UNIT = r"%|[xX]?10[*^Ee]\d+/[A-Za-zµμ]+|(?:[mMunpkµμ]?(?:g|mol|U|IU|kat|L|Eq)|mcg|S|fL|pg)/(?:[mdufµμ]?L|mol|mmol|g|Co|min(?:/1\.73 ?m2?)?|hpf|cmm|mm3)|fL|pg|sec|seconds|ratio"
NUM = r"\d[\d,]*(?:\.\d+)?"
SPAN = re.compile(
    rf"(?P<interval>{NUM}\s*(?:-|–|to)\s*{NUM}(?![\w.]))|(?P<bound>(?:[<>]\s*[oO][rR]\s*=|<=|>=|[<>≤≥])\s*{NUM})|(?P<unit>(?:mg\s+Alb/mmol|{UNIT})(?![\w]))"
    rf"|(?P<glued>{NUM}%)|(?P<number>(?<![\w.]){NUM}(?![\w.,]*[A-Za-z]))|(?P<flag>(?<!\S)[HLA*](?!\S))|(?P<words>[^\s()\[\]]+|[()\[\]])"
)
QUALITATIVE = re.compile(r"(?i)\b(non[ -]?reactive|not detected|reactive|detected|positive|negative|trace|absent|present)\b")


def parse(line: str | None) -> dict | None:
    """label, value, number, comparator, unit, reference, second_value, second_unit of a line; null if it holds no value."""
    text = " ".join((line or "").split())
    spans = [(m.lastgroup, m.group(), m.start(), m.end()) for m in SPAN.finditer(text)]
    kinds = [s[0] for s in spans]
    numbers = [i for i, k in enumerate(kinds) if k in ("number", "glued") and any(x == "words" for x in kinds[:i])]
    comparator, value = None, None
    if numbers:
        # a footnote number is followed by another number at once
        plain = [i for i in numbers if not (kinds[i + 1 : i + 2] in (["number"], ["glued"]) and re.fullmatch(r"\d{1,2}", spans[i][1]))] or numbers
        bound = next((i for i, k in enumerate(kinds) if k == "bound"), None)
        early = [i for i in plain if kinds[i] == "glued" or kinds[i + 1 : i + 2] and kinds[i + 1] in ("unit", "flag", "bound", "interval")]
        value = early[0] if early else plain[-1] if any(kinds[j] == "interval" and j < plain[-1] for j in range(len(kinds))) else plain[0]
        if bound is not None and bound < value and "words" in kinds[:bound] and kinds[bound + 1 : bound + 2] == ["unit"]:
            value = bound
    else:
        value = next((i for i, k in enumerate(kinds) if k == "bound" and "words" in kinds[:i] and kinds[i + 1 : i + 2] == ["unit"]), None)
    quality = QUALITATIVE.search(text) if value is None else None
    if value is None and not quality:
        return None
    start = spans[value][2] if value is not None else quality.start()
    label_end = next((s[2] for s in spans if s[0] in ("unit", "interval", "bound", "number", "glued", "flag") and s[2] <= start and s[2] > 0), start)
    label = text[: min(label_end, start)].strip(" :,-")
    if not label:
        return None
    raw = spans[value][1] if value is not None else quality.group()
    if value is not None and kinds[value] == "bound":
        m = re.match(r"([<>≤≥]\s*(?:[oO][rR]\s*)?=?)\s*(.*)", raw)
        comparator, raw = re.sub(r"\s+", "", m[1]), m[2]
    unit = "%" if raw.endswith("%") else None
    digits = raw.rstrip("%").replace(",", "") if value is not None else None
    rest = [s for i, s in enumerate(spans) if i != value]
    after = [s for s in rest if s[2] > start]
    second_value = second_unit = None
    if unit and len(after) >= 2 and after[0][0] == "number" and after[1][0] == "unit":
        second_value, second_unit = after[0][1], after[1][1]
    elif not unit:
        near = [s for s in after if s[0] == "unit"] or [s for s in rest if s[0] == "unit"]
        unit = near[0][1] if near else None
    references = [s for s in rest if s[0] in ("interval", "bound") and not (s[0] == "interval" and value is not None and s[2] == start)]
    reference = None
    if references:
        r = references[0]
        i = spans.index(r)
        tail = spans[i + 1] if i + 1 < len(spans) and spans[i + 1][0] == "unit" else None
        reference = text[r[2] : tail[3]] if tail and not (after and after[0][0] == "unit") and r[2] > start and tail[1] != "%" else r[1]
    return {"label": label, "value": raw.rstrip("%"), "number": float(digits) if digits else None, "comparator": comparator, "unit": unit, "reference": reference, "second_value": second_value, "second_unit": second_unit}


FIELDS = "label string, value string, number double, comparator string, unit string, reference string, second_value string, second_unit string"


@udtf(returnType=FIELDS)
class MeasurementRows:
    """One line to no row, one row, or two if it bears a second result."""

    def eval(self, line: str):
        for r in rows(line):
            yield tuple(r.values())


def rows(line: str | None) -> list[dict]:
    """The rows a line gives: a second result becomes a row of its own."""
    p = parse(line)
    if p is None:
        return []
    if p["second_value"] is None:
        return [p]
    second = p | {"value": p["second_value"], "number": float(p["second_value"].replace(",", "")), "unit": p["second_unit"], "comparator": None, "reference": None, "second_value": None, "second_unit": None}
    return [p, second]


def register(spark: SparkSession) -> None:
    """The grammar as the table function measurement_rows(line) for SQL."""
    spark.udtf.register("measurement_rows", MeasurementRows)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.float64() if n == "number" else pa.string() for n in names]
    for batch in batches:
        ids, found = [], []
        for i, line in enumerate(batch.column(1).to_pylist()):
            for r in rows(line):
                ids.append(i)
                found.append(r)
        out = [pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *out], [batch.schema.names[0], *names])


def measurements(lines: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """The grammar over all lines, in Arrow batches: id and the fields; lines without a value give no row."""
    chosen = lines.select(F.col(id_col).alias("id"), F.col(line_col).cast("string").alias("line"))
    return chosen.mapInArrow(_parse_batches, f"id {chosen.schema['id'].dataType.simpleString()}, {FIELDS}")
