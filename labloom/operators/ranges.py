"""Printed reference ranges: parsing, three-valued containment, and tables of named bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
NORMAL_WORDS = ["normal", "wnl", "within normal limits", "within normal range", "negative", "non-reactive", "nonreactive", "absent"]
ABNORMAL_WORDS = [
    "high", "low", "borderline", "critical", "deficien", "insufficien", "toxic", "reactive", "positive", "elevated", "abnormal", "prediabetes",
    "pre-diabetes", "diabetes", "dm", "very high", "above optimal", "near to above optimal", "poor control",
]
NOT_ABNORMAL = ["non reactive", "non-reactive", "nonreactive", "non diabetes", "non-diabetes", "non diabetic", "non-diabetic"]
BAND = r"([a-z][a-z /\-()]*?)\s*[:\-]?\s*(?:(<=?|≤)\s*(-?\d+(?:\.\d+)?)|(>=?|≥)\s*(-?\d+(?:\.\d+)?)|(-?\d+(?:\.\d+)?)\s*[-–]\s*(-?\d+(?:\.\d+)?))"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


#: Parts the groups of a match; stands in no printed text.
MARK = "\x01"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(c: Column) -> Column:
    return let(F.trim(c), lambda x: F.when(x.rlike(NUMBER), x.try_cast("double")))


def bounds(c: Column) -> Column:
    """struct<low, high> of a printed range: an interval with an ASCII hyphen, or one comparator; null if it is none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^[()\[\]]+|[()\[\]]+$", ""), r"\s+", " "))
    none = F.lit(None).cast("double")
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))

    def of(s: Column) -> Column:
        both = F.struct(_number(F.substring_index(s, "-", 1)).alias("low"), _number(F.substring(s, F.instr(s, "-") + 1, F.length(s))).alias("high"))
        interval = let(both, lambda p: F.when(p["low"].isNotNull() & p["high"].isNotNull(), p))
        up = let(_number(F.regexp_replace(s, "^[<=≤ ]+", "")), lambda x: F.when(x.isNotNull(), pair(none, x)))
        down = let(_number(F.regexp_replace(s, "^[>=≥ ]+", "")), lambda x: F.when(x.isNotNull(), pair(x, none)))
        return F.when(F.contains(s, F.lit("-")) & ~s.startswith("-"), interval).when(s.rlike("^[<≤]"), up).when(s.rlike("^[>≥]"), down)

    return let(plain, of)


def band(value: Column, c: Column) -> Column:
    """'normal' or 'abnormal' by the first of at least two named bands that holds the value, null if none does. Each part is matched once."""
    groups = MARK.join(f"${i}" for i in range(1, 8))
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.lower(c), r"[\n|]+", ";"), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def holds(g: Column) -> Column:
        num = lambda i: g[i].try_cast("double")
        at = F.when(g[1] == "<", value < num(2)).when(g[1] != "", value <= num(2)).when(g[3] == ">", value > num(4)).when(g[3] != "", value >= num(4)).when(g[5] != "", value.between(num(5), num(6)))
        return (F.size(g) == 7) & F.coalesce(at, F.lit(False))

    any_of = lambda label, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(label, w))
    named = lambda label: F.when(label.isNotNull(), F.when(any_of(label, NOT_ABNORMAL), "normal").when(any_of(label, ABNORMAL_WORDS), "abnormal").otherwise("normal"))

    def of(ps: Column) -> Column:
        matched = F.transform(ps, lambda p: F.split(F.regexp_replace(p, f"(?s)^.*?{BAND}.*$", groups), MARK))
        return F.when(F.size(ps) >= 2, let(F.get(F.filter(matched, holds), F.lit(0))[0], named))

    return let(parts, of)


def within(value: Column, c: Column) -> Column:
    """Whether a value lies in its printed range; null if there is no range to tell."""
    inside = lambda b: F.coalesce(value >= b["low"], F.lit(True)) & F.coalesce(value <= b["high"], F.lit(True))
    ranged = let(bounds(c), lambda b: F.when(b.isNotNull(), inside(b)).otherwise(band(value, c) == "normal"))
    return let(F.lower(F.trim(c)), lambda text: F.when(value.isNull() | text.isNull() | (text == ""), F.lit(None)).when(text.isin(NORMAL_WORDS), True).otherwise(ranged))
