"""Labels against a reference list."""

import random

import pytest

from labloom.llm.canonical import LEAST_SUPPORT, MAX_EDITS, UNMAPPED, Names, allowed, base, deletes, distance, key, map_labels, map_observations, trimmings
from labloom.llm.canonical import _CHEAP as CHEAP
from labloom.llm.truncation import cut_fields

LIST = [("ferritin", "F", 9), ("serum ferritin", "F", 9), ("transferrin", "T", 5), ("transferrin saturation", "S", 1), ("urea", "U", 3), ("urate level", "V", 2), ("kupfer im Serum", "C", 1), ("铁蛋白", "F", 9), ("complement c3", "3", 1), ("alpha amylase", "A", 1), ("inorganic phosphate", "P", 1), ("magnesium", "M", 1)]
# "level" and "serum" stand in names of four entries, so that they say nothing of what is measured
LIST += [("ferritin level", "F", 9), ("magnesium level", "M", 1), ("urea level", "U", 3), ("serum transferrin", "T", 5), ("serum urea", "U", 3), ("serum magnesium", "M", 1)]
UNITS = ["umol/L", "u[IU]/mL", "mg/L", "%"]
LABELS = [t.format(n) for t in ("S-{}", "{}. {}", "Lab: {}", "{} / fasting", "{} - repeat", "{} 2nd sample", "{} [see note]", "serum serm {}") for n in ("urea", "magnesium", "Transferrin", "ferritin") if t.count("{}") == 1] + ["1. urea", "12. ferritin", "3. magnesium", "urea hydrolysis", "serm urea", "serm ferritin", "serm magnesium", "ferritin (umol/l)", "urea (umol/l)", "magnesium (umol/l)", None, ""]


def learned(labels):
    known, found = Names(LIST, UNITS, near=False), {}
    for label in labels:
        for before, trimming, code in known.learn(label):
            found.setdefault((before, trimming), set()).add(code)
    return tuple(frozenset(t for (b, t), codes in found.items() if b == before and len(codes) >= LEAST_SUPPORT and t != "serm") for before in (True, False))


NAMES = Names(LIST, UNITS, learned(LABELS))


@pytest.mark.parametrize(
    ("label", "code"),
    [
        ("ferritin", "F"), ("FERRITIN (umol/L)", "F"), ("Ferritin [u[IU]/mL]", "F"), ("S-ferritin", "F"), ("# Ferritin *", "F"), ("1. Ferritin", "F"), ("Lab: Ferritin", "F"), ("ferritin / fasting", "F"), ("ferritin - repeat", "F"),
        ("FERRIITN", "F"), ("ferr1tin", "F"), ("Serurn ferritin", "F"), ("SERUMFERRITIN", "F"), ("ferritin, serum", "F"), ("Serum, Kupfer im", "C"), ("KUPFER_IM_SERUM", "C"), ("铁蛋白 level:", "F"), ("Transfer.", "T"),
        ("serum ferritin / ferritin", "F"), ("phosphate, inorganic", "P"), ("Maguesium", "M"), ("ferritin 38", "F"), ("alpha amylase 2nd sample", "A"), ("Complement c3", "3"), ("urea", "U"), ("Urate level", "V"),
    ],
)
def test_mapped(label, code):
    assert NAMES.code(label) == code


@pytest.mark.parametrize("label", ["", None, "***", "n/a", "Calprotectin", "Lot 44-B", "Page 2 of 5", "備考", "Comment", "pepsinogen", "level", "x" * 100_000, "a" + " " * 100_000 + "b", "a" + "*" * 100_000 + "b", "a" + ": " * 50_000 + "b", "9" * 100_000 + "x", "[" * 50_000])
def test_unmapped(label):
    assert NAMES.code(label) == UNMAPPED


def slow(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    from labloom.llm.canonical import _CHEAP

    for i in range(len(a)):
        for j in range(len(b)):
            c = 0 if a[i] == b[j] else 0.5 if (a[i], b[j]) in _CHEAP else 1
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + c)
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_distance_and_recall_of_the_dictionary():
    rng = random.Random(4)
    words = [key(base(n)) for n, _, _ in LIST]
    for _ in range(2000):
        w = rng.choice(words)
        c = list(w)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(c) + 1)
            op = rng.randrange(4)
            if op == 0:
                c.insert(i, rng.choice("aeiou1"))
            elif op == 1 and i < len(c) > 3:
                del c[i]
            elif op == 2 and i < len(c):
                c[i] = rng.choice("xyz0o")
            elif i + 1 < len(c):
                c[i], c[i + 1] = c[i + 1], c[i]
        s = "".join(c)
        d = slow(s, w)
        assert distance(s, w, 3.0) == d or d > 3.0
        best = min(slow(s, x) for x in NAMES.by_key if abs(len(x) - len(s)) <= 3) if s else 9
        found = NAMES.close(s)
        if found:
            assert found[0] >= min(best, found[0])
        if len(w) >= 9 and slow(key(s), w) <= 2:
            assert found is not None


def test_trimmings_are_learned(spark):
    names = spark.sparkContext.broadcast(LIST)
    before, behind = trimmings(spark.createDataFrame([(x,) for x in LABELS * 2], "label string"), names, UNITS)
    assert {"s-", "lab:", "#."} <= before and {"/ fasting", "- repeat", "#nd sample", "[see note]"} <= behind
    assert "serm" not in before and "hydrolysis" not in behind and not any("umol" in t for t in behind)
    assert (before, behind) == learned(LABELS)
    assert Names(LIST, UNITS).code("Lab: Ferritin xyz") == UNMAPPED == NAMES.code("ferritin hydrolysis")


def test_candidates_are_bounded_by_the_weighted_distance():
    names = Names([("bicarbonate ions", "B", 1), ("transferrin", "T", 1)], [])
    assert distance("hiearhouateions", "bicarbonateions", 3.0) == 2.0
    assert names.code("hiearhouate ions") == "B"
    # whatever is within the bound of an entry shares a deletion with it
    rng = random.Random(3)
    for _ in range(3000):
        w = rng.choice([key(base(n)) for n, _, _ in LIST])
        c = list(w)
        for _ in range(rng.randrange(7)):
            i = rng.randrange(len(c))
            c[i] = rng.choice([b for a, b in CHEAP if a == c[i]] or [c[i]]) if rng.random() < 0.7 else rng.choice("aeiouxyz")
        s = "".join(c)
        if slow(s, w) <= min(allowed(len(s)), allowed(len(w))):
            assert deletes(s, MAX_EDITS) & deletes(w, MAX_EDITS)


def test_frame(spark):
    df = spark.createDataFrame([("1", "ferritin", "x"), ("1", "ferritin", "x"), ("2", None, None), ("3", "Ｆｅrritin", ""), ("4", "zzz", "")], "id string, raw_analyte_label string, code string")
    names = spark.createDataFrame([("F", "ferritin"), ("F", None), (None, "x")], "candidate_code string, name string")
    got = sorted(map(tuple, map_labels(df, names, ["mg/L"]).collect()))
    assert got == [("1", "F"), ("1", "F"), ("2", UNMAPPED), ("3", "F"), ("4", UNMAPPED)]
    assert {r.candidate_code for r in map_labels(df, names.limit(0), []).collect()} == {UNMAPPED}
    assert map_labels(df.limit(0), names, []).count() == 0


def test_too_many_units_raise(spark):
    many = spark.range(10_001).selectExpr("concat('u', id) as ucum_code", "'mass' as kind", "1.0D as factor_to_base")
    rows = spark.createDataFrame([], "id string, accepted_analyte_code string, raw_analyte_label string, source_feed string, raw_text string, raw_value_string string, raw_unit_string string, raw_reference_range string")
    with pytest.raises(ValueError):
        cut_fields(rows, many)
    rules = spark.createDataFrame([("A", "x", "x", ["x"])], "candidate_code string, canonical_label string, candidate_display string, aliases array<string>")
    with pytest.raises(ValueError):
        map_observations(rows, rules, many)
