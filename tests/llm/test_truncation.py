"""Fields that lost their end."""

import random

import pytest
from pyspark.sql import functions as F

from labloom.llm import truncation
from labloom.llm.truncation import SHAPES, TEXTS, WORDS, aligned, cut_fields, cut_in_line, cut_rates, cut_texts, falls, near_copies, part_of_unit, shape, unit_keys

UNITS = unit_keys(["mg/dL", "umol/L", "ug/L"])


@pytest.mark.parametrize(
    ("text", "line", "want"),
    [
        ("Light gro", "x Light growth H", True), ("Light growth", "x Light growth H", False), ("0.505-", "x 1 0.505-2.02", True), ("mg/d", "5 mg/dL", True), ("mg/dL", "5mg/dL", False), ("gone", "x", False),
        ("12", "x 12 | 12.5", False), ("x", None, False), ("incubation", "growth incubation. H", True), ("200 - 42", "a 200 - 420", True),
    ],
)
def test_line(text, line, want):
    assert cut_in_line(text, line) is want


def test_falls_and_shape():
    assert falls("140 - 7") and falls("10000-3") and not falls("140 - 700") and not falls("x") and not falls("1,5 - 2,0")
    assert shape("Women: # - #; Niños: # - #", UNITS)[0] == ["L", ":", "#", "-", "#", ";", "L", ":", "#", "-", "#"]
    assert shape("# - # mg / dL (method dependent)", UNITS)[0] == ["#", "-", "#", "U", "(", "method", "dependent", ")"]
    assert shape("", UNITS) == ([], "")


def test_part_of_unit():
    begins = frozenset(u[:i] for u in UNITS for i in range(3, len(u)))
    f = lambda s: part_of_unit(s, UNITS, begins)
    assert f("milligrams per de") and f("# to # umo") and f("mg per")
    assert not f("mg/dL") and not f("# - #") and not f("score") and not f("# - # umol/L") and not f("mg")


def rows(n=3000, seed=1):
    """Rows of a feed without bounds and of one that cuts at 24, with what was cut."""
    rng = random.Random(seed)
    who = ["Women", "Men", "Niños", "Over sixty", "Adults"]
    notes = ["morning specimen", "after overnight fast", "method dependent"]
    remarks = ["Light growth after overnight incubation", "Scanty haemolysis seen before separation", "Negative", "Not detected"]
    out, cut = [], set()
    for i in range(n):
        a, b = round(rng.uniform(1, 9), 2), round(rng.uniform(10, 99), 1)
        x, y = rng.sample(who, 2)
        full = rng.choice([f"{a} - {b}", f"{a} - {b} ({rng.choice(notes)})", f"{x}: {a} - {b}; {y}: {a} - {b}", f"{x} up to {a}, {y} up to {b}, {rng.choice(notes)}", f"{a} to {b} mg/dL", "not established"])
        value, unit = rng.choice([*remarks, f"{a}"]), rng.choice(["milligrams per decilitre", "mg/dL", "umol/L", "score"])
        feed = rng.choice(["free", "free1", "free2", "free3", "bound", "bound"])
        shown = {"raw_value_string": value, "raw_unit_string": unit, "raw_reference_range": full}
        if feed == "bound":
            for f, v in shown.items():
                if len(v) > (limit := {"raw_value_string": 20, "raw_unit_string": 10, "raw_reference_range": 24}[f]):
                    shown[f] = v[:limit].rstrip()
                    cut.add((str(i), f))
        whole = rng.random() < 0.5
        line = f"label {value} {unit} {full}" if whole else " ".join(["label", *shown.values()])
        out.append((str(i), feed, line, *shown.values(), "clash", 1))
    return out, cut


SCHEMA = "id string, source_feed string, raw_text string, raw_value_string string, raw_unit_string string, raw_reference_range string, text string, field int"


@pytest.fixture(scope="module")
def unit_dim(spark):
    return spark.createDataFrame([("mg/dL",), ("umol/L",)], "ucum_code string")


def test_found(spark, unit_dim):
    data, cut = rows()
    got = {(r.row_id, r.field_name) for r in cut_fields(spark.createDataFrame(data, SCHEMA), unit_dim).collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got & cut) >= 0.97 * len(got)
    rates = {(r.source, r.field_name): r for r in cut_rates(spark.createDataFrame(data, SCHEMA), unit_dim).collect()}
    assert rates["free", "raw_value_string"].n_cut == 0 and rates["bound", "raw_unit_string"].share > 0.1
    assert sum(r.n_fields for r in rates.values()) == 3 * len(data)


def test_edges(spark, unit_dim):
    odd = [("1", None, None, None, None, None, None, None), ("2", "f", "", "", " ", "", None, None), ("3", "f", "x " * 50_000, "y" * 50_000, "mg/dL", "1 - 2", None, None), ("4", "f", "z", "word and " * 20_000, "9" * 100_000, "1 - 2; " * 20_000, None, None), ("5", "f", None, "9" * 100_000 + "x", "(" * 50_000, "é" * 300_000, None, None)]
    df = spark.createDataFrame(odd, SCHEMA)
    assert {r.row_id for r in cut_fields(df, unit_dim).collect()} <= {"3", "4", "5"}
    assert cut_fields(df.limit(0), unit_dim).count() == 0
    data, cut = rows(600)
    twice = spark.createDataFrame(data + data, SCHEMA)
    once = cut_fields(spark.createDataFrame(data, SCHEMA), unit_dim).count()
    assert once and cut_fields(twice, unit_dim).groupBy("row_id", "field_name").count().where("count <> 2").count() == 0


def test_numbers_alone(spark, unit_dim):
    cases = [("12", "x 12.5 mg/dL", True), ("5", "x 5.6", True), ("<12", "x < 120 H", True), ("12", "x 12 mg 12.5-13", False), ("12", "x 112.5", False), ("5", "x 0.5", False), ("12", "x 12. H", False), ("12", "x 12-15", False), ("12", None, False), ("12", "x 12 135 - 145", False)]
    df = spark.createDataFrame([(str(i), "f", line, v, None, None, None, None) for i, (v, line, _) in enumerate(cases)], SCHEMA)
    got = {(r.row_id, r.field_name) for r in cut_fields(df, unit_dim).collect()}
    assert got == {(str(i), "raw_value_string") for i, c in enumerate(cases) if c[2]}


def test_long_texts_are_judged_too(spark):
    tokens = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    tokens[79] = "growth"
    text, word = " ".join(tokens), "".join(chr(97 + i * i % 23) for i in range(100))
    cut = [" ".join(tokens[:80]), word[:80]]
    data = [(0, f"free{k}", x, 50) for k in range(3) for x in (text, word, "no growth", "growth")] + [(0, "bound", x, 1) for x in cut]
    got = {r.text for r in cut_texts(spark.createDataFrame(data, "field int, source string, text string, n bigint"), UNITS).collect()}
    assert set(cut) <= got and not got & {text, word, "no growth", "growth"}


def near(spark, data, kind):
    """near_copies over (field, source, m, text)."""
    df = spark.createDataFrame(data, "field int, source string, m bigint, text string").groupBy("field", "source", "text").agg(F.sum("m").alias("m"))
    df = df.groupBy("field", "text").agg(F.collect_list(F.struct("source", "m")).alias("by")).select("field", F.lit(kind).alias("kind"), "text", "by")
    return {(r.field, r.text): (r.ends, r.end_sources, r.goes_on, r.on_sources, r.sources) for r in near_copies(df).collect()}


@pytest.mark.parametrize("kind", [SHAPES, WORDS])
def test_continuations_are_counted_exactly(spark, kind):
    rng = random.Random(4)
    stem = "xyz" * 24
    data = [(rng.randrange(2), rng.choice("pqr"), rng.randrange(1, 5), stem[: rng.choice([1, 2, 3, 5, 8, 20, 70, 71, 72])] + "".join(rng.choices("aé", k=rng.randrange(4)))) for _ in range(400)]
    want = {}
    for f, _, _, w in data:
        own = [(m, s) for f2, s, m, x in data if (f2, x) == (f, w)]
        on = [(m, s) for f2, s, m, x in data if f2 == f and x.startswith(w) and x.rstrip(".") != w]
        want[f, w] = (sum(m for m, _ in own), len({s for _, s in own}), sum(m for m, _ in on), len({s for _, s in on}), len({s for _, s in own + on}))
    assert near(spark, data, kind) == want


def test_alignment_allows_noise():
    assert aligned("Light growth af", "Light growth after", 0) == 15
    assert aligned("Light gnowth af", "Light growth after", 1) == 15 and aligned("Ligt growth af", "Light growth after", 1) == 15 and aligned("Lighht growth af", "Light growth after", 1) == 15
    assert aligned("Light gnovth af", "Light growth after", 1) == -1 and aligned("", "x", 0) == 0 and aligned("x", "", 0) == -1


def test_noisy_copies_meet(spark):
    whole = "Scanty haemolysis seen before separation"
    for cut in ("Scanty haemolysis seeu be", "Scanty haemolysis scen befo", "Scanty haemolyzis seen befor"):  # on both sides in the order
        got = near(spark, [(0, "a", 5, whole), (0, "b", 1, cut)], TEXTS)
        assert got[0, cut][2:] == (5, 1, 2) and got[0, whole][2] == 0
    # a full stop is no continuation, nor are as many characters as the edits may explain
    got = near(spark, [(0, "a", 5, "Repeat on a fresh specimen."), (0, "b", 1, "Repeat on a fresh specimen"), (0, "b", 1, "Repeat on a fresh speclmens")], TEXTS)
    assert all(v[2] == 0 for v in got.values())


def test_every_noisy_continuation_counts(spark):
    """As by aligning each text with each other, wherever the edits are and whatever stands between the two in the order."""
    rng = random.Random(8)
    stems = ["light growth of mixed flora after overnight incubation, repeated twice", "light growth seen", "women: # - # mg/dl; men: # - # mg/dl."]
    texts = {s[: rng.randrange(8, len(s) + 1)] for s in stems for _ in range(60)}
    for text in sorted(texts):
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(text))
                text = text[:i] + rng.choice(["", "x", text[i] + "y", "."]) + text[i + 1 :]
            texts.add(text + rng.choice(["", ".", "..", "  more", " and more to say"]))
    data = [(rng.randrange(2), rng.choice("pqrs"), rng.randrange(1, 5), t) for t in sorted(texts) for _ in range(rng.randrange(1, 3)) if t]

    def goes_on(a, b):
        edits = 0 if b.startswith(a) else min(len(a) // 10, 3)
        return a != b and (end := aligned(a, b, edits)) >= 0 and len(b[end:].rstrip(".")) > edits

    want = {}
    for f, t in {(f, t) for f, _, _, t in data}:
        own = [(m, s) for f2, s, m, x in data if (f2, x) == (f, t)]
        on = [(m, s) for f2, s, m, x in data if f2 == f and goes_on(t, x)]
        want[f, t] = (sum(m for m, _ in own), len({s for _, s in own}), sum(m for m, _ in on), len({s for _, s in on}), len({s for _, s in own + on}))
    assert near(spark, data, TEXTS) == want


@pytest.mark.parametrize("kind", [TEXTS, WORDS])
def test_full_stop_goes_on_behind_shorter_texts(spark, kind):
    got = near(spark, [(0, "a", 1, "ab"), (0, "a", 2, "abc"), (0, "b", 4, "abc."), (0, "c", 8, "abc.d")], kind)
    assert {k: v[2:4] for (_, k), v in got.items()} == {"ab": (14, 3), "abc": (8, 1), "abc.": (8, 1), "abc.d": (0, 0)}


def test_short_beginnings_meet_their_continuations(spark):
    got = near(spark, [(1, "a", 9, "mg/dL"), (1, "b", 1, "mg"), (1, "b", 2, "m"), (1, "c", 4, "mg/")], TEXTS)
    assert {k: v[2] for (_, k), v in got.items()} == {"m": 14, "mg": 13, "mg/": 9, "mg/dL": 0}


def test_near_copies_decide(spark, unit_dim, monkeypatch):
    """Without near-copies, what ends at a number or a mark within a longer form isn't found."""
    data = [(0, f"free{k}", "Women: # - #; Men: # - #", 50) for k in range(3)] + [(0, "bound", "Women: # - #", 1), (0, "bound", "Women: #", 1)]
    df = spark.createDataFrame(data, "field int, source string, text string, n bigint")
    assert {(r.text, r.copied) for r in cut_texts(df, UNITS).collect()} == {("Women: # - #", True), ("Women: #", True)}
    monkeypatch.setattr(truncation, "near_copies", lambda t: near_copies(t).withColumn("goes_on", F.lit(0).cast("long")))
    assert cut_texts(df, UNITS).count() == 0
