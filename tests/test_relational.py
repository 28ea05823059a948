"""Relational operators, folds, sources, sinks and streams against plain Python."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from labloom.operators import folds, relational as rel
from labloom.plans import registry
from labloom.sources import readers, writers
from labloom.streaming import streams


def test_latest_first_and_best(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, 5, 4), ("b", None, 5)], "k string, t int, i int")
    assert sorted(rel.latest_per_key(df, ["k"], "t", "i").collect(), key=str) == sorted([("a", 2, 3), (None, 5, 4), ("b", None, 5)], key=str)
    assert rel.best_or_abstain(df, ["k"], ["t"]).where("k = 'a'").first()["i"] == 1
    assert rel.best_or_abstain(df.withColumn("t", F.lit(1)), ["k"], ["t"]).where("k = 'a'").count() == 0
    assert rel.latest_per_key(df.limit(0), ["k"], "t", "i").count() == 0


def test_islands_and_mode(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate("xxyyx")] + [("a", 5, None), ("a", 6, None)], "k string, i int, v string")
    assert [r.island for r in rel.islands(df, ["k"], ["i"], ["v"]).orderBy("i").collect()] == [0, 0, 1, 1, 2, 3, 3]
    assert rel.mode_first_seen(df.where("i < 4"), ["k"], "v", "i").first()["v"] == "x"


def test_latest_of_other_group(spark):
    rng = random.Random(1)
    data = [(rng.choice("AB"), rng.choice(["u", None]), f"j{rng.randrange(4)}", rng.randrange(20), i) for i in range(200)]
    df = spark.createDataFrame(data, "code string, unit string, job string, t int, id int")
    got = {(r.code, r.unit, r.job): r.other_id for r in rel.latest_of_other_group(df, ["code", "unit"], "job", "t", "id", ["id"]).collect()}
    want = {}
    for c, u, j, _, _ in data:
        other = [(t, i) for c2, u2, j2, t, i in data if (c2, u2) == (c, u) and j2 != j]
        if other:
            want[c, u, j] = max(other)[1]
    assert got == want


def test_sets_and_mutations(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(map(tuple, rel.symmetric_difference(a, b).collect())) == [(1, "left"), (2, "left"), (3, "right")]
    old, new = spark.createDataFrame([("a", 0)], "k string, t int"), spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), (None, 4)], "k string, t int")
    assert sorted(map(tuple, rel.insert_if_absent(old, new, "k", [F.col("t")]).collect()), key=str) == [("b", 2), (None, 4)]
    e = spark.createDataFrame([("k", 1, 1, "x", None), ("k", 2, 2, None, 5), ("k", 3, 3, None, None)], "k string, t int, i int, a string, b int")
    assert tuple(rel.last_known(e, "k", "t", "i", ["a", "b"]).first()) == ("k", "x", 5)


def brute_bands(boxes, value, close, update):
    order = sorted(range(len(boxes)), key=lambda i: (value(boxes[i]) if close != "top" else boxes[i][1], boxes[i][0], i))
    out, band, current, n = {}, -1, 0.0, 0
    for i in order:
        v = value(boxes[i])
        if n and close(v, current):
            n += 1
            current = update(current, v, n)
        else:
            band, current, n = band + 1, v, 1
        out[i] = band
    return out


def test_geometry_folds(spark):
    rng = random.Random(3)
    boxes = [(rng.randrange(100), rng.randrange(60), 0, 0) for _ in range(60)]
    boxes = [(x, y, x + 10, y + rng.randrange(1, 9)) for x, y, _, _ in boxes]
    df = spark.createDataFrame([(1, boxes), (2, [])], "id int, lines array<struct<x0:int,y0:int,x1:int,y1:int>>")
    mid = lambda b: (b[1] + b[3]) / 2
    for f, want in (
        (folds.line_bands, brute_bands(boxes, lambda b: float(b[1]), lambda v, c: abs(v - c) <= 3.0, lambda c, v, n: (c + v) / 2)),
        (folds.anchored_rows, brute_bands(boxes, mid, lambda v, c: abs(v - c) < 5.0, lambda c, v, n: c)),
        (folds.mean_rows, brute_bands(boxes, mid, lambda v, c: abs(v - c) <= 4.5, lambda c, v, n: c + (v - c) / n)),
    ):
        got = {r.id: {b.i: b.band for b in r.b} for r in df.select("id", f(F.col("lines")).alias("b")).collect()}
        assert got[1] == want and got[2] == {}


def test_rate_limit(spark):
    t0 = dt.datetime(2026, 1, 1)
    rng = random.Random(5)
    data = [(rng.randrange(2), t0 + dt.timedelta(seconds=rng.randrange(2000)), i) for i in range(400)]
    df = spark.createDataFrame(data, "u bigint, ts timestamp, id bigint")
    got = {r.id: r.allowed for r in folds.rate_limited(df, "u", "ts", "id", 5, 60).collect()}
    want = {}
    for u in (0, 1):
        held = []
        for _, ts, i in sorted((x for x in data if x[0] == u), key=lambda x: (x[1], x[2])):
            held = [h for h in held if (ts - h).total_seconds() <= 60]
            want[i] = len(held) < 5
            if want[i]:
                held.append(ts)
    assert got == want


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([("label", "HBsAg S/Co"), ("value", "Non Reactive 0.2")], [["HBsAg S/Co", "Non Reactive 0.2"]]),
        ([("label", "Final Diagnosis"), ("value", "5.6 mmol/L")], [["5.6 mmol/L"]]),
        ([("label", "Kidney Panel"), ("label", "Creatinine"), ("value", "88 umol/L")], [["Creatinine", "88 umol/L"]]),
        ([("label", "A"), ("excluded", "Page 1"), ("value", "5")], [["5"]]),
        ([("empty", "")], []),
    ],
)
def test_grouping(spark, lines, want):
    df = spark.createDataFrame([(1, i, k, x) for i, (k, x) in enumerate(lines)], "page int, n int, kind string, line string")
    assert [r.lines for r in folds.label_value_groups(df, ["page"], "n").orderBy("group").collect()] == want


def test_uploads(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1"), ("b.pdf", b"nope"), ("c.png", b"\x89PNG\r\n\x1a\nxx"), ("d.json", b"{}"), ("e.exe", b"MZ"), ("f.json", b"x" * 50)):
        (tmp_path / name).write_bytes(content)
    got = {r.filename: (r.lane_type, r.reject) for r in readers.uploads(spark, str(tmp_path), 40).collect()}
    assert got == {"a.pdf": ("trusted_pdf", None), "b.pdf": (None, "magic_byte_mismatch:pdf"), "c.png": ("image_beta", None), "d.json": ("structured", None), "e.exe": (None, "unsupported_extension:.exe"), "f.json": (None, "file_too_large")}


def test_manifest_has_every_file(spark, tmp_path):
    big = b"x" * 2_500_000
    contents = {"easy/a.parquet": b"a", "easy/b%20 c.parquet": big, "hard/d.parquet": big, "hard/é.parquet": big + b"y"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {(r.tier, r.files, r.contents) for r in registry.queries()["src17_src18_manifest"](spark, str(tmp_path)).collect()}
    assert got == {("easy", 2, 2), ("hard", 2, 2)}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert {r.path.removeprefix(f"file:{tmp_path}/"): r.checksum for r in readers.manifest(files).collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in contents.items()}


def test_structured(spark):
    good = {"source_page": 1, "row_hash": "r", "raw_analyte_label": "x", "raw_value_string": "5", "parsed_numeric_value": 5.5}
    cases = [
        (json.dumps({"observations": [good]}), None),
        (json.dumps({"observations": [1]}), "structured_observation_not_object:0"),
        (json.dumps({"observations": [{"source_page": 1}]}), "structured_observation_missing_fields:0:row_hash,raw_analyte_label"),
        (json.dumps({"observations": [good | {"source_page": 0}]}), "structured_observation_invalid_source_page:0"),
        (json.dumps({"observations": [good | {"source_page": "1"}]}), "structured_observation_invalid_source_page:0"),
        (json.dumps({"observations": [good | {"row_hash": " "}]}), "structured_observation_invalid_row_hash:0"),
        (json.dumps({"observations": [good | {"raw_analyte_label": 3}]}), "structured_observation_invalid_analyte_label:0"),
        (json.dumps({"observations": [good | {"raw_value_string": 5}]}), "structured_observation_invalid_raw_value_type:0"),
        (json.dumps({"observations": [good | {"parsed_numeric_value": True}]}), "structured_observation_invalid_parsed_numeric_value:0"),
        (json.dumps({"observations": {}}), "structured_observations_not_list"),
        ("{", "invalid_json"),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "id int, payload string")
    got = {r.id: r for r in readers.structured_rows(df, "id", "payload").collect()}
    assert [got[i].error for i in range(len(cases))] == [e for _, e in cases]
    assert got[0].row.raw_analyte_label == "x" and got[0].row.parsed_numeric_value == 5.5


def test_lenient(spark):
    cases = [('{"rows": [{"k": 1}, {"k": 2}]}', "strict", 2), ('```json\n{"rows": [{"k": 1},]}\n```', "repaired", 1), ('{"rows": [{"k": 1}, {"k": "a" oops}, {"k": 3}', "harvested", 2), ("nothing", "lost", 0), (None, "lost", 0)]
    df = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(cases)], "id int, x string")
    got = {r.id: (r.how, len(r.objects)) for r in readers.lenient_objects(df, "id", "x", "k").collect()}
    assert [got[i] for i in range(len(cases))] == [(h, n) for _, h, n in cases]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2026, 1, 2, 3, 4, 5, 6), b"\x01\xff", None)], "g string, t timestamp_ntz, b binary, n int")
    writers.append_stage(df, str(tmp_path / "s"), {"g": 1})
    writers.append_stage(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    writers.write_documents(df, str(tmp_path / "d"), "g")
    doc = json.loads(spark.read.text(str(tmp_path / "d" / "g=a")).first()["value"])
    assert doc == {"b": "01ff", "n": None, "t": "2026-01-02T03:04:05.000006"} and list(doc) == sorted(doc)


def test_stage_has_the_widths_of_the_reference(spark, tmp_path):
    texts = ["raw_text", "raw_analyte_label", "raw_value_string", "raw_unit_string", "raw_reference_range"]
    rest = ["id", "document_id", "job_id", "source_page", "row_hash", "extraction_confidence"]
    long, none = [F.lit("é" * 200).alias(c) for c in texts], [F.lit(None).cast("string").alias(c) for c in texts]
    one = spark.range(1).select(*[F.lit(1).alias(c) for c in rest])
    one.select("*", *long).unionByName(one.select("*", *none)).write.parquet(str(tmp_path / "extracted_row.parquet"))
    got = registry.queries()["snk01_extracted_stage"](spark, str(tmp_path)).select(*[F.length(c) for c in texts]).collect()
    assert sorted(map(tuple, got), key=str) == [(200, 200, 64, 64, 128), (None,) * 5]


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i % 50, t0 + dt.timedelta(minutes=i % 50), "k", 1.0, i % 3) for i in range(100)]
    schema = "event_id bigint, ts timestamp, kind string, value double, user_id bigint"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    src = lambda: streams.folder_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    streams.run_to_end(streams.idempotent(src(), "event_id", "ts"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 50
    streams.run_to_end(streams.rate_limited_stream(src(), "user_id", "ts", "event_id", 5, 600), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 100
    streams.each_batch_to_end(streams.windowed(src(), "ts", ["kind"], "10 minutes", "5 minutes"), str(tmp_path / "c3"), lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "o3")), "complete")
    assert spark.read.parquet(str(tmp_path / "o3")).agg(F.sum("n")).first()[0] == 200


def test_islands_in_blocks(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.randrange(100) if rng.random() < 0.95 else None, i, rng.choice([1, 2, None])) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, o int, i int, s int")
    whole = rel.islands(df, ["k"], ["o", "i"], ["s"]).select("i", "island").collect()
    parts = rel.islands(df, ["k"], ["o", "i"], ["s"], block=F.floor(F.col("o") / 10)).select("i", "island").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_holding_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("ab%.", k=rng.randrange(0, 7)))
    a, b = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    got = {tuple(r) for r in rel.holding(spark.createDataFrame([(x,) for x in a], "i string"), "i", spark.createDataFrame([(x,) for x in b], "o string"), "o").collect()}
    assert got == {(x, y) for x in a for y in b if x and x in y}


def test_clusters_against_brute_force(spark):
    rng = random.Random(3)
    data = [(k, rng.randrange(50), i, "".join(rng.choices("ab", k=rng.randrange(0, 5))) or None, rng.randrange(5)) for k in range(12) for i in range(k * 100, k * 100 + 30)]
    want = []
    for k in range(12):
        rows, used = sorted((r[1:] for r in data if r[0] == k), key=lambda r: (r[0], r[1])), set()
        for i in range(len(rows)):
            if i in used:
                continue
            members = [i]
            for j in range(i + 1, len(rows)):
                if j not in used and any(rows[m][2] and rows[j][2] and (rows[m][2] in rows[j][2] or rows[j][2] in rows[m][2]) for m in members):
                    members.append(j)
            best = max(members, key=lambda m: (rows[m][3], -m))
            want += [(rows[m][1], rows[best][1]) for m in members]
            used.update(members)
    got = folds.greedy_clusters(spark.createDataFrame(data, "k int, o int, id int, l string, s int"), ["k"], "o", "l", "s", "id")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def grouped(lines):
    """measurement_groups of one page by an automaton: lines are (text, kind, bearing, excluded, unit_only)."""
    groups, now, full = [], [], False
    for x in lines:
        kind = x[1]
        if kind == "index":
            kind = "continuation" if full else "value"
        if kind == "value" and not full:
            while now and now[0][3]:
                now.pop(0)
            now.append(x)
            full = True
        elif kind == "continuation":
            now.append(x)
        elif full:
            groups.append(now)
            now, full = [x], False
        else:
            now.append(x)
    groups = [g for g in [*groups, now] if g]
    merged, front = [], []
    for g in groups:
        if any(x[2] for x in g):
            merged.append([*front, *g])
            front = []
        elif not all(x[3] for x in g):
            front = [*g, *front]
    out = []
    for g in merged:
        if out and g[0][4]:
            out[-1] += g
        else:
            out.append(list(g))
    return [[x[0] for x in g] for g in out]


def test_measurement_groups_against_an_automaton(spark):
    rng = random.Random(8)
    pages = {p: [(f"{p}-{i}", rng.choice(["value", "label", "label", "continuation", "index"]), rng.random() < 0.6, rng.random() < 0.25, rng.random() < 0.2) for i in range(rng.randrange(0, 14))] for p in range(150)}
    df = spark.createDataFrame([(p, i, *x) for p, lines in pages.items() for i, x in enumerate(lines)], "page int, n int, line string, kind string, bearing boolean, excluded boolean, unit_only boolean")
    got = {}
    for r in folds.measurement_groups(df, ["page"], "n").orderBy("page", "group").collect():
        got.setdefault(r.page, []).append(list(r.lines))
    assert got == {p: g for p, lines in pages.items() if (g := grouped(lines))}
