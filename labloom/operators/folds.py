"""Sequential folds over a page or a key, where what becomes of a row depends on what became of those before it.

Geometry folds run over the array of boxes of one page with a higher-order aggregate, without a shuffle. Rows of labels and
values come out of windows. Folds with richer state group by their key and run in Arrow.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def bands_by_running_value(boxes: Column, key, value, close, update) -> Column:
    """Assigns each box, in the order of ``key``, to a band: a new one begins where ``close(value, current)`` fails.

    ``update(current, value, n)`` gives the band's value after its n-th member. Comes out as array<struct<i, band>>.
    """
    ordered = F.array_sort(F.transform(boxes, lambda b, i: F.struct(*key(b), i.alias("i"), value(b).alias("v"))))
    zero = F.struct(F.lit(-1).alias("band"), F.lit(0.0).alias("current"), F.lit(0).alias("n"), F.array().cast("array<struct<i:int,band:int>>").alias("out"))

    def step(acc, b):
        same = (acc["n"] > 0) & close(b["v"], acc["current"])
        band = F.when(same, acc["band"]).otherwise(acc["band"] + 1)
        n = F.when(same, acc["n"] + 1).otherwise(1)
        current = F.when(same, update(acc["current"], b["v"], n)).otherwise(b["v"])
        return F.struct(band.alias("band"), current.alias("current"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(b["i"].cast("int").alias("i"), band.alias("band")))).alias("out"))

    return F.aggregate(ordered, zero, step, lambda acc: acc["out"])


def line_bands(boxes: Column, within: float = 3.0) -> Column:
    """Boxes into bands by their top: within ``within`` of the median of the band's value and the last member."""
    return bands_by_running_value(boxes, lambda b: [b["y0"].alias("y"), b["x0"].alias("x")], lambda b: b["y0"].cast("double"), lambda v, c: F.abs(v - c) <= within, lambda c, v, n: (c + v) / 2)


def mean_rows(boxes: Column, within: float = 4.5) -> Column:
    """Boxes into rows by their middle: within ``within`` of the mean of the row so far."""
    middle = lambda b: ((b["y0"] + b["y1"]) / 2).cast("double")
    return bands_by_running_value(boxes, lambda b: [middle(b).alias("y"), b["x0"].alias("x")], middle, lambda v, c: F.abs(v - c) <= within, lambda c, v, n: c + (v - c) / n)


def anchored_rows(boxes: Column, within: float = 5.0) -> Column:
    """Boxes into rows by their middle: less than ``within`` from the first of the row."""
    middle = lambda b: ((b["y0"] + b["y1"]) / 2).cast("double")
    return bands_by_running_value(boxes, lambda b: [middle(b).alias("y"), b["x0"].alias("x")], middle, lambda v, c: F.abs(v - c) < within, lambda c, v, n: c)


def rate_limited(events: DataFrame, key: str, time: str, tie: str, most: int = 20, window_s: int = 300) -> DataFrame:
    """Marks each event as allowed or not: at most ``most`` allowed ones of a key in any ``window_s`` seconds; refused ones don't count.

    Batches of a key arrive one after the other, so a hot key needs memory for its last ``most`` events only.
    """
    from collections.abc import Iterator

    schema = events.select(key, time, tie).schema
    names = (key, time, tie)

    def run(_key, batches):
        held, refused_after = [], window_s * 1_000_000
        for batch in batches:
            marks = []
            for at in batch.column(1).cast(pa.int64()).to_pylist():
                while held and at - held[0] > refused_after:
                    held.pop(0)
                allowed = len(held) < most
                if allowed:
                    held.append(at)
                marks.append(allowed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.bool_())], [*names, "allowed"])

    run.__annotations__ = {"_key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    ordered = events.select(*names).repartition(key).sortWithinPartitions(key, time, tie)
    return ordered.groupBy(key).applyInArrow(run, f"{fields}, allowed boolean")


#: Words that mark a heading, and words that keep a label from being joined to a value.
HEADINGS = ["panel", "profile", "diagnosis", "report", "results", "tests"]
NOT_JOINED = ["diagnosis", "request", "comment", "note", "page "]
#: Fixed pattern: a line that can only stand beside a value that is there already.
BESIDE = r"^(?:\d{1,2}|%(?:\s+\d{1,2})?|(?:(?:<\s*or\s*=|>\s*or\s*=|<=|>=|<|>|≤|≥)?\s*\d.*))$"


def label_value_groups(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines of a page grouped into rows of labels and the value that follows: keys, group, lines.

    ``lines`` has ``kind`` (label, value, continuation, excluded, empty) and ``line``. Excluded lines part a page. A row ends
    with its value and what continues it, so a line's row is the number of values before it; windows say all of that, no
    line waits for another. Labels before a value stay with it if they may: at most three lines and ten words, no colon at
    an end, no word that keeps them apart; headings in front are left off. Rows without a value are left out.
    """
    on = [F.col(k) for k in keys]
    low = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    held = lambda x, words: x.rlike("|".join(map(re.escape, words)))
    w = Window.partitionBy(*on).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.sum((F.col("kind") == "excluded").cast("int")).over(before), F.lit(0))
    t = lines.select(*keys, order, "kind", "line").where("kind <> 'empty'").withColumn("part", part).where("kind <> 'excluded'")
    in_part = Window.partitionBy(*on, "part").orderBy(order)
    so_far = in_part.rowsBetween(Window.unboundedPreceding, -1)
    # a line that stands beside a value is one only where a label, or nothing, comes before it
    held_before = F.coalesce(F.last(F.when(F.col("kind") != "continuation", F.col("kind")), True).over(so_far), F.lit("label"))
    beside = (F.col("kind") == "value") & low(F.col("line")).rlike(BESIDE) & (held_before == "value")
    t = t.withColumn("kind", F.when(beside, "continuation").otherwise(F.col("kind")))
    values = F.coalesce(F.sum((F.col("kind") == "value").cast("int")).over(so_far), F.lit(0))
    # what continues a value belongs to the value's row
    ended = F.coalesce(F.last(F.when(F.col("kind") != "continuation", F.col("kind")), True).over(so_far), F.lit("label")) == "value"
    row = values - F.when((F.col("kind") == "continuation") & ended, 1).otherwise(0)
    g = t.withColumn("row", row).groupBy(*keys, "part", "row").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "kind", "line"))).alias("all"))
    g = g.withColumn("v", F.array_position(F.transform("all", lambda x: x["kind"]), "value").cast("int")).where("v > 0")
    front = F.transform(F.slice("all", F.lit(1), F.col("v") - 1), lambda x: x["line"])
    g = g.withColumn("front", front).withColumn("text", F.array_join(F.transform("front", low), " "))
    heading = lambda x: ~low(x).rlike("[0-9]") & (held(low(x), HEADINGS) | ((x == F.upper(x)) & x.rlike("[A-Z]") & (F.size(F.split(low(x), " ")) <= 6)))
    joined = (F.size("front") > 0) & (F.size("front") <= 3) & (F.size(F.split("text", " ")) <= 10) & F.col("text").rlike("(?U)[\\p{Alpha}]") & ~F.exists("front", lambda x: low(x).endswith(":")) & ~held(F.col("text"), NOT_JOINED)
    first = F.array_position(F.transform("front", lambda x: ~heading(x)), True).cast("int")
    labels = F.when(joined & (first > 0), F.slice("front", first, F.size("front"))).otherwise(F.array().cast("array<string>"))
    rest = F.transform(F.slice("all", F.col("v"), F.size("all")), lambda x: x["line"])
    number = F.row_number().over(Window.partitionBy(*on).orderBy("part", "row")) - 1
    return g.select(*keys, number.alias("group"), F.concat(labels, rest).alias("lines"))


def measurement_groups(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines of a page grouped into measurements without a limit on labels: keys, group, lines.

    ``lines`` has ``line``, ``kind`` (value, label, continuation, index for a bare number of two digits), ``bearing`` (a number
    stands in it), ``excluded`` and ``unit_only``. A row has its value or has none: a value gives it one, the next value or
    label begins another row; a continuation changes nothing, an index is a value where the row has none. That is an
    automaton of two states in which labels and indexes set the state and values turn it over, so the state before a line is
    that of the last one to set it and the parity of the values since: two windows say it for every line.

    Excluded lines in front of a row's first value are left off. Rows without a number go in front of the next row with one,
    the nearest first, unless all of their lines are excluded; behind the last such row they are left out. A row that begins
    with a unit alone is part of the row before.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("kind")
    t = lines.select(*keys, order, "kind", "bearing", "excluded", "unit_only", "line")
    t = t.withColumn("values", F.coalesce(F.sum((k == "value").cast("int")).over(before), F.lit(0)))
    t = t.withColumn("set", F.last(F.when(k.isin("label", "index"), F.struct((k == "index").cast("int").alias("state"), F.col("values").alias("at"))), True).over(before))
    full = F.coalesce((F.col("set.state") + F.col("values") - F.col("set.at")) % 2, F.col("values") % 2) == 1
    t = t.withColumn("full", full).withColumn("row", F.sum((F.col("full") & k.isin("label", "value")).cast("int")).over(so_far))
    # excluded lines at the head of a row that has a value
    in_row = Window.partitionBy(*keys, "row").orderBy(order)
    first = (k == "value") & ~F.col("full") | (k == "index") & ~F.col("full")
    head = F.min((F.col("excluded")).cast("int")).over(in_row.rowsBetween(Window.unboundedPreceding, 0)) == 1
    seen = F.max(first.cast("int")).over(in_row.rowsBetween(Window.unboundedPreceding, 0)) == 1
    whole = Window.partitionBy(*keys, "row")
    t = t.withColumn("trimmed", head & ~seen & (F.max(first.cast("int")).over(whole) == 1)).where(~F.col("trimmed"))
    rows = t.groupBy(*keys, "row").agg(F.bool_or("bearing").alias("has"), F.bool_and("excluded").alias("none"), F.min_by("unit_only", order).alias("unit_first"))
    by_row = Window.partitionBy(*keys).orderBy("row")
    rows = rows.withColumn("target", F.first(F.when(F.col("has"), F.col("row")), True).over(by_row.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.where(F.col("target").isNotNull() & (F.col("has") | ~F.col("none")))
    # of the rows that go together the one that comes first says whether they begin with a unit
    heads = rows.groupBy(*keys, "target").agg(F.max_by("unit_first", F.struct((~F.col("has")).alias("label_only"), "row")).alias("unit_first"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("target"))
    heads = heads.withColumn("starts", ((number == 1) | ~F.col("unit_first")).cast("int"))
    heads = heads.withColumn("group", F.sum("starts").over(Window.partitionBy(*keys).orderBy("target").rowsBetween(Window.unboundedPreceding, 0)) - 1).select(*keys, "target", "group")
    placed = t.select(*keys, order, "row", "line").join(rows.select(*keys, "row", "has", "target"), [*keys, "row"]).join(heads, [*keys, "target"])
    entry = F.struct("target", F.col("has"), (-F.col("row")).alias("back"), F.col(order).alias("at"), "line")
    return placed.groupBy(*keys, "group").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["line"]).alias("lines"))


def greedy_clusters(rows: DataFrame, keys: list[str], order: str, label: str, score: str, id_col: str) -> DataFrame:
    """In one pass over each group, in order: a row joins the first cluster a member of which overlaps it (one label holds the other); each cluster keeps its best row.

    Comes out as id, kept_id. A group must fit a task: give it a page.
    """
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(table):
        data = sorted(zip(*(table.column(c).to_pylist() for c in (order, id_col, label, score)), strict=True), key=lambda r: (r[0], r[1]))
        used, out = set(), []
        for i in range(len(data)):
            if i in used:
                continue
            # labels are compared once, however many rows bear them: those of the members, and up to where another was held against them
            members, labels, seen, held = [i], [data[i][2]], {data[i][2]}, {}
            for j in range(i + 1, len(data)):
                if j in used:
                    continue
                text = data[j][2]
                if text not in seen or not text:
                    at = held.get(text, 0)
                    while at < len(labels) and not _overlap(labels[at], text):
                        at += 1
                    held[text] = at
                    if at == len(labels):
                        continue
                    seen.add(text)
                    labels.append(text)
                members.append(j)
            best = max(members, key=lambda m: (data[m][3], -m))
            out += [(data[m][1], data[best][1]) for m in members]
            used.update(members)
        kind = table.schema.field(id_col).type
        return pa.table({"id": pa.array([a for a, _ in out], kind), "kept_id": pa.array([b for _, b in out], kind)})

    return rows.select(*keys, order, id_col, label, score).groupBy(*keys).applyInArrow(run, f"id {id_type}, kept_id {id_type}")


def _overlap(a: str | None, b: str | None) -> bool:
    return bool(a) and bool(b) and (a in b or b in a)
