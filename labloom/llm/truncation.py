"""Fields that lost their end, and how often each source loses ends.

1. Every field is brought into plain form with its numbers as '#', and held against the printed line of its own row: a
   field whose every place in the line goes on behind its end was cut.
2. Near-copies: distinct texts, and their shapes (words before a colon or a bound as L, units as U), meet all those that go
   on behind them: in the order of equal beginnings, at lengths that grow by half, what goes on character by character; by
   a piece that the edits left intact, what is aligned as a whole with one edit in ten characters. Every such pair is found,
   whatever stands between the two in the order. Where others go on behind the end of the alignment, and rows and
   sources seldom end there, the text was cut. Numbers are masked there because copies of one printed form bear numbers of
   their own; what numbers lost is found by step 4. No pairs are emitted: a text is counted against its group.
3. Texts without such a copy are scored by terminality: how often the word that closes them closes texts at all, against
   the texts it stands in and the longer words it begins (counted by the same operator). Units written as the rules for
   units allow are whole, their beginnings aren't.
4. An interval that falls lost digits, and so did one that goes on with more digits in at least twenty times as many texts
   and stands in the middle of none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labloom.llm.plain import connect, plain_query, to_plain
from labloom.operators.units import spellings

FIELDS = ["raw_value_string", "raw_unit_string", "raw_reference_range"]
#: Edits in an alignment, at most.
MOST_EDITS = 3
#: What is aligned: texts, their shapes, and words.
TEXTS, SHAPES, WORDS = range(3)
#: A shape or word that ends fewer than this share of the texts it stands in is no end.
LEAST_TERMINALITY = 0.2
#: Nor is one that ends less than half of them and does so in less than this share of the sources it stands in.
LEAST_SOURCES = 0.34
#: A closing word that ends fewer than this share of a field's texts, and of whom nothing else is known, is no end.
LEAST_SUPPORT = 0.0005
SALTS = 16

NUMBER = re.compile(r"\d+(?: \d{3}(?!\d))*(?:[.,]\d+)*")
PAIR = re.compile(r"(?<!\d)(\d+(?: \d{3})*(?:[.,]\d+)?) ?(?:-|–|to) ?(\d+(?: \d{3})*(?:[.,]\d+)?)")
INTERVAL = re.compile(PAIR.pattern + "$")
TOKEN = re.compile(r"[^\W\d_]+|\s+|.", re.S)


def unit_keys(codes: list[str]) -> frozenset[str]:
    """Known spellings of units, without case, spaces and numbers."""
    return frozenset(NUMBER.sub("#", re.sub(r"\s+", "", s.lower())) for c in codes for s in spellings(c))


def _unit_end(tokens: list[str], start: int, units: frozenset[str]) -> int:
    """The end of the longest known unit that begins at a token, or start."""
    best, key = start, ""
    for i in range(start, min(len(tokens), start + 12)):
        key += tokens[i].strip().lower().replace("μ", "u")
        if key in units and tokens[i].strip():
            best = i + 1
    return best


def closing_words(text: str) -> list[str]:
    """The words of a text without the marks that may follow them."""
    return [w for t in text.split() if (w := t.rstrip(").;:,") or t)]


def falls(text: str) -> bool:
    """Whether a text ends in an interval whose upper bound is below the lower one: its last number lost digits."""
    m = INTERVAL.search(text)
    low, high = (float(x.replace(" ", "").replace(",", ".")) for x in m.groups()) if m else (0.0, 0.0)
    return high < low


def intervals(text: str) -> list[str]:
    """The intervals of a text as low|high; the last one is followed by another entry, '', if the text goes on behind it."""
    found = list(PAIR.finditer(text))
    return [f"{m[1]}|{m[2]}" for m in found] + ([""] if found and found[-1].end() < len(text) else [])


def shape(text: str, units: frozenset[str]) -> tuple[list[str], str]:
    """The tokens of a text with labels as L and units as U, and its closing word as it stands."""
    tokens = TOKEN.findall(text.rstrip(".") or text)  # a full stop at the end may stand or not
    out, i, fresh = [], 0, True
    while i < len(tokens):
        t = tokens[i]
        if t.isspace():
            i += 1
            continue
        if fresh and t.isalpha():
            j = i
            while j < len(tokens) and (tokens[j].isalpha() and tokens[j] != "up" or tokens[j].isspace()):
                j += 1
            if j < len(tokens) and (tokens[j] in ":#<>≥≤" or tokens[j] == "up"):
                out.append("L")
                i, fresh = j, False
                continue
        if out and out[-1] in ("#", ")") and (j := _unit_end(tokens, i, units)) > i:
            out.append("U")
            i, fresh = j, False
            continue
        out.append(t)
        fresh = t in ";,"
        i += 1
    words = closing_words(text)
    return out, words[-1] if words else ""


def cut_in_line(text: str, line: str | None) -> bool:
    """Whether the text stands in the line, and goes on there at every place."""
    if not line or len(text) < 2:
        return False
    at, seen = line.find(text), False
    while at >= 0:
        end = at + len(text)
        if at == 0 or not (line[at - 1].isalpha() and text[0].isalpha()) or line[at - 1].isdigit():
            if end == len(line) or line[end].isspace() or line[end] == "|":
                return False
            if not (text[-1].isdigit() and (text[0].isdigit() or text[0] in "<>=") and line[end].isalpha()):
                seen = True
        at = line.find(text, at + 1)
    return seen


def number_goes_on(text: str, line: str | None) -> bool:
    """Whether a text that is a number alone, or one behind < or >, stands in the line as a beginning of longer numbers only."""
    if not line:
        return False
    n, seen = text.lstrip("<> "), False
    at = line.find(n)
    while at >= 0:
        inner = at > 0 and (line[at - 1].isalnum() or line[at - 1] == "_" or line[at - 1] in ".," and line[max(at - 2, 0)].isdigit())
        if not inner:
            on = line[at + len(n) : at + len(n) + 2]
            if not (on[:1].isdigit() or on[:1] in (".", ",") and on[1:].isdigit()):
                return False
            seen = True
        at = line.find(n, at + 1)
    return seen


def _fields(n_fields: int):
    """For mapInArrow: (id, source, line, fields...) -> (id, source, field, text without numbers, whether the line goes on).

    Values that are a number alone are whole unless the line goes on within the same number; they are left out.
    """
    query = plain_query()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, seen = connect(), {}

        def described(text: str) -> tuple[str, bool, bool, list[str]]:
            if len(seen) > 50_000:  # forgets, to stay small; nothing depends on it
                seen.clear()
            reduced = NUMBER.sub("#", text)
            out = reduced, reduced in ("#", "<#", "> #", "< #", ">#"), falls(text), intervals(text)
            if len(text) < 200:
                seen[text] = out
            return out

        types = [None, pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string())]
        for batch in batches:
            ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lines, *plain = (c.to_pylist() for c in to_plain(con, batch.columns[2 : 3 + n_fields], query))
            out = [[] for _ in types]
            for f in range(n_fields):
                for i, text in enumerate(plain[f]):
                    if text is None or not (text := text.strip()):
                        continue
                    reduced, alone, fallen, pairs = seen.get(text) or described(text)
                    goes_on = number_goes_on(text, lines[i]) if alone else fallen or cut_in_line(text, lines[i])
                    if alone and not goes_on:
                        continue
                    for column, x in zip(out, (ids[i], sources[i], f, reduced, goes_on, pairs), strict=True):
                        column.append(x)
            types[0] = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["id", "source", "field", "text", "goes_on", "pairs"])
        con.close()

    return run


def part_of_unit(text: str, units: frozenset[str], begins: frozenset[str]) -> bool:
    """Whether what stands behind the last number (or the whole text) is the beginning of a unit, three characters or more, but none itself."""
    tail = re.sub(r"\s+", "", text[text.rfind("#") + 1 :]).lower().replace("μ", "u")
    whole = re.sub(r"\s+", "", text).lower().replace("μ", "u")
    return len(tail) >= 3 and tail in begins and tail not in units and whole not in units


def _describe(units: frozenset[str]):
    """For mapInArrow over distinct texts (field, text, by): shape, closing word, whether it is a known unit or part of one, and all words."""
    begins = frozenset(u[:i] for u in units for i in range(3, len(u)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, words, known, part, every = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s, w = shape(text, units)
                shapes.append(" ".join([*s, ""]))
                words.append(w)
                every.append(closing_words(text))
                tokens = TOKEN.findall(text)
                known.append(s[-1:] == ["U"] or _unit_end(tokens, 0, units) == len(tokens) > 0)
                part.append(part_of_unit(text, units, begins))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.string()), pa.array(words, pa.string()), pa.array(known, pa.bool_()), pa.array(part, pa.bool_()), pa.array(every, pa.list_(pa.string()))], [*batch.schema.names, "shape", "word", "known", "part", "all"])

    return run


def levels(first: int = 1) -> list[tuple[int, int]]:
    """Lengths from first on that grow by half, each with the next: (1, 2), (2, 3), (3, 4), (4, 6), (6, 9), ... up to the longest string there can be."""
    out, n, longest = [], first, 2**31 - 8
    while n < longest:
        out.append((n, min(max(n + 1, n * 3 // 2), longest)))
        n = out[-1][1]
    return out


#: Levels at which texts are aligned with edits: all texts of a level, (size, next size), are allowed as many.
NOISY_LEVELS = [(10, 20), (20, 30), *levels(30)]


def aligned(a: str, b: str, edits: int) -> int:
    """Where in b the alignment of the whole of a ends, with at most so many characters exchanged, lost or added; -1 if there is none."""
    if b.startswith(a):
        return len(a)
    if not edits:
        return -1
    low, high = 0, min(len(a), len(b))
    while low < high:  # the first place where they differ
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    for x, y in ((1, 1), (1, 0), (0, 1)):
        if low + x <= len(a) and low + y <= len(b) and (end := aligned(a[low + x :], b[low + y :], edits - 1)) >= 0:
            return low + y + end
    return -1


def tolerance(kind: int, length: int) -> int:
    """Edits allowed in the alignment of a text: one in ten characters, MOST_EDITS at most; none in shapes and words."""
    return min(length // 10, MOST_EDITS) if kind == TEXTS else 0


def _continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over beginnings sorted by text: by source the rows that end with each whole text and that go on behind it, character by character.

    What goes on behind a text follows it in the order, so only the texts are held that the present one begins with. A full
    stop at the end may stand or not: rows that add no more than it to a text go on behind those held that are shorter.
    """
    held: list[tuple] = []  # (level, text, rows that end by source, rows that go on by source)
    done: list[tuple] = []

    def close() -> None:
        (field, kind, _), text, own, longer = held.pop()
        done.extend((field, kind, text, source, own.get(source, 0), longer.get(source, 0)) for source in {**own, **longer})
        if held:
            for source, m in longer.items():
                held[-1][3][source] = held[-1][3].get(source, 0) + m

    for batch in batches:
        for field, kind, size, text, reach, whole, source, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            level = (field, kind, size)
            while held and not (held[-1][0] == level and text.startswith(held[-1][1])):
                close()
            if whole:
                if not held or held[-1][1] != text:
                    held.append((level, text, {}, {}))
                held[-1][2][source] = held[-1][2].get(source, 0) + m
            for _, before, _, longer in reversed(held):
                if len(before) < reach:
                    longer[source] = longer.get(source, 0) + m
                    break
        yield _counted(done)
    while held:
        close()
    yield _counted(done)


COUNTED = "field int, kind int, text string, source string, ends bigint, goes_on bigint"


def _counted(done: list[tuple]) -> pa.RecordBatch:
    """The rows done so far, of the columns COUNTED; the list is emptied."""
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*done, strict=True)) or [()] * len(types)
    done.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["field", "kind", "text", "source", "ends", "goes_on"])


def pieces(size: int, edits: int) -> list[tuple[int, int]]:
    """The first so many characters in one piece more than edits: an alignment with so many leaves one whole."""
    return [(i * size // (edits + 1), (i + 1) * size // (edits + 1)) for i in range(edits + 1)]


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over beginnings (field, size, text, reach, whole, by): the pieces by which those meet that align with edits.

    Let piece i be the first one with no more than i edits before its end: it is intact, and behind exactly i edits. So a
    copy has it in its place or up to i characters beside it.
    """
    for batch in batches:
        keys = []
        for size, text, whole in zip(*(batch.column(c).to_pylist() for c in ("size", "text", "whole")), strict=True):
            own = {}
            for i, (start, stop) in enumerate(pieces(size, tolerance(TEXTS, size))):
                for shift in (0, *range(-i, 0), *range(1, i + 1)):
                    if stop + shift <= len(text):
                        own.setdefault((i, text[start + shift : stop + shift]), whole and not shift)
            keys.append([{"at": i, "piece": piece, "first": first} for (i, piece), first in own.items()])
        kind = pa.list_(pa.struct([("at", pa.int32()), ("piece", pa.string()), ("first", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, kind)], [*batch.schema.names, "keys"])


#: Fills up a row of characters.
NO_CHARACTER = 0xFFFFFFFF


def _matrix(texts: list[str]):
    """The characters of texts as a matrix, filled up with what equals none."""
    import numpy as np

    lengths = np.array([len(x) for x in texts])
    out = np.full((len(texts), lengths.max()), NO_CHARACTER, np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _pairs_of_characters(matrix, spread: int):
    """Which pairs of neighbouring characters each text has in which eight places, or with spread up to so many places beside, as 512 bits."""
    import numpy as np

    u = np.uint32
    hashed, at = matrix[:, :-1] * u(0x9E3779B1) ^ matrix[:, 1:] * u(0x85EBCA77), np.arange(matrix.shape[1] - 1)
    bits, there = np.zeros((len(matrix), 513), np.uint8), matrix[:, 1:] != NO_CHARACTER
    for shift in {-spread, spread}:
        bits[np.arange(len(matrix))[:, None], np.where(there, (hashed + ((at + shift) >> 3).astype(u) * u(0xC2B2AE35)) * u(0x27D4EB2F) >> u(23), u(512))] = 1
    return np.packbits(bits[:, :512], axis=1).view(np.uint64)


def _may_align(text, others, edits: int):
    """Which rows of a matrix of characters a text can be aligned with: by edits and diagonals how far it is used up at most."""
    import numpy as np

    n, wide, ahead = len(text), others.shape[1], {}
    for d in range(-edits, edits + 1):
        ahead[d] = np.full((len(others), n + 1), n, np.int32)  # the next place where they differ
        low, high = max(0, -d), max(max(0, -d), min(n, wide - d))
        places = np.arange(n)
        ahead[d][:, :n] = places
        ahead[d][:, low:high] = np.where(others[:, low + d : high + d] == text[low:high], n, places[low:high])
        ahead[d] = np.minimum.accumulate(ahead[d][:, ::-1], axis=1)[:, ::-1]
    rows = np.arange(len(others))
    far = {0: ahead[0][:, 0]}
    for _ in range(edits):
        now = {}
        for d in range(min(far) - 1, max(far) + 2):
            steps = [far[d] + 1] if d in far else []
            steps += [far[d + 1] + 1] if d + 1 in far else []
            steps += [far[d - 1]] if d - 1 in far else []
            now[d] = ahead[d][rows, np.minimum(np.maximum.reduce(steps), n)]
        far = now
    return np.maximum.reduce(list(far.values())) == n


#: Characters that are compared at once.
AT_ONCE = 1 << 20


def _noisy_continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over beginnings sorted by piece: by source the rows that go on behind each whole text in an alignment with edits.

    Each whole text is aligned with every beginning that has the piece, whatever their order; a pair that meets by several
    pieces counts at the first behind which the rest aligns. In large groups those are passed over before that lack more
    pairs of characters than edits explain, or that can't be aligned on any diagonal.
    """
    import numpy as np

    done: list[tuple] = []
    group: list[tuple] = []  # (text, reach, whether it is whole and has the piece in its place, lists of sources and rows, from, to)
    present = None

    def count() -> None:
        field, size, at, _ = present
        edits = tolerance(TEXTS, size)
        places = pieces(size, edits)
        wholes, others = [x for x in group if x[2]], [x for x in group if x[1] > size]
        group.clear()
        if not wholes or not others:
            return

        def meets(text: str, other: str, i: int) -> bool:
            start, stop = places[i]
            return any(other.startswith(text[start:stop], start + d) and aligned(text[start:], other[start + d :], edits - i) >= 0 for d in range(-i, i + 1))

        step = max(1, AT_ONCE // max(len(x[0]) for x in [*wholes, *others]))
        parts = lambda xs: (xs[i : i + step] for i in range(0, len(xs), step))
        for these, some in ((x, y) for x in parts(wholes) for y in parts(others)):
            if large := len(these) * len(some) > 32:
                own, matrix, reaches = _matrix([x[0] for x in these]), _matrix([x[0] for x in some]), np.array([x[1] for x in some])
                has, lacks = _pairs_of_characters(own, 0), ~_pairs_of_characters(matrix, edits)
            for k, (text, *_) in enumerate(these):
                near = range(len(some))
                if large:
                    near = np.flatnonzero((reaches > len(text)) & (np.bitwise_count(has[k] & lacks).sum(axis=1) <= 2 * edits))
                    if len(near) > 8:
                        near = near[_may_align(own[k, : len(text)], matrix[near, : len(text) + edits], edits)]
                    near = near.tolist()
                longer: dict = {}
                for j in near:
                    other, reach, _, sources, ms, start, stop = some[j]
                    # what goes on character by character is counted by _continuations
                    if reach <= len(text) or other.startswith(text) or at and not meets(text, other, at) or any(meets(text, other, i) for i in range(at)):
                        continue
                    # beyond an alignment with edits more must stand than the edits could explain; a full stop may stand or not
                    if (end := aligned(text, other, edits)) >= 0 and reach - end > edits:
                        for i in range(start, stop):
                            longer[sources[i]] = longer.get(sources[i], 0) + ms[i]
                done.extend((field, TEXTS, text, source, 0, m) for source, m in longer.items())

    for batch in batches:
        *columns, by = batch.columns
        offsets, counts = np.asarray(by.offsets), by.flatten()
        offsets, sources, ms = (offsets - offsets[0]).tolist(), counts.field("source").to_pylist(), counts.field("m").to_pylist()
        for field, size, at, piece, text, reach, first, start, stop in zip(*(c.to_pylist() for c in columns), offsets[:-1], offsets[1:], strict=True):
            if present != (key := (field, size, at, piece)):
                if group:
                    count()
                present = key
            group.append((text, reach, first, sources, ms, start, stop))
        yield _counted(done)
    if group:
        count()
    yield _counted(done)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions, though they be few bytes: what is done to each costs much. By range, so that what begins alike is together."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def near_copies(texts: DataFrame) -> DataFrame:
    """Of texts (field, kind, text, by array<struct<source, m>>) those that go on behind others.

    Comes out as (field, kind, text, ends, end_sources, goes_on, on_sources, sources): rows and sources that end with the
    text, that go on behind it in an alignment of its whole, and both. Every text and every continuation of it meet, at one
    of the lengths that grow by half: in the order of equal beginnings where they agree, by a piece that the edits left
    intact where they don't. At a length a text is needed only up to the next one, so what begins alike is added up. No
    pairs are emitted, and each counts once.
    """
    long, stripped = F.length("text"), F.expr("length(trim(TRAILING '.' FROM text))")
    listed = lambda sizes, more: F.filter(F.array(*[F.struct(F.lit(n).alias("size"), F.lit(m).alias("upto"), F.lit(more(n)).alias("more")) for n, m in sizes]), lambda s: s["size"] <= long)
    begun = lambda df, sizes, more: df.select("field", "kind", "text", "by", F.explode(listed(sizes, more)).alias("s")).select("field", "kind", "s.size", F.substring("text", F.lit(1), F.col("s.upto") + F.col("s.more")).alias("begin"), F.least(stripped, F.col("s.upto") + F.col("s.more")).alias("reach"), (long < F.col("s.upto")).alias("whole"), F.explode("by").alias("b")).select("*", "b.source", "b.m").drop("b")
    spread = _spread(texts, "field", "kind", "text")
    each = begun(spread, levels(), lambda _: 0).groupBy("field", "kind", "size", "begin", "reach", "whole", "source").agg(F.sum("m").alias("m"))
    level = ["field", "kind", "size"]
    exact = each.repartition(*level, F.substring("begin", F.lit(1), F.col("size"))).sortWithinPartitions(*level, "begin").select(*level, "begin", "reach", "whole", "source", "m").mapInArrow(_continuations, COUNTED)
    noisy = begun(spread.where(F.col("kind") == TEXTS), NOISY_LEVELS, lambda n: 2 * tolerance(TEXTS, n)).repartition("field", "size", "begin")
    one = ["field", "size", "begin", "reach", "whole"]
    noisy = noisy.groupBy(*one, "source").agg(F.sum("m").alias("m")).groupBy(*one).agg(F.collect_list(F.struct("source", "m")).alias("by"))
    by = "by array<struct<source:string,m:bigint>>"
    noisy = noisy.withColumnRenamed("begin", "text").mapInArrow(_cut_pieces, f"field int, size int, text string, reach int, whole boolean, {by}, keys array<struct<at:int,piece:string,first:boolean>>")
    key = ["field", "size", "at", "piece"]
    noisy = noisy.select("*", F.explode("keys").alias("k")).select("field", "size", "k.at", "k.piece", "text", "reach", "k.first", "by")
    noisy = noisy.repartition(*key).sortWithinPartitions(*key).mapInArrow(_noisy_continuations, COUNTED)
    found = exact.unionByName(noisy).groupBy("field", "kind", "text", "source").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    some = lambda c: F.count_if(F.col(c) > 0)
    return found.groupBy("field", "kind", "text").agg(F.sum("ends").alias("ends"), some("ends").alias("end_sources"), F.sum("goes_on").alias("goes_on"), some("goes_on").alias("on_sources"), F.count("*").alias("sources"))


def cut_texts(texts: DataFrame, units: frozenset[str]) -> DataFrame:
    """Of texts (field, source, text, n) those that lost their end: (field, text, copied), copied if a near-copy that goes on decided.

    Shares are taken of rows and of sources: a source that cuts and holds a third of all rows makes its cut words
    frequent, but no other source ends a text with them.
    """
    distinct = texts.groupBy("field", "text").agg(F.collect_list(F.struct("source", F.col("n").alias("m"))).alias("by"))
    by = "by array<struct<source:string,m:bigint>>"
    described = _cut(_spread(distinct, "field", "text").mapInArrow(_describe(units), f"field int, text string, {by}, shape string, word string, known boolean, part boolean, all array<string>"))
    total = texts.groupBy("field", "source").agg(F.sum("n").alias("n")).groupBy("field").agg(F.sum("n").alias("total"), F.count("*").alias("field_sources"))
    listed = lambda counted, key, kind: counted.groupBy("field", F.col(key).alias("text")).agg(F.collect_list(F.struct("source", "m")).alias("by")).select("field", F.lit(kind).alias("kind"), "text", "by")
    spread = described.select("field", "shape", "all", F.explode("by").alias("b")).select("field", "shape", "all", "b.source", "b.m")
    shapes = spread.groupBy("field", "source", "shape").agg(F.sum("m").alias("m"))
    words = spread.select("field", "source", "m", F.posexplode("all").alias("at", "word"), (F.size("all") - 1).alias("last"))
    words = words.groupBy("field", "source", "word").agg(F.sum(F.when(F.col("at") == F.col("last"), F.col("m")).otherwise(0)).alias("e"), F.sum("m").alias("m"))
    here = words.groupBy("field", "word").agg(F.sum("e").alias("word_ends"), F.sum("m").alias("word_all"), F.count_if(F.col("e") > 0).alias("word_end_sources"))
    near = _cut(near_copies(described.select("field", F.lit(TEXTS).alias("kind"), "text", "by").unionByName(listed(shapes, "shape", SHAPES)).unionByName(listed(words, "word", WORDS))))
    of_kind = lambda kind, key, name: near.where(F.col("kind") == kind).select("field", F.col("text").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("ends", "end_sources", "goes_on", "on_sources", "sources")])
    d = described.drop("by", "all").join(total, "field").join(of_kind(TEXTS, "text", "text"), ["field", "text"], "left").join(of_kind(SHAPES, "shape", "shape"), ["field", "shape"], "left")
    d = d.join(here, ["field", "word"], "left").join(of_kind(WORDS, "word", "longer").drop("longer_ends", "longer_end_sources"), ["field", "word"], "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    few = lambda share, own, every: (share < 0.5) & (own < LEAST_SOURCES * every)
    by_copy = of("text_ends") / (of("text_ends") + of("text_goes_on"))
    by_shape = of("shape_ends") / (of("shape_ends") + of("shape_goes_on"))
    by_word = of("word_ends") / (of("word_all") + of("longer_goes_on"))
    rare = (of("word_ends") < LEAST_SUPPORT * F.col("total")) & ~F.col("known")
    plain_end = F.col("word").rlike("#$") | F.col("known")
    # a near-copy goes on: does it seldom end there?
    early_shape = (of("shape_goes_on") > 0) & ((by_shape < LEAST_TERMINALITY) | few(by_shape, of("shape_end_sources"), of("shape_on_sources")))
    bad_word = ~plain_end & ((by_word < LEAST_TERMINALITY) | few(by_word, of("word_end_sources"), of("longer_sources")) | (rare & (of("longer_goes_on") > of("word_ends"))))
    early_text = (of("text_goes_on") > 0) & (bad_word | ~plain_end & ((by_copy < LEAST_TERMINALITY) | few(by_copy, of("text_end_sources"), of("text_on_sources"))))
    usual = (by_shape >= 0.5) & (of("shape_ends") >= 2 * LEAST_SUPPORT * F.col("total")) & (of("shape_end_sources") >= LEAST_SOURCES * F.col("field_sources"))
    short = rare & ~plain_end & (F.length("word") < 2)
    open_end = F.col("text").rlike("#[.,]$")
    # none goes on: the closing word
    alone = (of("text_goes_on") == 0) & (bad_word | short) & ~usual
    copied = early_shape | early_text
    return d.where(F.col("part") | open_end | copied | alone).select("field", "text", copied.alias("copied"))


def cut_pairs(found: DataFrame) -> DataFrame:
    """Intervals that only ever end a text and, with more digits to their upper bound, are at least twenty times as frequent: (pair)."""
    each = found.where("size(pairs) > 0").select(F.posexplode("pairs").alias("at", "pair"), (F.size("pairs") - 1).alias("last")).where("pair <> ''")
    pairs = each.groupBy("pair").agg(F.count("*").alias("n"), F.count_if(F.col("at") < F.col("last")).alias("inner"))
    bar = F.position(F.lit("|"), F.col("pair"))
    begins = pairs.select("n", "pair", F.explode(F.transform(F.sequence(bar + 1, F.length("pair")), lambda i: F.substring("pair", F.lit(1), i))).alias("begin")).where("begin <> pair")
    longer = begins.groupBy(F.col("begin").alias("pair")).agg(F.sum("n").alias("more"))
    return pairs.where("inner = 0").join(longer, "pair").where("n * 20 <= more").select("pair")


def cut_fields(rows: DataFrame, unit_dim: DataFrame, fields: list[str] = FIELDS, *, id_col: str = "id", source_col: str = "source_feed", line_col: str = "raw_text") -> DataFrame:
    """(row_id, field_name) of every field whose end was cut off. Rows may come from any number of sources.

    Null and blank fields aren't cut. A null line gives no evidence. Repeated rows give repeated rows; other columns are
    ignored. An empty unit_dim leaves units to be judged like other words.
    """
    from labloom.session import listed_units

    units = unit_keys([r["ucum_code"] for r in listed_units(unit_dim, "ucum_code")])
    chosen = rows.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(line_col).cast("string").alias("line"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    id_type = chosen.schema["id"].dataType.simpleString()
    found = _cut(chosen.mapInArrow(_fields(len(fields)), f"id {id_type}, source string, field int, text string, goes_on boolean, pairs array<string>"))
    texts = found.groupBy("field", F.coalesce("source", F.lit("")).alias("source"), "text").agg(F.count("*").alias("n"))
    flagged = _cut(cut_texts(texts, units).drop("copied")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_text = found.where("not goes_on").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(flagged, ["field", "text", "salt"])
    last = F.try_element_at("pairs", F.lit(-1))
    by_pair = found.where((F.size("pairs") > 0) & (last != "") & ~F.col("goes_on")).select("id", "field", "text", last.alias("pair"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    by_pair = by_pair.join(cut_pairs(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pair", "salt"])
    by_pair = by_pair.join(flagged, ["field", "text", "salt"], "left_anti")
    names = F.array(*[F.lit(f) for f in fields])
    out = by_pair.select("id", "field").unionByName(found.where("goes_on").select("id", "field")).unionByName(by_text.select("id", "field"))
    return out.select(F.col("id").alias("row_id"), F.get(names, F.col("field")).alias("field_name"))


def cut_rates(rows: DataFrame, unit_dim: DataFrame, fields: list[str] = FIELDS, *, id_col: str = "id", source_col: str = "source_feed") -> DataFrame:
    """(source, field_name, n_fields, n_cut, share): how often each source loses the end of each field. Rows must have unique ids."""
    long = rows.select(F.col(id_col).alias("row_id"), F.col(source_col).alias("source"), F.explode(F.array(*[F.when(F.trim(F.col(f)) != "", F.lit(f)) for f in fields])).alias("field_name")).where("field_name is not null")
    cut = cut_fields(rows, unit_dim, fields, id_col=id_col, source_col=source_col).distinct().withColumn("cut", F.lit(1))
    joined = long.join(cut, ["row_id", "field_name"], "left")
    return joined.groupBy("source", "field_name").agg(F.count("*").alias("n_fields"), F.count("cut").alias("n_cut"), (F.count("cut") / F.count("*")).alias("share"))


def _cut(df: DataFrame) -> DataFrame:
    from labloom.session import cut

    return cut(df)
