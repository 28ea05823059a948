"""Freely typed labels mapped to a reference list; what fits no entry is reported.

1. Trimmings (notes, counters, specimen marks and the like around a label) are learned from the labels themselves: what
   stands before or behind names of at least LEAST_SUPPORT entries, and has no word of any name, nor one like it, is a
   trimming.
2. A label is brought into plain form, its trimmings and units are taken off, and what is left is looked up: as it stands,
   with the parts around a comma exchanged, either side of a slash, without a last word that names of many entries have, as
   an abbreviation that ends in a full stop.
3. What isn't found goes through a symmetric-delete dictionary. Characters that scanners confuse are made one, so that only
   other edits count; all strings that up to three deletions make of the first characters of an entry and of the label meet
   in one lookup if their weighted distance is within the bound. The candidates are ranked by weighted Damerau-Levenshtein
   distance, in which confused characters cost half, then by how often rows already bear the entry.

The dictionary is broadcast, once for each executor; its size follows the reference list, which is checked. Nothing is
shuffled but counts: of entries, and of what stands around names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from labloom.llm.plain import connect, plain_query, to_plain

UNMAPPED = "__unmapped__"
#: The reference list is sent to every task; beyond so many names it must not be.
MAX_NAMES = 50_000
PREFIX, MAX_EDITS = 9, 3
#: Characters that scanners take for one another.
CONFUSED = ["o0a", "il1t", "s5", "ce", "nu", "tf", "bh", "g9q", "vu", "b8", "z2"]
#: What stands around names of so many entries is a trimming; a word in names of so many entries says nothing of what is measured.
LEAST_SUPPORT, GENERIC = 3, 4
#: Words of a trimming at most.
TRIMMING_WORDS = 3
MAX_TRIMMINGS = 10_000


def base(text: str) -> str:
    """Case and accents folded."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def letters(text: str) -> str:
    """Letters and digits of a folded text alone."""
    return re.sub(r"[\W_]+", "", text)


def key(text: str) -> str:
    """The same, with the commonest scanner confusions undone."""
    return letters(text).replace("rn", "m").replace("0", "o").replace("1", "l").replace("5", "s")


def _classes() -> dict[int, str]:
    """For every confused character the one that stands for all it may be taken for, directly or through others."""
    of: dict[str, set[str]] = {}
    for group in CONFUSED:
        joined = set(group).union(*(of.get(c, set()) for c in group))
        for c in joined:
            of[c] = joined
    return {ord(c): min(group) for c, group in of.items()}


_CLASSES = _classes()


def deletes(text: str, edits: int) -> set[str]:
    """All strings that up to ``edits`` deletions make of the first PREFIX characters, confused characters being one.

    Any edit but an exchange of confused characters costs 1 or more, so two texts within a weighted distance of ``edits`` have one in common.
    """
    p = text.translate(_CLASSES)[:PREFIX]
    out = {p}
    for n in range(1, min(edits, len(p)) + 1):
        out.update("".join(c) for c in combinations(p, len(p) - n))
    return out


def _shape(trimming: str) -> str:
    return re.sub(r"\d+", "#", trimming)


_CHEAP = {(a, b) for group in CONFUSED for a in group for b in group if a != b}


def distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein distance (neighbours exchanged: 1) with confused characters at one half; beyond ``most`` any greater number."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            cost = one[j - 1] + (0.0 if x == y else 0.5 if (x, y) in _CHEAP else 1.0)
            cost = min(cost, one[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def allowed(length: int) -> float:
    """The greatest distance for a label of that many characters."""
    return 0.5 if length <= 3 else 1.0 if length <= 5 else 2.0 if length <= 8 else 2.5 if length == 9 else 3.0


Trimmings = tuple[frozenset[str], frozenset[str]]


class Names:
    """The reference list, ready for lookups: names as (name, code, frequency of the code), units that may stand beside a label, and trimmings (before, behind)."""

    def __init__(self, names: list[tuple[str, str, int]], units: list[str], trimmings: Trimmings = (frozenset(), frozenset()), near: bool = True):
        self.by_key: dict[str, tuple[int, str]] = {}
        self.words = {k: len(name.split()) for name, _, _ in names for k in (key(base(name)), letters(base(name)))}
        codes: dict[str, set[str]] = {}
        for name, code, n in names:
            for k in {key(base(name)), letters(base(name))} - {""}:
                self.by_key[k] = max(self.by_key.get(k, (-1, code)), (n, code))
            for word in re.findall(r"[^\W_]+", base(name)):
                codes.setdefault(word, set()).add(code)
        self.vocabulary, self.generic = frozenset(codes), frozenset(w for w, c in codes.items() if len(c) >= GENERIC)
        self.deleted: dict[str, list[str]] = {}
        for k in self.by_key if near else ():
            for d in deletes(k, MAX_EDITS):
                self.deleted.setdefault(d, []).append(k)
        unit = "|".join(re.escape(base(u)) for u in sorted(units, key=len, reverse=True)) or r"(?!)"
        self.unit = re.compile(rf"(?:\s*\[(?:{unit})\]|\s*\((?:{unit})\)|,?\s+(?:{unit}))\s*$")
        self.before, self.behind = trimmings

    def trimmed(self, s: str) -> Iterator[tuple[bool, str, str]]:
        """What a label may have before (True) or behind (False) it, digits as '#', and the rest."""
        words = s.split(" ")
        if (at := words[0].find("-")) > 0 and at + 1 < len(words[0]):
            yield True, _shape(words[0][: at + 1]), s[at + 1 :]
        for n in range(1, min(TRIMMING_WORDS, len(words) - 1) + 1):
            yield True, _shape(" ".join(words[:n])), " ".join(words[n:])
            yield False, _shape(" ".join(words[-n:])), " ".join(words[:-n])

    def learn(self, label: str | None) -> Iterator[tuple[bool, str, str]]:
        """(before, trimming, code) for what stands around a name in a label that isn't one itself."""
        if not label or self.exact(s := " ".join(base(label).split())):
            return
        for before, trimming, rest in self.trimmed(s):
            if not set(re.findall(r"[^\W_]+", trimming)) & self.vocabulary and not self.unit.search(" x " + trimming) and (code := self.exact(rest)):
                yield before, trimming, code

    def stripped(self, label: str) -> str:
        s = " ".join(base(label).split())
        while True:
            t = re.sub(r"^[\W_]+", "", self.unit.sub("", s)).strip(" ").rstrip(" *:")
            for before, trimming, rest in self.trimmed(t) if t == s else ():
                if trimming in (self.before if before else self.behind):
                    t = rest
                    break
            if t == s or not t:
                return t
            s = t

    def forms(self, s: str) -> list[str]:
        """What a label may mean: itself, either side of a slash, parts around a comma exchanged or without a generic last part, without a last number or generic word."""
        out = [s]
        if " / " in s:
            out += [p for p in s.split(" / ") if p.strip()]
        for f in list(out):
            if "," in f:
                head, _, tail = f.partition(",")
                out += [f"{tail.strip()} {head.strip()}", *([head.strip()] if tail.strip() in self.generic else [])]
        for f in list(out):
            f = re.sub(r"(?<=\S)\s+\d+$", "", f)
            head, _, last = f.rpartition(" ")
            out += [x for x in (f, head.strip() if last in self.generic else "") if x and x not in out]
        return out

    def exact(self, form: str) -> str | None:
        hit = self.by_key.get(k := key(form))
        if hit is None and form.endswith(".") and len(k) >= 5:
            longer = {(words == len(form.split()), self.by_key[n][1]) for n, words in self.words.items() if n.startswith(k)}
            longer = {code for alike, code in longer if alike} or {code for _, code in longer}
            return longer.pop() if len(longer) == 1 else None
        return hit[1] if hit else None

    def close(self, form: str) -> tuple[float, int, str] | None:
        best, own = None, letters(" ".join(w for w in form.split(" ") if w.strip(",:.") not in self.generic))
        for k in {key(form), letters(form)} - {""}:
            most = min(allowed(len(k)), 0.5) if 0 < len(own) <= 2 else allowed(len(k))
            for n in {n for d in deletes(k, MAX_EDITS) for n in self.deleted.get(d, ())}:
                limit = min(most, allowed(len(n)))
                if (d := distance(k, n, limit)) <= limit:
                    freq, code = self.by_key[n]
                    best = min(best or (d, -freq, code), (d, -freq, code))
        return best

    def code(self, label: str | None) -> str:
        """The code a label in plain form means, or UNMAPPED."""
        if not label or not (s := self.stripped(label)):
            return UNMAPPED
        forms = self.forms(s)
        for f in forms:
            if code := self.exact(f):
                return code
        found = [c for f in forms if (c := self.close(f))]
        return min(found)[2] if found else UNMAPPED


def _learn_batches(names: Broadcast, units: list[str]):
    """For mapInArrow over (label): (before, trimming, code)."""
    query = plain_query()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, known = connect(), Names(names.value, units, near=False)
        for batch in batches:
            found = [x for label in to_plain(con, [batch.column(0)], query)[0].to_pylist() for x in known.learn(label)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.string(), pa.string()), strict=True)], ["before", "trimming", "code"])
        con.close()

    return run


def trimmings(labels: DataFrame, names: Broadcast, units: list[str]) -> Trimmings:
    """What stands around names of at least LEAST_SUPPORT entries in labels (one string column), as (before, behind); more than MAX_TRIMMINGS raise."""
    found = labels.distinct().mapInArrow(_learn_batches(names, units), "before boolean, trimming string, code string")
    found = found.distinct().groupBy("before", "trimming").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SUPPORT)
    listed = found.select("before", "trimming").limit(MAX_TRIMMINGS + 1).collect()
    if len(listed) > MAX_TRIMMINGS:
        raise ValueError(f"more than {MAX_TRIMMINGS} trimmings")
    vocabulary: dict[str, list[str]] = {}
    for word in Names(names.value, units, near=False).vocabulary:
        for d in deletes(word, 1):
            vocabulary.setdefault(d, []).append(word)
    mistyped = lambda w: len(w) > 3 and any(len(v) > 3 and distance(w, v, 1.0) <= 1.0 for d in deletes(w, 1) for v in vocabulary.get(d, ()))
    own = lambda t: not any(map(mistyped, re.findall(r"[^\W_]+", t)))
    return frozenset(r.trimming for r in listed if r.before and own(r.trimming)), frozenset(r.trimming for r in listed if not r.before and own(r.trimming))


def _map_batches(names: Broadcast, units: list[str], around: Trimmings):
    query = plain_query()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, seen = connect(), {}
        # the broadcast stays in its Python process, and the dictionary built from it with it
        kept = names.__dict__.setdefault("_built", {})
        if (known := kept.get(around)) is None:
            known = kept[around] = Names(names.value, units, around)
        for batch in batches:
            codes = []
            for label in to_plain(con, [batch.column(1)], query)[0].to_pylist():
                if label not in seen:
                    if len(seen) > 200_000:  # forgets, to stay small; codes don't depend on it
                        seen.clear()
                    seen[label] = known.code(label)
                codes.append(seen[label])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string())], ["_id", "code"])
        con.close()

    return run


def map_labels(rows: DataFrame, names: DataFrame, units: list[str], *, id_col: str = "id", label_col: str = "raw_analyte_label", frequencies: DataFrame | None = None) -> DataFrame:
    """(id, candidate_code) for every row; UNMAPPED where the label is null, empty or means no name of the list.

    ``names`` has candidate_code and name; ``frequencies`` candidate_code and n (a null code is ignored). Repeated rows
    give repeated rows; other columns are ignored. An empty list of names leaves every row unmapped.
    """
    spark = rows.sparkSession
    listed = names.where("name is not null and candidate_code is not null").select("name", "candidate_code").distinct().limit(MAX_NAMES + 1).collect()
    if len(listed) > MAX_NAMES:
        raise ValueError(f"the reference list has more than {MAX_NAMES} names")
    freq = {r["candidate_code"]: r["n"] for r in (frequencies.where("candidate_code is not null").join(names.select("candidate_code").distinct(), "candidate_code").collect() if frequencies is not None else [])}
    sent = spark.sparkContext.broadcast(sorted((r["name"], r["candidate_code"], int(freq.get(r["candidate_code"], 0))) for r in listed))
    chosen = rows.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("label"))
    around = trimmings(chosen.select("label"), sent, units)
    done = chosen.mapInArrow(_map_batches(sent, units, around), f"_id {chosen.schema['_id'].dataType.simpleString()}, code string")
    return done.select(F.col("_id").alias(id_col), F.col("code").alias("candidate_code"))


def map_observations(observation: DataFrame, rules: DataFrame, unit_dim: DataFrame) -> DataFrame:
    """(observation_id, candidate_code) of observations without an accepted code."""
    names = rules.select("candidate_code", F.explode(F.concat(F.array("canonical_label", "candidate_display"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    from labloom.session import listed_units

    units = [r["ucum_code"] for r in listed_units(unit_dim, "ucum_code")]
    counts = observation.groupBy(F.col("accepted_analyte_code").alias("candidate_code")).agg(F.count("*").alias("n"))
    rows = observation.where("accepted_analyte_code is null")
    return map_labels(rows, names, units, frequencies=counts).withColumnRenamed("id", "observation_id")
