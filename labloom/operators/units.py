"""Quantities recorded in different units, brought to the canonical unit of their analyte.

A basic spelling or two of each part of a unit (prefix, base, divisor) are known, and put together by rule for the codes of
unit_dim. Of the spellings found in the data the distinct ones go through an inverted index of character n-grams, which gives
the few known spellings that share enough of them; those are verified by a weighted edit distance, in which confused
characters, plurals and letters within a word cost little, symbols and prefixes much, and digits never change; a well-formed
unit is never taken for another. The outcome, an alias dictionary of one row for each distinct spelling, is joined to all
rows, and each row takes the nearest code that its analyte can be printed in. The unit comes from the unit field, or else
from behind the number in the value, from behind the number in the printed line, or from the reference range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labloom.functions.text import ascii_forms, one_spaced

#: How parts of unit codes are written, each in one number and one spelling; what else is met is mapped by likeness.
PREFIXES = {"": [""], "k": ["k", "kilo"], "m": ["m", "milli"], "u": ["u", "mc", "micro"], "n": ["n", "nano"], "p": ["p", "pico"]}
BASES = {
    "g": ["g", "gm", "gram"],
    "mol": ["mol", "mole"],
    "U": ["u", "iu", "unit", "enzyme unit"],
    "kat": ["kat", "katal"],
    "[IU]": ["[iu]", "iu", "u", "unit", "int. unit", "international unit"],
}
PER = {"L": ["/l", "/litre", " l-1"], "dL": ["/dl", "/decilitre", " dl-1", "/100ml", "%"], "mL": ["/ml", "/millilitre", " ml-1", "/cc"], "uL": ["/ul", "/microlitre", "/mm3", "/cmm", "/cubic millimetre"]}
COUNTS = {
    "10*3": ["k", "thou", "thousand", "thousand cell"],
    "10*6": ["m", "mill", "mio", "million", "million cell"],
    "10*9": ["g", "giga", "gpt", "billion", "billion cell"],
    "10*12": ["t", "tera", "tpt", "trillion cell"],
    "": ["", "cell"],
}
WHOLE = {
    "%": ["%", "pct", "percent", "per cent"],
    "L/L": ["l/l", "litre/litre"],
    "mm[Hg]": ["mm[hg]", "mmhg", "torr", "millimetre of mercury"],
    "kPa": ["kpa", "kilopascal"],
    "s": ["s", "sec", "second"],
    "ms": ["ms", "msec", "millisecond"],
    "min": ["min", "minute"],
    "10*9/L": ["g/l cells", "giga/l"],
}


def basic_spellings(code: str) -> set[str]:
    """Spellings of a unit code, by rule, in lower case, that others are compared with; plurals, endings and typing errors aren't listed."""
    out = {code.lower(), *WHOLE.get(code, [])}
    if m := re.fullmatch(r"(k|m|u|n|p|)(g|mol|U|kat|\[IU\])/(L|dL|mL)", code):
        out |= {p + b + d for p, b, d in product(PREFIXES[m[1]], BASES[m[2]], PER[m[3]]) if d != "%" or m[2] == "g"}
        if m[2] == "mol" and m[3] == "L":
            out |= {p + "m" for p in PREFIXES[m[1]][:2]}
    if m := re.fullmatch(r"(10\*\d+|)/(L|uL)", code):
        heads = [*COUNTS.get(m[1], []), *(x + y + m[1][3:] for x in ("", "x") for y in ("10*", "10^", "10e", "10") if m[1])]
        out |= {h + d for h, d in product(heads, PER[m[2]])}
    return out


def spellings(code: str) -> set[str]:
    """All spellings of a unit code, by rule: the basic ones with what running text makes of them, 'per' for the stroke, plurals, endings in -er."""
    out = set()
    for s in basic_spellings(code):
        for t in {s, re.sub("^/", "per ", s).replace("/", " per ")}:
            for u in {t, re.sub(r"(?<=[a-z])([a-z]{2,}|g|gm)(?= per |[/%]| [dm]?l-1|$)|^(gm?)(?= per |/)", r"\g<0>s", t, count=1)}:
                out |= {v for w in (u, re.sub("^milli(?!m|l)", "milli-", u)) for v in (w, re.sub("(lit|met)re", r"\1er", w))}
    return out


def text_pattern() -> str:
    """One pattern for a unit in running text, in lower case, put together from the parts; it may allow more than the spellings.

    Words may bear a plural or a hyphen, the stroke may be written 'per', litre and metre may end in -er.
    """

    def spaced(s: str) -> str:
        per, s = s.startswith("/"), s.removeprefix("/")
        words = [re.escape(w) + ("s?-?" if w.isalpha() and (len(w) > 2 or w in ("g", "gm")) else "") for w in re.findall(r"[A-Za-z]+|\d+|[^\sA-Za-z\d]", s)]
        return ("(?:/|per ) ?" if per else "") + re.sub(r"(lit|met)re", r"\1(?:re|er)", " ?".join(words))

    def one_of(values) -> str:
        return "(?:" + "|".join(spaced(v) for v in sorted({v for v in values if v}, key=lambda v: (-len(v), v))) + ")"

    prefix, base = one_of(x for v in PREFIXES.values() for x in v), one_of(x for v in BASES.values() for x in v)
    per, count = one_of(x for v in PER.values() for x in v), one_of(x for v in COUNTS.values() for x in v)
    whole = one_of([*(x for v in WHOLE.values() for x in v), "l per l", "litre per litre", "mm hg", "m[iu]/l", "u[iu]/ml"])
    return f"(?:{whole}|{prefix}? ?{base} ?{per}|(?:x ?)?10 ?[*^e ]? ?[0-9]+ ?{per}|{count}? ?{per}|{prefix}m)"


#: Keys of fewer characters are short symbols.
SHORT = 8
#: Up to so many different spellings the alias dictionary is sent to every task; a longer one is joined by shuffling both sides.
MOST_BROADCAST = 100_000
SALTS = 16
#: Characters that scanners and hands confuse, in groups.
CONFUSED = ["1l|!i", "0o", "gq9", "5s", "8b", "vu"]
_ALIKE = {(a, b) for group in CONFUSED for a in group for b in group if a != b}
_WORDS = re.compile("mol|gram|unit|katal|litre|metre|second|minute|pascal|cell|thousand|million|billion|trillion|mercury|enzyme|international")


def unit_key(c: Column) -> Column:
    """A spelling without what doesn't matter: case, spaces, full stops, the sign for micro, 'per' for the stroke."""
    s = F.lower(F.translate(ascii_forms(c), "µμ×", "uux"))
    return F.regexp_replace(F.regexp_replace(s, r"(^|\s)per\s+", "/"), r"[\s.]+", "")


def _key(s: str) -> str:
    return re.sub(r"[\s.]+", "", re.sub(r"(^|\s)per\s+", "/", s.lower()))


def another(key: str, spelling: str) -> bool:
    """Whether a key is a unit of its own, put together from the parts, and not the plural of the spelling."""
    one = re.sub(r"(?<=[a-z]{3})s(?=/|$)", "", key)
    return one != spelling and bool(_WELL_FORMED.fullmatch(one))


def _one_of(values) -> str:
    return "(?:" + "|".join(re.escape(_key(v)) for v in sorted({v for v in values if v})) + ")"


_PER = _one_of(x for v in PER.values() for x in v)
_WELL_FORMED = re.compile(f"{_one_of(x for v in PREFIXES.values() for x in v)}?{_one_of(x for v in BASES.values() for x in v)}{_PER}|x?10[*^e]?[0-9]+{_PER}|{_one_of(x for v in WHOLE.values() for x in v)}")


def weights(spelling: str) -> list[float]:
    """What a change costs at each place of a spelling: 0.5 within a word that could be guessed, 1 in other letters, 2 in symbols of one or two letters."""
    out = [1.0] * len(spelling)
    for m in re.finditer("[a-z]+", spelling):
        if len(m[0]) < 3:
            out[m.start() : m.end()] = [2.0] * len(m[0])
    for m in _WORDS.finditer(spelling):
        out[m.start() : m.end()] = [0.5] * len(m[0])
    return out


def unit_distance(key: str, spelling: str) -> float:
    """Weighted Damerau-Levenshtein distance of a key from a spelling.

    Confused characters cost 0.25, a plural or a hyphen too; neighbours exchanged, a letter doubled or not, and a lost
    stroke 0.5; other changes by ``weights``, twice that for the first character. Digits never change.
    """
    a, b, w = key, spelling, weights(spelling)
    digit = lambda c: c.isdigit() and c.isascii()

    def exchanged(i: int, j: int) -> float:
        x, y = a[i], b[j]
        if x == y:
            return 0.0
        if digit(x) and digit(y):
            return 9.0
        if (x, y) in _ALIKE:
            return 0.25
        return 9.0 if digit(y) else w[j] * (1 + (j == 0))

    def added(i: int, j: int) -> float:  # a[i], with b[:j] behind it
        x = a[i]
        if digit(x):
            return 9.0
        if x == "-" or x == "s" and i >= 2 and a[i - 1].isalpha() and (i + 1 == len(a) or not a[i + 1].isalpha()):
            return 0.25
        if i and a[i - 1] == x and x.isalpha():
            return 0.5
        inside = 0 < j < len(b) and w[j - 1] == w[j] == 0.5
        return 0.5 if inside else 2.0

    def lost(j: int) -> float:
        y = b[j]
        if digit(y):
            return 9.0
        if y == "/" and j:
            return 0.5
        return min(w[j], 0.5 if j and b[j - 1] == y else 9.0) * (1 + (j == 0))

    two, one = None, [0.0]
    for j in range(len(b)):
        one.append(one[-1] + lost(j))
    for i in range(len(a)):
        row = [one[0] + added(i, 0)]
        for j in range(len(b)):
            cost = min(one[j] + exchanged(i, j), one[j + 1] + added(i, j + 1), row[j] + lost(j))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j] and a[i] != a[i - 1] and not digit(a[i]) and not digit(a[i - 1]):
                cost = min(cost, two[j - 1] + 0.5)
            row.append(cost)
        two, one = one, row
    return one[-1]


def allowed(length: int) -> float:
    """The greatest distance for a key of that many characters."""
    return 0.25 if length < 4 else 0.5 if length < SHORT else 1.0 if length < 12 else 2.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over candidate pairs (key, spelling): those within the bound, with their distance."""
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        good = [(k, s, d) for k, s in pairs if not another(k, s) and (d := unit_distance(k, s)) <= allowed(len(k))]
        columns = list(zip(*good, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["key", "spelling", "distance"])


def alias_dictionary(spark: SparkSession, found: DataFrame, codes: list[str]) -> DataFrame:
    """``found`` has distinct unit keys in column ``key``; comes out as (key, codes array<struct<distance, code, spelling>>), nearest first.

    Keys that fit no code give no row. Exact spellings have distance 0 and are taken alone. The inverted index has character
    n-grams of every spelling: bigrams for short keys, trigrams for the others; spellings that share half of them (Dice) are verified.
    """
    known = sorted({(_key(s), c) for c in codes for s in basic_spellings(c)})
    by_spelling = spark.createDataFrame(known, "spelling string, code string")
    exact = found.join(F.broadcast(by_spelling.withColumnRenamed("spelling", "key")), "key").select("key", "code", F.lit(0.0).alias("distance"), F.col("key").alias("spelling"))
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) + 3 - n, F.lit(1))), lambda i: F.substring(F.concat(F.lit("^"), c, F.lit("$")), i, F.lit(n))))
    sized = lambda df, c: df.withColumn("gram", F.explode("grams")).select(*c, F.size("grams").alias("of_" + c[0]), "gram")
    index = by_spelling.select("spelling").distinct()
    index = sized(index.withColumn("grams", grams(F.col("spelling"), 2)).unionByName(index.withColumn("grams", grams(F.col("spelling"), 3))), ["spelling"])
    odd = found.where("key <> ''").join(F.broadcast(by_spelling.select(F.col("spelling").alias("key")).distinct()), "key", "left_anti")
    odd = sized(odd.withColumn("grams", F.when(F.length("key") < SHORT, grams(F.col("key"), 2)).otherwise(grams(F.col("key"), 3))), ["key"])
    pairs = odd.join(index, "gram").groupBy("key", "spelling").agg(F.count("*").alias("both"), F.first("of_key").alias("k"), F.first("of_spelling").alias("n"))
    pairs = pairs.where(4 * F.col("both") >= F.col("k") + F.col("n")).select("key", "spelling")
    near = pairs.mapInArrow(_verify, "key string, spelling string, distance double").join(F.broadcast(by_spelling), "spelling").select("key", "code", "distance", "spelling")
    hit = exact.unionByName(near).groupBy("key", "code").agg(F.min(F.struct("distance", "spelling")).alias("m")).select("key", F.struct("m.distance", "code", "m.spelling").alias("x"))
    return hit.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("codes"))


NUMBER = r"[0-9]{1,3}(?: [0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?"
VALUE = rf"^[<>=≤≥~ ]*({NUMBER})(?![0-9])\s*(.*)$"


def number(text: Column) -> Column:
    """The number at the start of a value, behind a comparator: a space groups thousands, point and comma are decimal; null if none."""
    digits = F.regexp_extract(text, VALUE, 1)
    return F.when(digits != "", F.replace(F.replace(digits, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).cast("double"))


def convert(value: Column, unit_kind: Column, unit_factor: Column, kind: Column, factor: Column, molar_weight: Column) -> Column:
    """A value in another unit: by the factors within a kind, through the molar weight between mass and amount; else null."""
    base = value * unit_factor
    return (
        F.when(unit_kind == kind, base / factor)
        .when((unit_kind == "mass") & (kind == "molar") & (molar_weight > 0), base / molar_weight / factor)
        .when((unit_kind == "molar") & (kind == "mass") & (molar_weight > 0), base * molar_weight / factor)
    )


def recorded_units(observation: DataFrame, rules: DataFrame, unit_dim: DataFrame) -> DataFrame:
    """One row for each observation with an accepted code of the list: observation_id, value, recorded_unit, canonical_unit, canonical_value.

    value is null where the value is no number; recorded_unit where no unit is printed or it fits no code of the analyte;
    canonical_value where either is null or no conversion exists. Repeated rows give repeated rows. An empty rule list
    gives no row. Rows are read and their texts searched once; the dictionary is broadcast if it is small enough, else rows
    and dictionary are shuffled with the rows of a frequent spelling, or of none, spread over SALTS groups.
    """
    from labloom.session import cut, listed_units

    spark = observation.sparkSession
    dim = [(r["ucum_code"], r["kind"], float(r["factor_to_base"])) for r in listed_units(unit_dim, "ucum_code", "kind", "factor_to_base")]
    codes = sorted({c for c, _, _ in dim})
    of = lambda i: F.create_map(*[F.lit(x) for d in dim for x in (d[0], d[i])]) if dim else F.create_map().cast("map<string,string>" if i == 1 else "map<string,double>")
    listed = rules.groupBy("candidate_code").agg(F.first("expected_ucum_units", True).alias("expected"), F.first("canonical_unit_ucum", True).alias("to_unit"), F.first("molar_weight", True).alias("molar_weight"))
    rows = observation.select(F.col("id").alias("observation_id"), F.col("accepted_analyte_code").alias("candidate_code"), "raw_unit_string", *[one_spaced(ascii_forms(F.col(c))).alias(c) for c in ("raw_value_string", "raw_text", "raw_reference_range")])
    rows = rows.join(listed, "candidate_code")
    any_unit = "(?i)" + text_pattern()
    micro = lambda c: F.translate(c, "µμ", "uu")
    behind = F.trim(F.regexp_extract("raw_value_string", VALUE, 2))
    # in the line: what stands behind the number, flags and bars passed over
    line = F.concat(F.lit(" "), F.when(F.length("raw_reference_range") > 0, F.replace("raw_text", "raw_reference_range", F.lit(" "))).otherwise(F.col("raw_text")), F.lit(" "))
    sought = F.concat(F.lit(" "), F.col("raw_value_string"), F.lit(" "))
    place = F.position(sought, line)
    after = F.when(place > 0, F.substring(line, place + F.length(sought), F.length(line)))
    text_unit = F.regexp_extract(micro(after), rf"{any_unit.replace('(?i)', '(?i)^(?:[ |*]|[HL](?= ))*?(')})(?=$|[ |(,;])", 1)
    range_unit = F.regexp_extract(micro(F.col("raw_reference_range")), rf"{any_unit.replace('(?i)', '(?i)[0-9] ?(')})(?=$|[ (,;])", 1)
    printed = F.when(F.trim("raw_unit_string") != "", F.col("raw_unit_string")).when(behind != "", behind)
    rows = rows.withColumn("printed", printed)
    rows = rows.withColumn("printed", F.when(F.col("printed").isNotNull(), F.col("printed")).when(text_unit != "", text_unit).when(range_unit != "", range_unit))
    rows = rows.select("observation_id", "to_unit", "molar_weight", "expected", number(F.col("raw_value_string")).alias("value"), unit_key(F.col("printed")).alias("key"))
    rows = cut(rows)
    aliases = cut(alias_dictionary(spark, rows.where("key is not null").select("key").distinct(), codes))
    if aliases.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(aliases), "key", "left")
    else:
        salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt("observation_id")).join(aliases.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left").drop("salt")
    fits = F.filter("codes", lambda x: F.array_contains(F.col("expected"), x["code"]))
    first = F.get(fits, F.lit(0))
    unsure = (first["distance"] > 0) & F.exists(fits, lambda x: (x["distance"] < first["distance"] + 0.25) & (x["spelling"] != first["spelling"]) & (x["code"] != first["code"]))
    rows = rows.withColumn("recorded_unit", F.when((F.size(fits) > 0) & ~unsure, fits[0]["code"]))
    value = convert(F.col("value"), of(1)[F.col("recorded_unit")], of(2)[F.col("recorded_unit")], of(1)[F.col("to_unit")], of(2)[F.col("to_unit")], F.col("molar_weight"))
    return rows.select("observation_id", "value", "recorded_unit", F.col("to_unit").alias("canonical_unit"), value.alias("canonical_value"))


def other_units(observation: DataFrame, rules: DataFrame, unit_dim: DataFrame) -> DataFrame:
    """(observation_id, recorded_unit) of observations with a number whose printed unit is another code than the canonical one and can be converted."""
    rows = recorded_units(observation, rules, unit_dim)
    return rows.where("value is not null and canonical_value is not null and recorded_unit <> canonical_unit").select("observation_id", "recorded_unit")
