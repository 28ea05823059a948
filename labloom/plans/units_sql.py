"""Problem 4 as SQL for DuckDB: every written form listed by rule and matched exactly, where the operator maps spellings by likeness."""

from __future__ import annotations

import re
from itertools import product

from labloom.functions import text as tx
from labloom.plans.scalar_queries import Q

#: How parts of unit codes are written.
PREFIXES = {"": [""], "k": ["k", "kilo"], "m": ["m", "milli", "milli-"], "u": ["u", "mc", "micro"], "n": ["n", "nano"], "p": ["p", "pico"]}
BASES = {
    "g": ["g", "gm", "gms", "gs", "gram", "grams"],
    "mol": ["mol", "mole", "moles"],
    "U": ["u", "iu", "unit", "units", "enzyme units"],
    "kat": ["kat", "katal", "katals"],
    "[IU]": ["[iu]", "iu", "u", "unit", "units", "int. units", "international units"],
}
PER = {
    "L": ["/l", " per l", " per litre", " per liter", " l-1", "/litre", "/liter"],
    "dL": ["/dl", " per dl", " per decilitre", " per deciliter", " dl-1", "/100ml", "%"],
    "mL": ["/ml", " per ml", " per millilitre", " per milliliter", " ml-1", "/cc"],
    "uL": ["/ul", " per ul", " per microlitre", " per microliter", "/mm3", "/cmm", " per cubic millimetre", " per cubic millimeter"],
}
COUNTS = {
    "10*3": ["k", "thou", "thousand cells", "thousand", "thousands"],
    "10*6": ["m", "mill", "mio", "million cells", "million", "millions"],
    "10*9": ["giga", "g", "gpt", "billion cells", "billion"],
    "10*12": ["tera", "t", "tpt", "trillion cells"],
    "": ["", "cells", "cell"],
}
WHOLE = {
    "%": ["%", "pct", "percent", "per cent"],
    "L/L": ["l/l", "l per l", "litre per litre", "litre/litre", "liter per liter", "liter/liter"],
    "mm[Hg]": ["mm[hg]", "mmhg", "mm hg", "torr", "millimetres of mercury", "millimeters of mercury"],
    "kPa": ["kpa", "kilopascal", "kilopascals"],
    "s": ["s", "sec", "secs", "second", "seconds"],
    "ms": ["ms", "msec", "msecs", "millisecond", "milliseconds"],
    "min": ["min", "mins", "minute", "minutes"],
    "10*9/L": ["g/l cells", "giga/l"],
    "10*12/L": ["tera/l"],
}


def spellings(code: str) -> set[str]:
    """The spellings of a unit code, by rule, in lower case."""
    out = {code.lower(), *WHOLE.get(code, [])}
    if m := re.fullmatch(r"(k|m|u|n|p|)(g|mol|U|kat|\[IU\])/(L|dL|mL)", code):
        for p, b, d in product(PREFIXES[m[1]], BASES[m[2]], PER[m[3]]):
            if d != "%" or m[2] == "g":
                out.add(p + b + d)
        if m[2] == "mol" and m[3] == "L":
            out |= {p + "m" for p in PREFIXES[m[1]][:2]}
    if m := re.fullmatch(r"(10\*\d+|)/(L|uL)", code):
        heads = list(COUNTS.get(m[1], []))
        if m[1]:
            n = m[1][3:]
            heads += [x + y + n for x in ("", "x", "x ") for y in ("10*", "10^", "10e", "10 ")]
        out |= {h + d for h, d in product(heads, PER[m[2]])}
    return out

#: The codes of unit_dim; the table itself gives kinds and factors.
CODES = [
    "g/L", "g/dL", "mg/dL", "mg/L", "ug/dL", "ug/L", "ng/mL", "ng/dL", "ng/L", "pg/mL", "ug/mL", "mg/mL", "mmol/L", "umol/L", "nmol/L", "pmol/L", "U/L", "kU/L", "U/mL", "ukat/L", "nkat/L",
    "10*9/L", "10*3/uL", "/uL", "10*6/uL", "10*12/L", "%", "L/L", "m[IU]/L", "u[IU]/mL", "[IU]/L", "[IU]/mL", "mm[Hg]", "kPa", "s", "ms", "min",
]
KEY = lambda s: re.sub(r"[\s.]+", "", s.lower())
PAIRS = sorted({(KEY(s), c) for c in CODES for s in spellings(c)})
WORDS = sorted({s for c in CODES for s in spellings(c)}, key=lambda s: (-len(s), s))
_WIDE = "".join(map(chr, range(0x21, 0x7F)))
_FROM, _TO = tx._WIDE + tx._SPACES + tx._ALIKE[0] + tx._INVISIBLE, _WIDE + " " * len(tx._SPACES) + tx._ALIKE[1]
PLAIN = lambda c: f"trim(regexp_replace(translate({c}, {Q(_FROM)}, {Q(_TO)}), '\\s+', ' ', 'g'), ' ')"
NUMBER = r"[0-9]{1,3}(?: [0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?"
VALUE = rf"^[<>=≤≥~ ]*({NUMBER})((?:[^0-9].*)?)$"
KEY_SQL = lambda c: f"regexp_replace(lower(translate(translate({c}, {Q(_FROM)}, {Q(_TO)}), 'µμ×', 'uux')), '[\\s.]+', '', 'g')"

# the unit behind a number in running text: the longest run of up to four words that is a spelling
_RUN = lambda w: f"list_filter(list_transform([4, 3, 2, 1], lambda n: array_to_string({w}[1:n], ' ')), lambda s: list_contains(ks, regexp_replace(lower(translate(s, 'µμ', 'uu')), '[\\s.]+', '', 'g')))[1]"

ROWS = f"""WITH names(key, code) AS (VALUES {", ".join(f"({Q(k)}, {Q(c)})" for k, c in PAIRS)}),
known AS (SELECT list(DISTINCT key) AS ks FROM names),
o AS (SELECT o.id, o.raw_unit_string AS u, {PLAIN('o.raw_value_string')} AS v, {PLAIN('o.raw_text')} AS t, {PLAIN('o.raw_reference_range')} AS r, x.expected_ucum_units AS expected, x.canonical_unit_ucum AS to_unit, x.molar_weight AS mw FROM observation o JOIN launch_scope_rules x ON x.candidate_code = o.accepted_analyte_code),
a AS (SELECT *, regexp_extract(v, {Q(VALUE)}, 1) AS digits, trim(regexp_extract(v, {Q(VALUE)}, 2), ' ') AS behind, ' ' || (CASE WHEN length(r) > 0 THEN replace(t, r, ' ') ELSE t END) || ' ' AS line FROM o),
b AS (SELECT *, CASE WHEN instr(line, ' ' || v || ' ') > 0 THEN substr(line, instr(line, ' ' || v || ' ') + length(v) + 2) END AS after_value FROM a),
w AS (SELECT *, string_split(regexp_replace(regexp_replace(after_value, '^(?:[ |*]|[Hh] )*', ''), '[|(,;].*$', ''), ' ') AS w0, string_split(regexp_replace(regexp_replace(after_value, '^(?:[ |*]|[HLhl] )*', ''), '[|(,;].*$', ''), ' ') AS w1, string_split(regexp_extract(r, '(?:-|–|to|<|>|≥|≤) ?[0-9][0-9.,]* ?([^(,;]*)', 1), ' ') AS w2 FROM b, known),
c AS (SELECT *, coalesce({_RUN('w0')}, {_RUN('w1')}) AS text_unit, {_RUN('w2')} AS range_unit FROM w),
d AS (SELECT *, {KEY_SQL("CASE WHEN trim(coalesce(u, ''), ' ') <> '' THEN u WHEN behind <> '' THEN behind WHEN text_unit IS NOT NULL THEN text_unit ELSE range_unit END")} AS key, CASE WHEN digits <> '' THEN CAST(replace(replace(digits, ' ', ''), ',', '.') AS DOUBLE) END AS value FROM c),
e AS (SELECT d.id, d.value, d.to_unit, d.mw, min(n.code) AS unit FROM d LEFT JOIN names n ON n.key = d.key AND list_contains(d.expected, n.code) GROUP BY ALL),
f AS (SELECT e.id AS observation_id, e.value, e.unit AS recorded_unit, e.to_unit AS canonical_unit, CASE WHEN p.kind = q.kind THEN e.value * p.factor_to_base / q.factor_to_base WHEN p.kind = 'mass' AND q.kind = 'molar' THEN e.value * p.factor_to_base / e.mw / q.factor_to_base WHEN p.kind = 'molar' AND q.kind = 'mass' THEN e.value * p.factor_to_base * e.mw / q.factor_to_base END AS canonical_value FROM e LEFT JOIN unit_dim p ON p.ucum_code = e.unit LEFT JOIN unit_dim q ON q.ucum_code = e.to_unit)
"""
CANONICAL = ROWS + "SELECT observation_id, value, recorded_unit, canonical_unit, canonical_value FROM f"
FOUND = ROWS + "SELECT observation_id, recorded_unit FROM f WHERE value IS NOT NULL AND canonical_value IS NOT NULL AND recorded_unit <> canonical_unit"
