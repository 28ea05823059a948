"""Scalar functions of the lab domain as Column expressions: labels, numbers, units, languages, identifiers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
CONTEXT_TOKENS = ["blood", "level", "levels", "plasma", "reference", "result", "results", "serum", "specimen", "test", "tests", "unit", "units", "value"]
TRAILING_TOKENS = ["ul", "cmm", "wb", "ifcc", "dcct", "ngsp", "epi", "ckd", "calc", "calculated", "mg", "dl", "ml", "l", "mmol", "g", "pg", "ng", "mcg", "pmol", "nmol", "mol", "iu", "3", "10", "%"]
SHORTCUTS = [
    (r"\bhaemoglobin\s*a\s*1\s*c\b", "hba1c"),
    (r"\bhemoglobin\s*a\s*1\s*c\b", "hba1c"),
    (r"\bhb\s*a\s*1\s*c\b", "hba1c"),
    (r"\ba\s*1\s*c\b", "hba1c"),
    (r"\bestimated\s+glomerular\s+filtration\s+rate\b", "egfr"),
    (r"\be\s*gfr\b", "egfr"),
    (r"\blow\s+density\s+lipoprotein\s+cholesterol\b", "ldl c"),
    (r"\bhigh\s+density\s+lipoprotein\s+cholesterol\b", "hdl c"),
    (r"\bldl\s+cholesterol\b", "ldl c"),
    (r"\bhdl\s+cholesterol\b", "hdl c"),
    (r"\begfr\s+ckd\s+epi\b", "egfr"),
    (r"\begfr\s+epi\b", "egfr"),
    (r"\bhba1c\s+ifcc\b", "hba1c"),
    (r"\bhba1c\s+dcct\b", "hba1c"),
]
UNIT_SYNONYMS = {"percent": "%", "pct": "%", "mmol mol": "mmol/mol", "mmolmol": "mmol/mol", "mmol.mol-1": "mmol/mol", "mmolperlmol": "mmol/mol", "ngsp %": "%", "ifcc": "mmol/mol"}
SUPPORTED_UNITS = {
    "mg/dl": "mg/dL", "%": "%", "mmol/l": "mmol/L", "umol/l": "umol/L", "mmol/mol": "mmol/mol", "g/l": "g/L", "g/dl": "g/dL", "mg/l": "mg/L",
    "ng/ml": "ng/mL", "u/l": "U/L", "miu/l": "mIU/L", "ml/min/1.73 m2": "mL/min/{1.73_m2}", "ml/min/1.73m2": "mL/min/{1.73_m2}", "-": "1", "1": "1",
}
BYPASS_UNITS = ["ml/min/1.73 m2", "ml/min/1.73 m^2", "ml/min/1.73 m²", "ml/min/1.73m2", "ml/min/1.73m^2", "ml/min/1.73m²", "mg alb/mmol", "mg alb/mmol creat", "mg/mmol creat", "mg/g creat", "mg/g{creat}"]
MOLAR_WEIGHTS = {"glucose": 180.156, "cholesterol": 386.65, "triglycerides": 885.43, "calcium": 40.078, "creatinine": 113.12}
MASS_FACTORS = {"mg/dl": 0.01, "g/l": 1.0, "mg/l": 0.001}
MOLAR_FACTORS = {"mmol/l": 0.001, "umol/l": 0.000001}
RANGE_PATTERN = r"(?:[<>]=?|≤|≥)\s*\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s*-\s*\d[\d,]*(?:\.\d+)?"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
WHITE = r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"


def _folding() -> tuple[str, str]:
    """Characters with an ASCII letter under their accents (or width), and that letter."""
    give, take = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and ord(base) < 128 and base not in "'\\":
            give.append(chr(cp))
            take.append(base)
    return "".join(give), "".join(take)


FOLD_FROM, FOLD_TO = _folding()


def collapse(c: Column) -> Column:
    """White space of any kind collapsed, trimmed."""
    return F.trim(F.regexp_replace(c, WHITE + "+", " "))


def ascii_fold(c: Column) -> Column:
    """Accents off, everything beyond ASCII dropped."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", "")


def label_key(c: Column) -> Column:
    """The comparison key of an analyte label; '' for null: folded, letters, digits and % only, shortcuts applied, context words out, trailing qualifiers off."""
    s = F.regexp_replace(ascii_fold(F.lower(F.trim(F.coalesce(c, F.lit(""))))), r"[^a-z0-9%]+", " ")
    for pattern, word in SHORTCUTS:
        s = F.regexp_replace(s, pattern, word)
    s = F.array_join(F.filter(F.split(s, " "), lambda t: (t != "") & ~t.isin(CONTEXT_TOKENS)), " ")
    return F.regexp_replace(s, rf"^(\S+(?: \S+)*?)(?: (?:{'|'.join(TRAILING_TOKENS)}))+$", "$1")


def token_signature(key: Column) -> Column:
    """Sorted distinct tokens of a key, null for fewer than two tokens."""
    tokens = F.filter(F.split(key, " "), lambda t: t != "")
    return F.when(F.size(tokens) >= 2, F.array_join(F.array_sort(F.array_distinct(tokens)), " "))


def alias_variants(c: Column) -> Column:
    """Keys an alias can be found under: as a whole, compact slash parts, comma parts exchanged, without parentheses."""
    slash = F.filter(F.transform(F.split(c, "/"), lambda p: label_key(p)), lambda p: p != "")
    compact = F.when(F.contains(c, F.lit("/")) & F.forall(slash, lambda p: ~F.contains(p, F.lit(" "))), slash).otherwise(F.array().cast("array<string>"))
    comma = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    swapped = F.when(F.size(comma) == 2, F.array(label_key(F.concat(F.get(comma, F.lit(1)), F.lit(" "), F.get(comma, F.lit(0)))))).otherwise(F.array().cast("array<string>"))
    bare = F.array(label_key(F.regexp_replace(c, r"\([^)]*\)", " ")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(label_key(c)), compact, swapped, bare), lambda k: k != "")))


def clean_number(c: Column) -> Column:
    """The live cleaner: everything but digits, points and minus dropped, the first point kept; null if no number is left."""
    s = F.regexp_replace(c, r"[^\d\.-]+", "")
    point = F.instr(s, ".")
    s = F.when(F.length(s) - F.length(F.replace(s, F.lit("."), F.lit(""))) > 1, F.concat(F.substring(s, F.lit(1), point), F.replace(F.substring(s, point + 1, F.length(s)), F.lit("."), F.lit("")))).otherwise(s)
    return F.when(s.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), s.try_cast("double"))


def locale_number(c: Column) -> Column:
    """A number by the separators it bears: struct<value, decimal_separator, thousands_separator>; value null if it is none."""
    s = F.replace(F.replace(collapse(c), F.lit(" "), F.lit("")), F.lit("'"), F.lit(""))
    comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    thousand = lambda sep: F.regexp(s, F.lit(rf"^\d+[{sep}]\d{{3}}$"))
    plain = (
        F.when(comma & dot & comma_last, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & dot, F.replace(s, F.lit(","), F.lit("")))
        .when(comma & thousand(","), F.replace(s, F.lit(","), F.lit("")))
        .when(comma, F.replace(s, F.lit(","), F.lit(".")))
        .when(dot & thousand("."), F.replace(s, F.lit("."), F.lit("")))
        .otherwise(s)
    )
    decimal = F.when(comma & dot, F.when(comma_last, ",").otherwise(".")).when(comma & ~thousand(","), ",").when(dot & ~comma & ~thousand("."), ".")
    thousands = F.when(comma & dot, F.when(comma_last, ".").otherwise(",")).when(comma & thousand(","), ",").when(dot & ~comma & thousand("."), ".")
    value = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
    return F.struct(value.alias("value"), decimal.alias("decimal_separator"), thousands.alias("thousands_separator"))


def locale_descriptor(number: Column) -> Column:
    """Such as decimal_comma+thousands_dot+normalized; null if there is nothing to say."""
    name = lambda kind, c: F.when(c == ",", kind + "_comma").when(c == ".", kind + "_dot")
    parts = F.concat_ws("+", name("decimal", number["decimal_separator"]), name("thousands", number["thousands_separator"]), F.when(number["value"].isNotNull(), "normalized"))
    return F.nullif(parts, F.lit(""))


def last_range(c: Column) -> Column:
    """The last reference range in a text."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(f"({RANGE_PATTERN})"), F.lit(1)), F.lit(-1))


def unit_token(c: Column) -> Column:
    """Lower case, spaces collapsed, common synonyms folded; '' for null."""
    s = collapse(F.lower(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in UNIT_SYNONYMS.items() for x in kv])[s], s)


def canonical_spelling(c: Column) -> Column:
    """The canonical spelling of a supported unit, null for others."""
    s = collapse(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("²"), F.lit("2")), r"\{1\.73[_ ]?m2\}", "1.73 m2"))
    return F.create_map(*[F.lit(x) for kv in SUPPORTED_UNITS.items() for x in kv])[s]


def molar_convert(value: Column, from_unit: Column, to_unit: Column, analyte: Column) -> Column:
    """Between mass and amount by the molar weights above, four decimals; the value itself for equal units; else null."""
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    a, b, weight = F.lower(F.trim(from_unit)), F.lower(F.trim(to_unit)), m(MOLAR_WEIGHTS)[F.lower(F.trim(analyte))]
    mass, molar = m(MASS_FACTORS), m(MOLAR_FACTORS)
    return F.when(a == b, value).when(mass[a].isNotNull() & molar[b].isNotNull(), F.round(value * mass[a] / weight / molar[b], 4)).when(molar[a].isNotNull() & mass[b].isNotNull(), F.round(value * molar[a] * weight / mass[b], 4))


def language(c: Column) -> Column:
    """Primary subtag in lower case, 'en' for none."""
    s = F.split_part(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    return F.when(s == "", "en").otherwise(s)


def html_escape(c: Column) -> Column:
    """The five HTML characters escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def stable_id(c: Column, most: int = 64) -> Column:
    """Ids of up to ``most`` characters as they are, longer ones as prefix::digest."""
    prefix = F.when(F.contains(c, F.lit("::")), F.split_part(c, F.lit("::"), F.lit(1))).otherwise("id")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(prefix, F.lit("::"), F.substring(F.sha2(c, 256), 1, 32)))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.substring(variant, -1, 1), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def is_close(a: Column, b: Column) -> Column:
    """Equal up to a relative 1e-9."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))


def bilingual_signal(c: Column) -> Column:
    """1.0 with both CJK and Latin letters, 0.25 with one of them, else 0.0."""
    cjk, latin = c.rlike(r"[\x{4e00}-\x{9fff}]"), c.rlike("[A-Za-z]")
    return F.when(cjk & latin, 1.0).when(cjk | latin, 0.25).otherwise(0.0)
