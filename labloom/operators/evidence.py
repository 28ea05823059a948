"""What a block of text or a row gives evidence of: measurements, headings, notes, thresholds; as column expressions over plain text.

``compact`` brings a text into the form all of these take: lower case, single spaces, none at the ends.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
VALUE = r"(?:<=|>=|<|>|≤|≥)?\s*\d[\d,]*(?:\.\d+)?"
RANGE = r"(?:<=|>=|<|>|≤|≥)?\s*\d[\d,]*(?:\.\d+)?\s*(?:-|–|to)\s*(?:<=|>=|<|>|≤|≥)?\s*\d[\d,]*(?:\.\d+)?"
NUMERIC = r"(?:[<>]=?|≤|≥)?\s*\d[\d,]*(?:\.\d+)?"
WORD = r"[A-Za-z\x{00C0}-\x{024F}\x{4E00}-\x{9FFF}0-9_/%.-]+"
TOKEN = r"[a-z0-9%/().+-]+"
UNIT_WORD = r"\b(?:mg|g|mmol|umol|ng|pg|iu|u|ml|dl|l|mm|cm|fl)(?:/[a-z0-9]+)?\b"
UNIT_HINTS = ["mg/dl", "g/dl", "g/l", "mmol/l", "umol/l", "mmol/mol", "iu/l", "u/l", "%", "ng/ml", "ng/l", "pg", "fl"]
NON_RESULT = [
    "guideline", "interpretation", "clinical history", "gross description", "microscopic", "final diagnosis", "specimen", "patient", "dob", "mrn", "accession", "report printed", "ordered", "received",
    "page ", "address", "jalan", "wisma", "flr", "pathology", "histopathology", "ultrasound", "radiology", "echocardiogram", "x-ray",
]
NARRATIVE = ["guideline", "interpretation", "clinical", "history", "diagnosis", "specimen", "recommend", "comment", "note", "pathology", "ultrasound", "radiology"]
THRESHOLDS = ["prediabetes", "risk", "cut off", "cutoff", "threshold", "target range", "castelli", "ifg", "very high", "moderate"]
CITATIONS = ["clin chem", "lab med", "et al", "doi", "jama"]
LABEL_STOPWORDS = ["result", "results", "unit", "units", "reference", "range", "normal", "high", "low", "risk", "threshold", "note", "clinical", "patient", "specimen", "report", "page", "section", "table", "value"]
RISK_MARKERS = ["risk", "cut off", "cutoff", "threshold", "prediabetes", "target range", "castelli", "ifg"]
NOTE_MARKERS = ["note", "guideline", "interpretation", "clinical", "history", "recommended"]
HEADINGS = [
    "biochemistry", "haematology", "hematology", "chemistry", "test name in range out of range reference range lab", "lipid function", "lipid panel standard", "comprehensive metabolic panel",
    "cbc includes diff/plt", "thyroid panel with tsh t3 uptake", "electrolytes", "serum/plasma glucose", "albumin and creatinine ratio (acr)",
]
SHADOWS = ["prediabetes", "ifg", "risk", "cut off", "threshold", "very high", "moderate", "castelli", "ldl-c/hdl-c", "total men", "total women", "ratio men", "ratio women"]
MOST_TOKENS = 48


def compact(c: Column) -> Column:
    return F.lower(spaced(c))


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def hits(x: Column, markers: list[str]) -> Column:
    """How many of the markers stand in the text."""
    return sum((F.contains(x, F.lit(m)).cast("int") for m in markers), F.lit(0))


def holds(x: Column, markers: list[str]) -> Column:
    return hits(x, markers) > 0


def density(x: Column, markers: list[str]) -> Column:
    """Markers in the text for each of its tokens."""
    return hits(x, markers) / F.greatest(F.regexp_count(x, F.lit(TOKEN)), F.lit(1))


def numeric_density(x: Column) -> Column:
    words = F.regexp_count(x, F.lit(WORD))
    return F.when(words == 0, 0.0).otherwise(F.round(F.regexp_count(x, F.lit(NUMERIC)) / words, 4))


def like_label(x: Column) -> Column:
    """Whether a token of three characters or more, with a letter, says what is measured."""
    tokens = F.regexp_extract_all(x, F.lit(f"({TOKEN})"), F.lit(1))
    return F.exists(tokens, lambda t: (F.length(t) > 2) & t.rlike("[a-z]") & ~t.isin(LABEL_STOPWORDS))


def like_unit(x: Column) -> Column:
    """Whether a unit or a reference stands in the text."""
    return x.rlike(RANGE) | holds(x, ["reference range", "reference interval", *UNIT_HINTS]) | x.rlike(UNIT_WORD)


def result_like(x: Column, threshold_density: Column) -> Column:
    """Whether a block of unknown role reads like results: a value, a label, a unit or reference, numbers enough, and next to no narrative, thresholds or citations."""
    dense = numeric_density(x) >= 0.08
    loose = (density(x, NARRATIVE) < 0.08) & (F.greatest(threshold_density, density(x, THRESHOLDS)) < 0.08) & (density(x, CITATIONS) < 0.06)
    return (x != "") & ~holds(x, NON_RESULT) & x.rlike(VALUE) & like_label(x) & like_unit(x) & dense & loose


def heading_only(text: Column) -> Column:
    """Whether a text without a value is a known heading, or is in capitals, of eight words at most."""
    whole, x = spaced(text), compact(text)
    known = sum(((x == h) | x.startswith(h + " ")).cast("int") for h in HEADINGS) > 0
    capitals = (whole == F.upper(whole)) & (whole != F.lower(whole)) & (F.size(F.split(x, " ")) <= 8)
    return (x != "") & ~x.rlike(VALUE) & (known | capitals)


def strict_measurement(x: Column) -> Column:
    return x.rlike(VALUE) & like_label(x) & like_unit(x) & (density(x, CITATIONS) < 0.12) & (density(x, NARRATIVE) < 0.2)


def suppressed_before_parsing(x: Column) -> Column:
    """Notes, risks and citations that are no measurement all the same."""
    return (x != "") & (holds(x, RISK_MARKERS) | holds(x, NOTE_MARKERS) | holds(x, CITATIONS)) & ~strict_measurement(x)


def arbitration(text: Column, value: Column, number: Column, unit: Column, reference: Column) -> Column:
    """Why a parsed row is no row: threshold_shadow, label_noise, giant_hybrid_row; null if it is one."""
    x = compact(text)
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    words = F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))
    noise = ~said(value) & number.isNull() & ((x == "") | ((words == 1) & (F.length(x) <= 2)) | holds(x, CITATIONS))
    return F.when(holds(x, SHADOWS) & ~(said(unit) & said(reference)), "threshold_shadow").when(noise, "label_noise").when(words > MOST_TOKENS, "giant_hybrid_row")


#: Keywords of blocks that bear no results.
ADMIN = ["dob", "mrn", "accession", "patient id", "ordered by", "collected", "received", "address"]
HEADER_FOOTER = ["page ", "report printed", "confidential", "end of report"]
ROLES = ["result_block", "threshold_block", "admin_block", "narrative_block", "header_footer_block"]


def role_scores(x: Column) -> Column:
    """How much speaks for each of ROLES: for results a value, a unit or reference, and a label; for the others their keywords."""
    result = x.rlike(VALUE).cast("int") + like_unit(x).cast("int") + like_label(x).cast("int")
    return F.array(F.when(x.rlike(VALUE), result).otherwise(0), hits(x, THRESHOLDS), hits(x, ADMIN), hits(x, NARRATIVE), hits(x, HEADER_FOOTER))


def block_route(x: Column, scores: Column, threshold_density: Column) -> Column:
    """What becomes of a block: 'parsed', 'empty', or 'excluded:' with the reason, by the first rule that holds.

    A block whose best role is shared is ambiguous; blocks of other roles than results are excluded under their role; a block that
    nothing speaks for must read like results; what is left must not be a threshold, a note or a citation.
    """
    top = F.array_max(scores)
    shared = F.size(F.filter(scores, lambda s: s == top)) > 1
    role = F.when(top > 0, F.get(F.array(*map(F.lit, ROLES)), (F.array_position(scores, top) - 1).cast("int")))
    excluded = lambda reason: F.concat(F.lit("excluded:"), reason if isinstance(reason, Column) else F.lit(reason))
    return (
        F.when(x == "", "empty").when((top > 0) & shared, excluded("ambiguous_block_classification")).when(role != "result_block", excluded(role)).when(role.isNull() & ~result_like(x, threshold_density), excluded("unknown_block_non_result"))
        .when(suppressed_before_parsing(x), excluded("preparse_threshold_note_citation_row")).otherwise("parsed")
    )
