"""The route of a document: an ordered table of decisions over keyword scores and structure, the first that holds decides.

The decisions are data, in SQL that any engine reads; ``decided`` makes one conditional expression for each result column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keywords of document routes.
KEYWORDS = {
    "lab": ["glucose", "hba1c", "creatinine", "cholesterol", "hemoglobin", "wbc", "platelet", "triglyceride", "ldl", "hdl", "reference range", "analyte", "result", "unit"],
    "summary": ["impression", "assessment", "recommendation", "clinical summary", "interpretation", "executive summary", "health report", "summary report", "action plan"],
    "non_lab": ["ultrasound", "mri", "ct scan", "x-ray", "radiology", "echocardiogram", "pathology report", "pathology", "histopathology", "specimen", "gross description", "microscopic", "final diagnosis", "medical report"],
    "composite": ["appendix", "attachment", "tests requested", "cardioiq", "cardio iq", "cardioiq annotation", "mayo clinic", "merged report", "multiple reports"],
    "high": ["cardioiq", "cardio iq", "cardioiq annotation", "mayo clinic", "merged report", "multiple reports"],
    "admin": ["dob", "age", "mrn", "accession", "patient id", "ordered by", "collection"],
    "health": ["health report"],
}
IMAGES = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tif", ".tiff"]

_IMAGE = "extension IN (" + ", ".join(f"'{e}'" for e in IMAGES) + ")"
_SCANNED = f"({_IMAGE} OR (has_image AND NOT has_text) OR (has_image AND chars < 64 AND extractability < 0.4) OR (has_image AND density >= 0.5 AND chars < 512) OR (density >= 0.8 AND chars < 128))"
_RICH = "(has_text AND chars >= 64)"
_COMPOSITE = "(composite >= 2 OR high >= 1 OR non_lab >= 3 OR (summary >= 2 AND non_lab >= 2))"
_PACKET = f"lab > 0 AND pages > 1 AND {_COMPOSITE}"
_OF = "greatest({0}, 0) / greatest({0} + {1} + {2}, 1)"

#: lane, document class, condition, confidence, reason; the last one always holds.
DECISIONS = [
    ("unsupported", "unsupported", "protected", "1.0", "pdf_password_protected"),
    ("unsupported", "unsupported", "corrupt OR pages = 0", "1.0", "pdf_corrupt_or_unreadable"),
    ("non_lab_medical", "non_lab_medical", "non_lab >= greatest(summary, lab + 1) AND non_lab >= 2", _OF.format("non_lab", "lab", "summary"), "non_lab_medical_keywords"),
    ("interpreted_summary", "interpreted_summary", "summary > lab AND summary >= 2 AND non_lab < summary", _OF.format("summary", "lab", "non_lab"), "interpreted_summary_keywords"),
    ("interpreted_summary", "interpreted_summary", "summary >= 2 AND health >= 1 AND pages >= 10 AND admin <= 1 AND non_lab <= 1", _OF.format("(summary + 1)", "lab", "non_lab"), "synthesized_health_summary_keywords"),
    ("image_pdf_lab", "composite_packet", f"{_PACKET} AND {_SCANNED}", _OF.format("(lab + composite)", "summary", "non_lab"), "composite_packet_scanned_structure"),
    ("composite_packet", "composite_packet", f"{_PACKET} AND {_RICH} AND ((extractability >= 0.5 AND density <= 0.5) OR non_lab >= 3)", _OF.format("(lab + composite)", "summary", "non_lab"), "composite_packet_signals"),
    ("image_pdf_lab", "image_pdf_lab", _IMAGE, "0.95", "image_file_route"),
    ("trusted_pdf_lab", "trusted_pdf_lab", "chars = 0 AND NOT has_image", "0.0", "no_extractable_text_layer"),
    ("image_pdf_lab", "image_pdf_lab", f"lab > 0 AND {_SCANNED}", _OF.format("lab", "summary", "non_lab"), "semantic_lab_scanned_structure"),
    ("trusted_pdf_lab", "trusted_pdf_lab", "lab > 0", _OF.format("lab", "summary", "non_lab"), "semantic_lab_text_structure"),
    ("image_pdf_lab", "image_pdf_lab", _SCANNED, _OF.format("greatest(admin, 1)", "summary", "non_lab"), "scanned_document_needs_ocr_classification"),
    ("unsupported", "unsupported", _RICH, _OF.format("greatest(summary, non_lab, admin, 1)", "lab", "composite"), "no_lab_semantic_signals"),
    ("unsupported", "unsupported", "true", _OF.format("greatest(admin, 1)", "summary", "non_lab"), "low_signal_pdf_fallback"),
]


def case(column: int, literal: bool = True) -> str:
    """The decisions as one SQL expression for lane (0), document class (1), confidence (3, not literal) or reason (4)."""
    say = lambda d: f"'{d[column]}'" if literal else d[column]
    return "CASE " + " ".join(f"WHEN {d[2]} THEN {say(d)}" for d in DECISIONS) + " END"


def scores(lines: DataFrame, key: str, text: str) -> DataFrame:
    """For each key how many keywords of each kind stand in any of its lines; no text is gathered."""
    words = [(kind, w) for kind, ws in KEYWORDS.items() for w in ws]
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    found = lines.groupBy(key).agg(*[F.max(F.contains(low, F.lit(w)).cast("int")).alias(f"_{i}") for i, (_, w) in enumerate(words)])
    return found.select(key, *[sum((F.col(f"_{i}") for i, (k, _) in enumerate(words) if k == kind), F.lit(0)).cast("int").alias(kind) for kind in KEYWORDS])


def decided(documents: DataFrame) -> DataFrame:
    """``documents`` (scores, extension, pages, density, extractability, has_text, has_image, chars, protected, corrupt; none null) with lane, document_class, confidence and reason."""
    return documents.withColumns({"lane": F.expr(case(0)), "document_class": F.expr(case(1)), "confidence": F.round(F.least(F.lit(1.0), F.expr(case(3, False))), 3), "reason": F.expr(case(4))})
