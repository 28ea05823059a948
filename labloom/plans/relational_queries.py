"""Filters, joins, aggregates, windows, sorts, set operations and mutations over the lab tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from labloom.functions import lab
from labloom.operators import relational as rel, resolution
from labloom.plans import packs_sql
from labloom.plans.catalog import Tables, query
from labloom.plans.scalar_queries import Q, sql_collapse, sql_label_key, sql_map

# --- fixed values -----------------------------------------------------------------------------------------------
HEADER_PREFIXES = [
    "laboratory report", "patient details", "doctor details", "name :", "ur :", "ref :", "dob :", "ic no", "collected :", "referred :", "report printed",
    "ward :", "yr ref", "courier run", "analytes", "results", "units", "ref. ranges", "general screening", "biochemistry", "serum/plasma", "special chemistry",
    "specimen:", "specimen type", "specimen collected", "random urine", "albumin and creatinine", "kdigo", "interpretation:", "source:", "recommend",
    "cc drs", "page ", "tests requested", "report completed", "note:", "due to the variability", "kfre risk", "result should be", "ifg ", "igt ",
    "ifg:", "igt:", "t2dm", "a:", "b:", "c:", "ifg =", "dm ",
]
CATEGORY_PATTERNS = [r"(?i)^\s*(normal|prediabetes|dm|a1|a2|a3)\b", r"^\s*(<=|>=|<|>)\s*\d", r"(?i)^\s*glucose\s+levels\b", r"(?i)\bfor\s+hba1c\s+levels\b"]
NOISE_PREFIXES = ["ref :", "dob :", "ic no", "collected :", "referred :", "report printed :", "source:"]
NOISE_MARKERS = ["clinical practice guidelines", "courier run", "kdigo", "not valid for pregnant", "ward : lab no"]
NOISE_LABELS = ["<", "<=", ">", ">=", "collected", "dob", "normal", "referred", "ref", "report printed", "source"]
ADDRESS_PATTERN = r"(^|[^a-z0-9_])(city|state|st|zip|jalan|petaling|sel)($|[^a-z0-9_])"
QUALITATIVE = ["positive", "negative", "reactive", "nonreactive", "detected", "not detected", "present", "absent", "trace", "none", "normal", "abnormal", "dnr", "ldnr", "oor"]
ADMIN_MARKERS = ["dob", "date of birth", "report printed", "collected", "referred", "requisition", "reference range", "guideline", "notes"]
FRAGMENT_PATTERN = r"(?i)^(?:[<>]=?|≤|≥)?\s*\d[\d,]*(?:\.\d+)?\s*(?:-|–|to)\s*(?:[<>]=?|≤|≥)?\s*\d[\d,]*(?:\.\d+)?$"
LANES = ["structured", "trusted_pdf", "image_beta", "vlm", "manual"]
COUNTERS = ["completed", "partial", "failed", "queued", "running", "dead_lettered"]
PAGE_WORDS = {"price_list": ["price", "per lb", "cwt", "s. ", "d. "], "notice": ["to let", "for sale", "wanted", "apply"], "report": ["said", "reported", "yesterday", "meeting"], "shipping": ["steamer", "sailed", "arrived", "cargo"]}

any_of = lambda c, words: c.rlike("|".join(map(re.escape, words)))
begins = lambda c, words: c.rlike(f"^(?:{'|'.join(map(re.escape, words))})")
sql_list = lambda words: "[" + ", ".join(map(Q, words)) + "]"
sql_any = lambda c, words: "coalesce(" + " OR ".join(f"contains({c}, {Q(w)})" for w in words) + ", false)"
sql_begins = lambda c, words: "coalesce(" + " OR ".join(f"starts_with({c}, {Q(w)})" for w in words) + ", false)"


# --- filters ------------------------------------------------------------------------------------------------------
@query(f"SELECT id, {sql_begins('lower(trim(raw_text, \' \'))', HEADER_PREFIXES)} AS header, {' OR '.join(f'regexp_matches(raw_text, {Q(p)})' for p in CATEGORY_PATTERNS)} AS category FROM extracted_row WHERE raw_text IS NOT NULL")
def flt01_flt02_line_kinds(t: Tables) -> DataFrame:
    """Header lines and category lines, which the row parser skips."""
    category = F.lit(False)
    for p in CATEGORY_PATTERNS:
        category = category | F.col("raw_text").rlike(p)
    return t.extracted_row.where("raw_text is not null").select("id", begins(F.lower(F.trim("raw_text")), HEADER_PREFIXES).alias("header"), category.alias("category"))


@query("SELECT id, raw_analyte_label FROM extracted_row WHERE length(trim(raw_analyte_label, ' ')) >= 2 AND lower(trim(raw_analyte_label, ' ')) NOT IN ('an egfr', 'egfr(ckd-epi)') AND extraction_confidence >= 0.2")
def flt03_flt07_kept_rows(t: Tables) -> DataFrame:
    """Rows whose label may be an analyte and whose confidence passes."""
    label = F.trim("raw_analyte_label")
    return t.extracted_row.where((F.length(label) >= 2) & ~F.lower(label).isin("an egfr", "egfr(ckd-epi)") & (F.col("extraction_confidence") >= 0.2)).select("id", "raw_analyte_label")


LOW = "lower(trim(coalesce(raw_text, ''), ' '))"


@query(
    f"""WITH kk AS (SELECT id, {LOW} AS t, {sql_label_key('raw_analyte_label')} AS k FROM extracted_row)
    SELECT id, t = '' OR {sql_begins('t', NOISE_PREFIXES)} OR {sql_any('t', NOISE_MARKERS)} OR regexp_matches(t, {Q(ADDRESS_PATTERN)}) OR t IN ('reference range', 'result units', 'test result') OR regexp_matches(t, '^(normal|ifg\\s*\\(prediabetes\\)|dm\\s*[><=])\\b') AS noise_text,
      k = '' OR k IN ({', '.join(map(Q, NOISE_LABELS))}) OR {sql_begins('k', ['dob', 'ic no', 'report printed', 'ref', 'source'])} OR {sql_any('k', ['kdigo', 'guideline', 'courier run'])} AS noise_label FROM kk"""
)
def flt04_flt05_noise(t: Tables) -> DataFrame:
    """Text and label noise, each as one boolean."""
    k = t.extracted_row.select("id", F.lower(F.trim(F.coalesce("raw_text", F.lit("")))).alias("t"), lab.label_key(F.col("raw_analyte_label")).alias("k"))
    text, label = F.col("t"), F.col("k")
    noise_text = (text == "") | begins(text, NOISE_PREFIXES) | any_of(text, NOISE_MARKERS) | text.rlike(ADDRESS_PATTERN) | text.isin("reference range", "result units", "test result") | text.rlike(r"^(normal|ifg\s*\(prediabetes\)|dm\s*[><=])\b")
    noise_label = (label == "") | label.isin(NOISE_LABELS) | begins(label, ["dob", "ic no", "report printed", "ref", "source"]) | any_of(label, ["kdigo", "guideline", "courier run"])
    return k.select("id", noise_text.alias("noise_text"), noise_label.alias("noise_label"))


@query(
    """SELECT id, parsed_numeric_value IS NOT NULL OR coalesce(regexp_matches(raw_value_string, '\\d') AND NOT regexp_matches(raw_value_string, '^\\d{1,2}:\\d{2}'), false) OR coalesce(regexp_matches(raw_text, '\\d') AND regexp_matches(raw_text, '[a-zA-Z%/]'), false) AS measurement FROM extracted_row"""
)
def flt06_measurement_like(t: Tables) -> DataFrame:
    v, x = F.col("raw_value_string"), F.col("raw_text")
    return t.extracted_row.select("id", (F.col("parsed_numeric_value").isNotNull() | F.coalesce(v.rlike(r"\d") & ~v.rlike(r"^\d{1,2}:\d{2}"), F.lit(False)) | F.coalesce(x.rlike(r"\d") & x.rlike("[a-zA-Z%/]"), F.lit(False))).alias("measurement"))


@query(
    """SELECT o.id, CASE WHEN r.extraction_confidence < 0.9 THEN 'unsupported' ELSE o.support_state END AS support_state,
    array_to_string(list_sort(list_distinct(CASE WHEN r.extraction_confidence < 0.9 THEN list_append(o.suppression_reasons, 'low_extraction_confidence') ELSE o.suppression_reasons END)), ',') AS reasons
    FROM observation o LEFT JOIN extracted_row r ON r.id = o.extracted_row_id"""
)
def flt08_set02_confidence_gate(t: Tables) -> DataFrame:
    """Below a confidence of 0.9 an observation is unsupported, with the reason in its sorted set."""
    r = t.extracted_row.select(F.col("id").alias("extracted_row_id"), "extraction_confidence")
    low = F.coalesce(F.col("extraction_confidence") < 0.9, F.lit(False))
    reasons = F.when(low, F.array_union("suppression_reasons", F.array(F.lit("low_extraction_confidence")))).otherwise(F.array_distinct("suppression_reasons"))
    return t.observation.join(r, "extracted_row_id", "left").select("id", F.when(low, "unsupported").otherwise(F.col("support_state")).alias("support_state"), F.array_join(F.array_sort(reasons), ",").alias("reasons"))


@query(
    """SELECT extracted_row_id, document_id, CASE WHEN trim(coalesce(raw_analyte_label, ''), ' ') = '' THEN 'missing_label' WHEN source_page IS NULL OR source_page < 1 THEN 'bad_page' WHEN document_id IS NULL THEN 'missing_document' END AS reject, coalesce(language_id, 'en') AS language_id FROM observation"""
)
def flt09_builder_checks(t: Tables) -> DataFrame:
    reject = F.when(F.trim(F.coalesce("raw_analyte_label", F.lit(""))) == "", "missing_label").when(F.col("source_page").isNull() | (F.col("source_page") < 1), "bad_page").when(F.col("document_id").isNull(), "missing_document")
    return t.observation.select("extracted_row_id", "document_id", reject.alias("reject"), F.coalesce("language_id", F.lit("en")).alias("language_id"))


QA_SQL = f"""SELECT id, source_feed, raw_unit_string, raw_reference_range, CASE
      WHEN trim(coalesce(raw_analyte_label, ''), ' ') = '' THEN 'missing_analyte_label'
      WHEN {sql_any(sql_collapse("lower(coalesce(raw_text, ''))"), ADMIN_MARKERS)} THEN 'contaminated_row_text'
      WHEN v <> '' AND (regexp_matches(v, {Q(FRAGMENT_PATTERN)}) OR (r <> '' AND contains(r, v))) THEN 'reference_fragment_row'
      WHEN parsed_numeric_value IS NULL AND try_cast(replace(v, ',', '') AS DOUBLE) IS NULL AND lower(v) NOT IN ({', '.join(map(Q, QUALITATIVE))}) THEN 'missing_result_value'
      WHEN parsed_numeric_value IS NULL AND v <> '' AND lower(trim(v, ' ')) = lower(trim(raw_analyte_label, ' ')) THEN 'missing_result_value'
      ELSE 'clean' END AS verdict FROM (SELECT *, trim(coalesce(raw_value_string, ''), ' ') AS v, trim(coalesce(raw_reference_range, ''), ' ') AS r FROM extracted_row)"""


def qa_verdicts(rows: DataFrame) -> DataFrame:
    """The first reason to reject each row, or 'clean'."""
    v, r = F.trim(F.coalesce("raw_value_string", F.lit(""))), F.trim(F.coalesce("raw_reference_range", F.lit("")))
    number = F.col("parsed_numeric_value").isNotNull() | F.replace(v, F.lit(","), F.lit("")).try_cast("double").isNotNull()
    verdict = (
        F.when(F.trim(F.coalesce("raw_analyte_label", F.lit(""))) == "", "missing_analyte_label")
        .when(any_of(lab.collapse(F.lower(F.coalesce("raw_text", F.lit("")))), ADMIN_MARKERS), "contaminated_row_text")
        .when((v != "") & (v.rlike(FRAGMENT_PATTERN) | ((r != "") & F.contains(r, v))), "reference_fragment_row")
        .when(~number & ~F.lower(v).isin(QUALITATIVE), "missing_result_value")
        .when(F.col("parsed_numeric_value").isNull() & (v != "") & (F.lower(v) == F.lower(F.trim("raw_analyte_label"))), "missing_result_value")
        .otherwise("clean")
    )
    return rows.withColumn("verdict", verdict)


@query(f"SELECT id, verdict FROM ({QA_SQL})")
def flt10_qa_funnel(t: Tables) -> DataFrame:
    return qa_verdicts(t.extracted_row).select("id", "verdict")


@query("SELECT id FROM extracted_row WHERE length(coalesce(raw_value_string, '')) <= 64 AND length(coalesce(raw_unit_string, '')) <= 64 AND length(coalesce(raw_reference_range, '')) <= 128 AND len(string_split(coalesce(raw_text, ''), ' ')) <= 32")
def flt11_row_ceilings(t: Tables) -> DataFrame:
    short = lambda c, n: F.length(F.coalesce(c, F.lit(""))) <= n
    return t.extracted_row.where(short("raw_value_string", 64) & short("raw_unit_string", 64) & short("raw_reference_range", 128) & (F.size(F.split(F.coalesce("raw_text", F.lit("")), " ")) <= 32)).select("id")


@query("SELECT id, list_filter(suppression_reasons, lambda r: NOT contains(r, 'threshold') AND NOT contains(r, 'alias')) AS visible FROM observation WHERE len(suppression_reasons) > 0")
def flt17_hidden_markers(t: Tables) -> DataFrame:
    return t.observation.where(F.size("suppression_reasons") > 0).select("id", F.filter("suppression_reasons", lambda r: ~any_of(r, ["threshold", "alias"])).alias("visible"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS text_lines, coalesce(len(lines), 0) AS boxes, len(string_split(text, chr(10))) > 1 AND coalesce(len(lines), 0) <= 1 AS lost FROM documents WHERE text IS NOT NULL")
def flt18_line_structure(t: Tables) -> DataFrame:
    """Pages whose text has lines that their boxes lack."""
    n, boxes = F.size(F.split("text", "\n")), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    return t.documents.where("text is not null").select("doc_id", n.cast("bigint").alias("text_lines"), boxes.cast("bigint").alias("boxes"), ((n > 1) & (boxes <= 1)).alias("lost"))


@query(f"SELECT j.id, j.user_id, j.lane_type FROM jobs j WHERE j.user_id = (SELECT max(user_id) FROM jobs) AND j.lane_type IN ({', '.join(map(Q, LANES))})")
def flt19_flt21_user_scope(t: Tables) -> DataFrame:
    """The jobs of one user in the lanes allowed."""
    one = t.jobs.agg(F.max("user_id").alias("user_id"))
    return t.jobs.where(F.col("lane_type").isin(LANES)).join(one, "user_id").select("id", "user_id", "lane_type")


@query("SELECT user_id, count(*) AS messages, count(*) <= 30 AND sum(length(props)) <= 16000 AND max(length(props)) <= 4000 AND arg_max(event_type, (ts, event_id)) <> 'error' AS valid FROM events WHERE event_type <> 'view' GROUP BY user_id")
def flt20_request_limits(t: Tables) -> DataFrame:
    """Message counts and sizes per user within bounds, the last message being the user's; events stand in for messages, views for those of the system, which are dropped."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return t.events.where("event_type <> 'view'").groupBy("user_id").agg(F.count("*").alias("messages"), ((F.count("*") <= 30) & (F.sum(F.length("props")) <= 16000) & (F.max(F.length("props")) <= 4000) & (last != "error")).alias("valid"))


# --- joins --------------------------------------------------------------------------------------------------------
ALIASES_SQL = f"(SELECT candidate_code, canonical_label, ordinal, expected_ucum_units, alias, {sql_label_key('alias')} AS k FROM (SELECT *, unnest(list_append(aliases, canonical_label)) AS alias FROM launch_scope_rules))"


def alias_keys(rules: DataFrame) -> DataFrame:
    a = rules.select("*", F.explode(F.concat("aliases", F.array("canonical_label"))).alias("alias"))
    return a.select("candidate_code", "canonical_label", "ordinal", "expected_ucum_units", "alias", lab.label_key(F.col("alias")).alias("k"))


@query(
    f"""WITH o AS (SELECT id, {sql_label_key('raw_analyte_label')} AS k FROM observation),
    h AS (SELECT o.id, a.candidate_code, row_number() OVER (PARTITION BY o.id ORDER BY ({sql_label_key('a.canonical_label')} = o.k) DESC, a.ordinal, a.candidate_code) AS rn FROM o JOIN (SELECT DISTINCT candidate_code, canonical_label, ordinal, k FROM {ALIASES_SQL}) a ON a.k = o.k WHERE o.k <> '')
    SELECT id, candidate_code FROM h WHERE rn = 1"""
)
def jn01_alias_lookup(t: Tables) -> DataFrame:
    """Labels looked up by key; entries whose own name matches come before aliases."""
    dim = alias_keys(t.launch_scope_rules).select("candidate_code", "canonical_label", "ordinal", "k").distinct()
    best = F.struct((lab.label_key(F.col("canonical_label")) != F.col("k")).alias("other"), "ordinal", "candidate_code")
    first = dim.groupBy("k").agg(F.min(best)["candidate_code"].alias("candidate_code"))
    return t.observation.select("id", lab.label_key(F.col("raw_analyte_label")).alias("k")).where("k <> ''").join(first, "k").select("id", "candidate_code")


SIG = lambda k: f"CASE WHEN len(string_split({k}, ' ')) >= 2 THEN array_to_string(list_sort(list_distinct(string_split({k}, ' '))), ' ') END"


@query(
    f"""WITH o AS (SELECT id, {SIG('k')} AS s FROM (SELECT id, {sql_label_key('raw_analyte_label')} AS k FROM observation)),
    a AS (SELECT s, count(DISTINCT candidate_code) AS n, min(candidate_code) AS code FROM (SELECT candidate_code, {SIG('k')} AS s FROM {ALIASES_SQL}) WHERE s IS NOT NULL GROUP BY s)
    SELECT o.id, CASE WHEN a.n = 1 THEN a.code ELSE 'ambiguous_tokens' END AS candidate_code FROM o JOIN a ON a.s = o.s"""
)
def jn02_token_signature(t: Tables) -> DataFrame:
    """Labels looked up by their set of words, taken only where it is unique."""
    dim = alias_keys(t.launch_scope_rules).select("candidate_code", lab.token_signature(F.col("k")).alias("s")).where("s is not null")
    dim = dim.groupBy("s").agg(F.count_distinct("candidate_code").alias("n"), F.min("candidate_code").alias("code"))
    o = t.observation.select("id", lab.token_signature(lab.label_key(F.col("raw_analyte_label"))).alias("s"))
    return o.join(dim, "s").select("id", F.when(F.col("n") == 1, F.col("code")).otherwise("ambiguous_tokens").alias("candidate_code"))


_TOKEN = lambda c: f"coalesce({sql_map(lab.UNIT_SYNONYMS)}[{sql_collapse('lower(coalesce(' + c + ', ' + Q('') + '))')}], {sql_collapse('lower(coalesce(' + c + ', ' + Q('') + '))')})"


@query(
    f"""WITH o AS (SELECT o.id, {_TOKEN('o.raw_unit_string')} AS u, r.panel_key FROM observation o JOIN launch_scope_rules r ON r.candidate_code = o.accepted_analyte_code),
    m AS (SELECT o.id, any_value(o.u) AS u, count(DISTINCT d.candidate_code) AS of, list(DISTINCT d.candidate_code) FILTER (o.u <> '' AND list_contains(list_transform(d.expected_ucum_units, lambda x: {_TOKEN('x')}), o.u)) AS fit, arg_min(d.candidate_code, (d.ordinal, d.candidate_code)) AS first FROM o JOIN launch_scope_rules d ON d.panel_key = o.panel_key GROUP BY o.id)
    SELECT id, CASE WHEN of = 1 THEN first WHEN len(coalesce(fit, [])) = 1 THEN fit[1] END AS candidate_code, CASE WHEN of > 1 AND len(coalesce(fit, [])) <> 1 THEN CASE WHEN u = '' THEN 'unit_required' ELSE 'unit_mismatch' END END AS reason FROM m"""
)
def jn03_disambiguation(t: Tables) -> DataFrame:
    """Names that several codes share are told apart by the unit; the list has no such names, so panels stand in for them."""
    r = t.launch_scope_rules
    named = F.concat(F.lit("panel "), F.col("panel_key"))
    shared = r.select("candidate_code", named.alias("canonical_label"), "ordinal", "expected_ucum_units", lab.label_key(named).alias("k"))
    o = t.observation.join(r.select(F.col("candidate_code").alias("accepted_analyte_code"), "panel_key"), "accepted_analyte_code")
    return resolution.resolve(o, shared, named, F.col("raw_unit_string")).select("id", "candidate_code", "reason")


@query(
    f"""SELECT o.id, CASE WHEN o.raw_unit_string IS NULL THEN 'unit_required' WHEN list_contains(list_transform(r.expected_ucum_units, lambda u: lower(u)), lower({sql_collapse('o.raw_unit_string')})) THEN 'accepted' ELSE 'unit_mismatch' END AS outcome
    FROM observation o JOIN launch_scope_rules r ON r.candidate_code = o.accepted_analyte_code"""
)
def jn03_unit_check(t: Tables) -> DataFrame:
    r = t.launch_scope_rules.select(F.col("candidate_code").alias("accepted_analyte_code"), F.transform("expected_ucum_units", lambda u: F.lower(u)).alias("units"))
    outcome = F.when(F.col("raw_unit_string").isNull(), "unit_required").when(F.array_contains("units", F.lower(lab.collapse(F.col("raw_unit_string")))), "accepted").otherwise("unit_mismatch")
    return t.observation.join(r, "accepted_analyte_code").select("id", outcome.alias("outcome"))


@query("SELECT o.id, r.id AS row_id, r.id IS NULL AS missing FROM observation o LEFT JOIN extracted_row r ON r.id = o.extracted_row_id AND r.row_hash = o.row_hash")
def jn04_resolve_rows(t: Tables) -> DataFrame:
    """Each observation's row by its keys, misses marked."""
    r = t.extracted_row.select(F.col("id").alias("extracted_row_id"), "row_hash", F.col("id").alias("row_id"))
    return t.observation.join(r, ["extracted_row_id", "row_hash"], "left").select("id", "row_id", F.col("row_id").isNull().alias("missing"))


FINDINGS_SQL = "(SELECT job_id || ':' || panel_key AS finding_id, list(o.id ORDER BY o.id) AS ids FROM observation o JOIN launch_scope_rules r ON r.candidate_code = o.accepted_analyte_code GROUP BY job_id, panel_key)"


def findings(t: Tables) -> DataFrame:
    """A finding for each job and panel, with the ids it rests on in order."""
    r = t.launch_scope_rules.select(F.col("candidate_code").alias("accepted_analyte_code"), "panel_key")
    return t.observation.join(r, "accepted_analyte_code").groupBy("job_id", "panel_key").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.concat_ws(":", "job_id", "panel_key").alias("finding_id"), "ids")


@query(
    f"""WITH f AS (SELECT finding_id, unnest(ids) AS oid, generate_subscripts(ids, 1) AS pos FROM {FINDINGS_SQL}),
    k AS (SELECT f.finding_id, f.oid, f.pos FROM f JOIN observation o ON o.id = f.oid WHERE o.support_state = 'supported')
    SELECT finding_id, arg_min(oid, pos) AS primary_id, count(*) AS kept FROM k GROUP BY finding_id"""
)
def jn05_jn06_primary_observation(t: Tables) -> DataFrame:
    """Of each finding's ids the first one that is kept; findings with none drop out."""
    f = findings(t).select("finding_id", F.posexplode("ids").alias("pos", "id"))
    kept = f.join(t.observation.where("support_state = 'supported'").select("id"), "id")
    return kept.groupBy("finding_id").agg(F.min_by("id", "pos").alias("primary_id"), F.count("*").alias("kept"))


@query(f"SELECT id, support_state FROM observation o WHERE support_state <> 'supported' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(ids) AS oid FROM {FINDINGS_SQL}) f WHERE f.oid = o.id)")
def jn07_unreferenced(t: Tables) -> DataFrame:
    """Observations that aren't supported and in no finding."""
    used = findings(t).select(F.explode("ids").alias("id"))
    return t.observation.where("support_state <> 'supported'").join(used, "id", "left_anti").select("id", "support_state")


#: (profile, segment, sexes, age from, age to, pregnancy, priority); null means any.
PROFILES = [("any", "BUILDING", None, None, None, None, 10), ("male", "BUILDING", ["M"], None, None, None, 5), ("adult", "MACHINERY", None, 18.0, None, None, 10), ("grown", "MACHINERY", None, None, 120.0, None, 10), ("elder", "AUTOMOBILE", None, 65.0, None, None, 1), ("woman", "AUTOMOBILE", ["F"], 18.0, 64.0, None, 2), ("child", "AUTOMOBILE", None, None, 17.0, None, 3), ("all", "FURNITURE", ["F", "M"], None, None, False, 7)]
PROFILE_SQL = "(VALUES " + ", ".join(f"({Q(p)}, {Q(s)}, {sql_list(x) if x else 'NULL::VARCHAR[]'}, {a or 'NULL'}::DOUBLE, {b or 'NULL'}::DOUBLE, {'NULL' if g is None else g}::BOOLEAN, {n})" for p, s, x, a, b, g, n in PROFILES) + ") AS p(profile_id, segment, p_sex, p_age_low, p_age_high, p_pregnancy, priority)"
FITS_SQL = f"""(SELECT c_custkey, profile_id, priority, (p_sex IS NOT NULL)::INT + (p_age_low IS NOT NULL)::INT + (p_age_high IS NOT NULL)::INT + (p_pregnancy IS NOT NULL)::INT AS specificity
    FROM (SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 90)::DOUBLE END AS age, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_custkey % 3 = 0 AS pregnant FROM customer) c JOIN {PROFILE_SQL} USING (segment)
    WHERE (p_sex IS NULL OR list_contains(p_sex, sex)) AND (p_age_low IS NULL OR age >= p_age_low) AND (p_age_high IS NULL OR age <= p_age_high) AND (p_pregnancy IS NULL OR pregnant = p_pregnancy))"""


def profile_matches(t: Tables) -> DataFrame:
    people = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") % 90).cast("double")).alias("age"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex"), (F.col("c_custkey") % 3 == 0).alias("pregnant"))
    profiles = t.spark.createDataFrame(PROFILES, "profile_id string, segment string, p_sex array<string>, p_age_low double, p_age_high double, p_pregnancy boolean, priority int")
    return rel.matching_profiles(people, profiles, "segment")


@query(f"SELECT c_custkey, profile_id, specificity FROM {FITS_SQL}")
def jn08_profiles_that_apply(t: Tables) -> DataFrame:
    return profile_matches(t).select("c_custkey", "profile_id", "specificity")


@query(f"WITH r AS (SELECT *, rank() OVER (PARTITION BY c_custkey ORDER BY priority, -specificity) AS rk FROM {FITS_SQL}), b AS (SELECT *, count(*) OVER (PARTITION BY c_custkey) AS n FROM r WHERE rk = 1) SELECT c_custkey, profile_id FROM b WHERE n = 1")
def wn04_best_profile(t: Tables) -> DataFrame:
    """The best profile, none where the best place is shared."""
    return rel.best_or_abstain(profile_matches(t).withColumn("minus", -F.col("specificity")), ["c_custkey"], ["priority", "minus"]).select("c_custkey", "profile_id")


@query(
    """WITH k AS (SELECT ordinal, 0 AS src, lower(trim(candidate_code)) AS key, candidate_code FROM launch_scope_rules UNION ALL SELECT ordinal, 1, lower(trim(canonical_label)), candidate_code FROM launch_scope_rules UNION ALL SELECT ordinal, 2, lower(trim(unnest(aliases))), candidate_code FROM launch_scope_rules)
    SELECT key, arg_max(candidate_code, (ordinal, src)) AS candidate_code FROM k GROUP BY key"""
)
def jn09_last_writer_wins(t: Tables) -> DataFrame:
    """A dimension under every key it has; a later entry takes a key over."""
    keys = F.concat(F.array(F.struct(F.lit(0).alias("src"), F.col("candidate_code").alias("key")), F.struct(F.lit(1).alias("src"), F.col("canonical_label").alias("key"))), F.transform("aliases", lambda a: F.struct(F.lit(2).alias("src"), a.alias("key"))))
    k = t.launch_scope_rules.select("ordinal", "candidate_code", F.explode(keys).alias("k")).select("ordinal", "candidate_code", "k.src", F.lower(F.trim("k.key")).alias("key"))
    return k.groupBy("key").agg(F.max_by("candidate_code", F.struct("ordinal", "src")).alias("candidate_code"))


@query(
    """WITH o AS (SELECT id, unnest(list_distinct([lower(trim(coalesce(accepted_analyte_display, ''), ' ')), lower(trim(coalesce(accepted_analyte_code, ''), ' ')), lower(trim(coalesce(raw_analyte_label, ''), ' '))])) AS key FROM observation),
    a AS (SELECT ordinal, panel_key, lower(unnest(list_append(list_append(aliases, canonical_label), candidate_code))) AS key FROM launch_scope_rules)
    SELECT o.id, arg_min(a.panel_key, a.ordinal) AS panel_key FROM o JOIN a ON a.key = o.key WHERE o.key <> '' GROUP BY o.id"""
)
def jn10_set05_first_rule_by_any_label(t: Tables) -> DataFrame:
    """The first entry, in the list's order, that shares a label with the observation."""
    labels = F.array_distinct(F.array(*[F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("accepted_analyte_display", "accepted_analyte_code", "raw_analyte_label")]))
    o = t.observation.select("id", F.explode(labels).alias("key")).where("key <> ''")
    a = t.launch_scope_rules.select("ordinal", "panel_key", F.explode(F.concat("aliases", F.array("canonical_label", "candidate_code"))).alias("key")).withColumn("key", F.lower("key"))
    return o.join(a, "key").groupBy("id").agg(F.min_by("panel_key", "ordinal").alias("panel_key"))


@query(
    """WITH s AS (SELECT * FROM observation WHERE support_state = 'supported' AND accepted_analyte_code IS NOT NULL),
    c AS (SELECT DISTINCT accepted_analyte_code AS code, canonical_unit AS unit, specimen_context AS sp, method_context AS me, job_id FROM s),
    p AS (SELECT c.*, s.id, s.created_at, s.canonical_value, row_number() OVER (PARTITION BY c.code, c.unit, c.sp, c.me, c.job_id ORDER BY s.created_at DESC, s.id DESC) AS rn FROM c JOIN s ON s.accepted_analyte_code = c.code AND s.canonical_unit IS NOT DISTINCT FROM c.unit AND s.specimen_context IS NOT DISTINCT FROM c.sp AND s.method_context IS NOT DISTINCT FROM c.me AND s.job_id <> c.job_id)
    SELECT code AS accepted_analyte_code, unit AS canonical_unit, sp AS specimen_context, me AS method_context, job_id, id AS other_id, canonical_value AS other_canonical_value FROM p WHERE rn = 1"""
)
def jn11_latest_comparable(t: Tables) -> DataFrame:
    """For each job and kind of result the latest comparable one of another job."""
    s = t.observation.where("support_state = 'supported' and accepted_analyte_code is not null and job_id is not null")
    return rel.latest_of_other_group(s, ["accepted_analyte_code", "canonical_unit", "specimen_context", "method_context"], "job_id", "created_at", "id", ["id", "canonical_value"])


@query("SELECT j.id, EXISTS (SELECT 1 FROM observation o WHERE o.job_id = j.id AND o.support_state = 'supported') AS has_supported, EXISTS (SELECT 1 FROM proof_packs p WHERE p.job_id = j.id) AS has_pack FROM jobs j")
def jn12_exists_flags(t: Tables) -> DataFrame:
    s = t.observation.where("support_state = 'supported'").select(F.col("job_id").alias("id")).distinct().withColumn("s", F.lit(True))
    p = t.proof_packs.where("job_id is not null").select(F.col("job_id").alias("id")).distinct().withColumn("p", F.lit(True))
    return t.jobs.select("id").join(s, "id", "left").join(p, "id", "left").select("id", F.coalesce("s", F.lit(False)).alias("has_supported"), F.coalesce("p", F.lit(False)).alias("has_pack"))


@query(packs_sql.CHECKS)
def jn13_ag30_baselines(t: Tables) -> DataFrame:
    """Every check of every pack against its baseline: by size where both are numbers, else by equality; missing without either."""
    from labloom.operators.nested import pack_rows

    c = pack_rows(t.proof_packs).where("child = 'check'").select("record_id", "pack_ord", F.col("parent_key").alias("report_name"), F.col("child_key").alias("metric"), *[F.col("attributes")[k].alias(k) for k in ("observed", "baseline")])
    o, b = F.col("observed").try_cast("double"), F.col("baseline").try_cast("double")
    status = F.when(F.col("observed").isNull() | F.col("baseline").isNull(), "missing").when(F.coalesce(o >= b, F.col("observed") == F.col("baseline")), "pass").otherwise("regressed")
    return c.select("record_id", "pack_ord", "report_name", "metric", (o - b).alias("delta"), status.alias("status"))


@query(
    f"""WITH e AS (SELECT list(DISTINCT {sql_label_key('canonical_label')}) AS names FROM launch_scope_rules)
    SELECT o.id, list_sort(list_filter(e.names, lambda n: n <> '' AND o.k <> '' AND (contains(o.k, n) OR contains(n, o.k)))) AS expected FROM (SELECT id, {sql_label_key('raw_analyte_label')} AS k FROM observation) o, e"""
)
def jn14_contained_names(t: Tables) -> DataFrame:
    """Expected names that contain a label or are contained in it."""
    names = t.launch_scope_rules.select(lab.label_key(F.col("canonical_label")).alias("n")).distinct().where("n <> ''")
    k = t.observation.select("id", lab.label_key(F.col("raw_analyte_label")).alias("k"))
    return k.join(rel.containing(k.select("k").distinct().where("k <> ''"), "k", names, "n"), "k", "left").select("id", F.coalesce("contained", F.array().cast("array<string>")).alias("expected"))


LEAK_TOKENS = ["page 2 of 5", "ward copy", "technician", "specimen haemolysed", "lot 44"]


@query(f"SELECT id, list_filter({sql_list(LEAK_TOKENS)}, lambda w: contains(lower(raw_text), w)) AS leaks FROM observation WHERE {sql_any('lower(raw_text)', LEAK_TOKENS)}")
def jn15_surfaced_tokens(t: Tables) -> DataFrame:
    low = F.lower("raw_text")
    return t.observation.where(any_of(low, LEAK_TOKENS)).select("id", F.filter(F.array(*map(F.lit, LEAK_TOKENS)), lambda w: F.contains(low, w)).alias("leaks"))


#: What is expected of some sources whatever the file says.
OVERRIDES = {"feed_01": "manual", "feed_03": "structured"}


@query(
    f"""WITH d AS (SELECT input_checksum, arg_min(lane_type, (created_at, id)) AS lane FROM jobs GROUP BY input_checksum)
    SELECT j.id, coalesce({sql_map(OVERRIDES)}[j.source_feed], d.lane) AS expected, coalesce({sql_map(OVERRIDES)}[j.source_feed], d.lane) = j.lane_type AS met FROM jobs j LEFT JOIN d ON d.input_checksum = j.input_checksum"""
)
def jn17_expectations(t: Tables) -> DataFrame:
    """What is expected of each job: by its source where that has an expectation of its own, else by the first job of the same file."""
    first = t.jobs.groupBy("input_checksum").agg(F.min_by("lane_type", F.struct("created_at", "id")).alias("lane"))
    own = F.create_map(*[F.lit(x) for kv in OVERRIDES.items() for x in kv])[F.col("source_feed")]
    j = t.jobs.join(first, "input_checksum", "left").withColumn("expected", F.coalesce(own, F.col("lane")))
    return j.select("id", "expected", (F.col("expected") == F.col("lane_type")).alias("met"))


@query("SELECT r.input_checksum, count(*) AS jobs, list_sort(list(DISTINCT lane_type)) AS lanes, count(DISTINCT lane_type) > 1 AS conflict FROM jobs r GROUP BY r.input_checksum")
def jn17_ag19_by_checksum(t: Tables) -> DataFrame:
    """Jobs by checksum, with the lanes they took and whether those differ."""
    return t.jobs.groupBy("input_checksum").agg(F.count("*").alias("jobs"), F.array_sort(F.collect_set("lane_type")).alias("lanes"), (F.count_distinct("lane_type") > 1).alias("conflict"))


@query(
    """WITH c AS (SELECT candidate_code AS k, panel_key FROM launch_scope_rules), l AS (SELECT canonical_label AS k, min(panel_key) AS panel_key FROM launch_scope_rules GROUP BY 1)
    SELECT o.id, coalesce(c.panel_key, l.panel_key, 'unclassified') AS panel FROM observation o LEFT JOIN c ON c.k = o.accepted_analyte_code LEFT JOIN l ON l.k = lower(trim(o.raw_analyte_label, ' '))"""
)
def jn18_panel_membership(t: Tables) -> DataFrame:
    """The panel by code, else by label, else none."""
    return panels(t).select("id", "panel")


def panels(t: Tables) -> DataFrame:
    c = t.launch_scope_rules.select(F.col("candidate_code").alias("accepted_analyte_code"), F.col("panel_key").alias("by_code"))
    l = t.launch_scope_rules.groupBy(F.col("canonical_label").alias("label")).agg(F.min("panel_key").alias("by_label"))
    return t.observation.withColumn("label", F.lower(F.trim("raw_analyte_label"))).join(c, "accepted_analyte_code", "left").join(l, "label", "left").withColumn("panel", F.coalesce("by_code", "by_label", F.lit("unclassified")))
