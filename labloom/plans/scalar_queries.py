"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labloom.functions import lab
from labloom.plans.catalog import Tables, query

Q = lambda s: "'" + s.replace("'", "''") + "'"
WS = lab.WHITE


def sql_map(d: dict) -> str:
    return "MAP {" + ", ".join(f"{Q(k)}: {Q(v) if isinstance(v, str) else v}" for k, v in d.items()) + "}"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {Q(WS + '+')}, ' ', 'g'))"


def sql_label_key(c: str) -> str:
    s = f"regexp_replace(regexp_replace(translate(lower(trim(coalesce({c}, ''))), {Q(lab.FOLD_FROM)}, {Q(lab.FOLD_TO)}), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9%]+', ' ', 'g')"
    for pattern, word in lab.SHORTCUTS:
        s = f"regexp_replace({s}, {Q(pattern)}, {Q(word)}, 'g')"
    context = "[" + ", ".join(map(Q, lab.CONTEXT_TOKENS)) + "]"
    s = f"array_to_string(list_filter(string_split({s}, ' '), lambda t: t <> '' AND NOT list_contains({context}, t)), ' ')"
    return f"regexp_replace({s}, {Q(r'^(\S+(?: \S+)*?)(?: (?:' + '|'.join(lab.TRAILING_TOKENS) + r'))+$')}, '\\1')"


@query(f"SELECT id, {sql_collapse('raw_text')} AS text FROM extracted_row")
def sc01_collapse_space(t: Tables) -> DataFrame:
    return t.extracted_row.select("id", lab.collapse(F.col("raw_text")).alias("text"))


@query(f"SELECT id, regexp_replace(translate(raw_analyte_label, {Q(lab.FOLD_FROM)}, {Q(lab.FOLD_TO)}), '[^\\x00-\\x7F]', '', 'g') AS folded, lower(trim(coalesce(raw_analyte_label, ''), ' ')) AS lowered FROM observation")
def sc02_sc03_fold(t: Tables) -> DataFrame:
    return t.observation.select("id", lab.ascii_fold(F.col("raw_analyte_label")).alias("folded"), F.lower(F.trim(F.coalesce("raw_analyte_label", F.lit("")))).alias("lowered"))


@query(f"SELECT id, k AS label_key, CASE WHEN len(string_split(k, ' ')) >= 2 THEN array_to_string(list_sort(list_distinct(string_split(k, ' '))), ' ') END AS signature FROM (SELECT id, {sql_label_key('raw_analyte_label')} AS k FROM observation)")
def sc04_sc05_label_key(t: Tables) -> DataFrame:
    k = t.observation.select("id", lab.label_key(F.col("raw_analyte_label")).alias("label_key"))
    return k.select("id", "label_key", lab.token_signature(F.col("label_key")).alias("signature"))


@query(
    f"""WITH a AS (SELECT candidate_code, unnest(list_append(aliases, canonical_label)) AS alias FROM launch_scope_rules),
    v AS (SELECT candidate_code, {sql_label_key('alias')} AS variant FROM a
      UNION SELECT candidate_code, {sql_label_key("regexp_replace(alias, '\\([^)]*\\)', ' ', 'g')")} FROM a
      UNION SELECT candidate_code, {sql_label_key("p")} FROM (SELECT candidate_code, alias, unnest(string_split(alias, '/')) AS p FROM a WHERE contains(alias, '/')) WHERE NOT contains({sql_label_key('alias')}, ' ')
      UNION SELECT candidate_code, {sql_label_key("trim(split_part(alias, ',', 2)) || ' ' || trim(split_part(alias, ',', 1))")} FROM a WHERE contains(alias, ','))
    SELECT candidate_code, variant FROM v WHERE variant <> ''"""
)
def sc06_alias_variants(t: Tables) -> DataFrame:
    a = t.launch_scope_rules.select("candidate_code", F.explode(F.concat("aliases", F.array("canonical_label"))).alias("alias"))
    return a.select("candidate_code", F.explode(lab.alias_variants(F.col("alias"))).alias("variant")).distinct()


_ASCII_LOW = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIRST, _NEXT = _ASCII_LOW("array_to_string(w[1:n], ' ')"), _ASCII_LOW("array_to_string(w[n + 1:2 * n], ' ')")


@query(
    f"""WITH s AS (SELECT id, string_split({sql_collapse('raw_analyte_label')}, ' ') AS w FROM observation), r AS (SELECT id, w, list_filter(range(1, len(w) // 2 + 1), lambda n: {_FIRST} = {_NEXT})[1] AS n FROM s)
    SELECT id, CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_concat(w[1:n], w[2 * n + 1:len(w)]), ' ') END AS label FROM r"""
)
def sc07_collapse_repeats(t: Tables) -> DataFrame:
    """A label that begins with the same words twice keeps them once."""
    return t.observation.select("id", F.regexp_replace(lab.collapse(F.col("raw_analyte_label")), r"(?i)^(.+?) \1(?= |$)", "$1").alias("label"))


@query("SELECT id, replace(replace(replace(replace(replace(raw_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM extracted_row")
def sc12_html_escape(t: Tables) -> DataFrame:
    return t.extracted_row.select("id", lab.html_escape(F.col("raw_text")).alias("escaped"))


@query(
    """SELECT id, CASE WHEN length(x) <= 64 THEN x ELSE CASE WHEN contains(x, '::') THEN split_part(x, '::', 1) ELSE 'id' END || '::' || substr(sha256(x), 1, 32) END AS stable_id, substr(raw_text, 1, 20) AS clipped
    FROM (SELECT id, raw_text, CASE WHEN source_page > 1 THEN 'row::' || id || ':' || raw_text ELSE raw_text END AS x FROM extracted_row)"""
)
def sc13_sc14_stable_id(t: Tables) -> DataFrame:
    x = F.when(F.col("source_page") > 1, F.concat(F.lit("row::"), "id", F.lit(":"), "raw_text")).otherwise(F.col("raw_text"))
    return t.extracted_row.select("id", lab.stable_id(x).alias("stable_id"), F.substring("raw_text", 1, 20).alias("clipped"))


@query("SELECT id, trim(regexp_replace(lower(coalesce(raw_analyte_label, '')), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', ' ', 'g')) AS token FROM observation")
def sc15_comparison_token(t: Tables) -> DataFrame:
    return t.observation.select("id", F.trim(F.regexp_replace(F.lower(F.coalesce("raw_analyte_label", F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " ")).alias("token"))


@query(
    """SELECT doc_id, CASE WHEN s = '' THEN 'en' ELSE s END AS language,
    CASE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AND regexp_matches(text, '[A-Za-z]') THEN 1.0::DOUBLE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') OR regexp_matches(text, '[A-Za-z]') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS bilingual
    FROM (SELECT doc_id, text, split_part(replace(lower(trim(coalesce(lang, ''))), '_', '-'), '-', 1) AS s FROM documents)"""
)
def sc16_sc18_language(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", lab.language(F.col("lang")).alias("language"), lab.bilingual_signal(F.col("text")).alias("bilingual"))


PLACEHOLDERS = ["unknown", "unmapped", "n/a", "placeholder", "mystery", "comment", "see overleaf"]


@query(f"SELECT id, coalesce(list_bool_or(list_transform([{', '.join(map(Q, PLACEHOLDERS))}], lambda m: contains(lower(raw_analyte_label), m))), false) AS placeholder FROM observation")
def sc17_placeholder_label(t: Tables) -> DataFrame:
    hit = F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda m: F.contains(F.lower("raw_analyte_label"), m))
    return t.observation.select("id", F.coalesce(hit, F.lit(False)).alias("placeholder"))


#: Fixed pattern: a printed result line (label, value, unit, rest).
ROW_PATTERN = (
    r"(?i)^([A-Za-z][A-Za-z0-9 /\-().,]+?)(?:\s+[^\x00-\x7F]+)?\s+([<>]?=?\s*-?\d+(?:\.\d+)?)\s*%?\s*"
    r"(%|mmol/L|mmol/l|umol/L|umol/l|micromol/L|mg/L|mg/l|mg/dL|mg/dl|g/dL|g/dl|g/L|g/l|ng/mL|ng/ml|ng/dL|ng/dl|pg/mL|pg/ml|"
    r"mmol/mol|U/L|u/l|IU/L|iu/l|IU/mL|iu/ml|microIU/mL|uIU/mL|mL/min/1\.73m2?|mL/min|mg\s*Alb/mmol|mg/g|"
    r"/cmm|/uL|/mm3|10\^3/uL|10\^6/uL|10\*3/uL|fL|fl|pg|ratio)\s*(.*)$"
)
LINE = "trim(raw_text)"


@query(
    f"""WITH m AS (SELECT id, source_page, {LINE} AS line, regexp_extract({LINE}, {Q(ROW_PATTERN)}, 1) AS l, regexp_extract({LINE}, {Q(ROW_PATTERN)}, 2) AS v, regexp_extract({LINE}, {Q(ROW_PATTERN)}, 3) AS u, trim(regexp_extract({LINE}, {Q(ROW_PATTERN)}, 4)) AS r FROM extracted_row)
    SELECT id, source_page, trim(l) AS label, replace(trim(v), ' ', '') AS value, trim(u) AS unit,
      CASE WHEN regexp_matches(r, '\\([^)]*\\)') THEN '(' || trim(regexp_extract(r, '\\(([^)]*)\\)', 1)) || ')' WHEN regexp_matches(r, '^[<>]=?\\s*\\d+(?:\\.\\d+)?\\s*$') THEN trim(r) END AS reference
    FROM m WHERE l <> '' AND length(trim(l)) >= 2 AND lower(trim(l)) NOT IN ('an egfr', 'egfr(ckd-epi)')"""
)
def sc19_sc21_parse_line(t: Tables) -> DataFrame:
    line = F.trim("raw_text")
    m = t.extracted_row.select("id", "source_page", *[F.regexp_extract(line, ROW_PATTERN, i).alias(c) for i, c in enumerate("lvur", 1)]).withColumn("r", F.trim("r"))
    reference = F.when(F.col("r").rlike(r"\([^)]*\)"), F.concat(F.lit("("), F.trim(F.regexp_extract("r", r"\(([^)]*)\)", 1)), F.lit(")"))).when(F.col("r").rlike(r"^[<>]=?\s*\d+(?:\.\d+)?\s*$"), F.trim("r"))
    m = m.where((F.col("l") != "") & (F.length(F.trim("l")) >= 2) & ~F.lower(F.trim("l")).isin("an egfr", "egfr(ckd-epi)"))
    return m.select("id", "source_page", F.trim("l").alias("label"), F.replace(F.trim("v"), F.lit(" "), F.lit("")).alias("value"), F.trim("u").alias("unit"), reference.alias("reference"))


#: Fixed pattern: a line of HbA1c with both of its units, and the ranges printed for them.
DUAL = r"(?i)^hba1c\b.*?(\d+(?:\.\d+)?)\s*%\s+(\d+(?:\.\d+)?)\s*mmol/mol"
DUAL_ROWS = [("%", 1, "< 5.7"), ("mmol/mol", 2, "< 39")]
#: No line of the tables is of that kind: lines of whole values with two numbers stand in for it, worded so.
_DUAL_LINE = "regexp_replace(raw_text, '^.*?([0-9]+(?:[.][0-9]+)?) .*?([0-9]+(?:[.][0-9]+)?).*$', 'HbA1c (IFCC) \\1 % \\2 mmol/mol')"


@query(
    f"""SELECT id, unnest({[u for u, _, _ in DUAL_ROWS]!r}) AS unit, unnest([{', '.join(f"regexp_extract(line, {Q(DUAL)}, {g})" for _, g, _ in DUAL_ROWS)}]) AS value, unnest({[r for _, _, r in DUAL_ROWS]!r}) AS reference FROM (SELECT id, {_DUAL_LINE} AS line FROM extracted_row) WHERE regexp_matches(line, {Q(DUAL)})"""
)
def sc20_dual_rows(t: Tables) -> DataFrame:
    """A line of HbA1c in both of its units gives a row for each, with the range printed for it; no other label does."""
    line = F.regexp_replace("raw_text", r"^.*?([0-9]+(?:[.][0-9]+)?) .*?([0-9]+(?:[.][0-9]+)?).*$", "HbA1c (IFCC) $1 % $2 mmol/mol")
    hit = t.extracted_row.select("id", line.alias("line")).where(F.col("line").rlike(DUAL))
    return hit.select("id", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.regexp_extract("line", DUAL, g).alias("value"), F.lit(r).alias("reference")) for u, g, r in DUAL_ROWS])).alias("r")).select("id", "r.*")


@query(f"SELECT id, list_extract(regexp_extract_all(raw_text, {Q('(' + lab.RANGE_PATTERN + ')')}, 1), -1) AS last_range FROM extracted_row")
def sc23_last_range(t: Tables) -> DataFrame:
    return t.extracted_row.select("id", lab.last_range(F.col("raw_text")).alias("last_range"))


@query(
    """WITH s AS (SELECT id, regexp_replace(raw_value_string, '[^\\d\\.-]+', '', 'g') AS s FROM extracted_row),
    k AS (SELECT id, CASE WHEN length(s) - length(replace(s, '.', '')) > 1 THEN substr(s, 1, instr(s, '.')) || replace(substr(s, instr(s, '.') + 1), '.', '') ELSE s END AS s FROM s)
    SELECT id, CASE WHEN regexp_matches(s, '^-?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast(s AS DOUBLE) END AS value FROM k"""
)
def sc24_clean_number(t: Tables) -> DataFrame:
    return t.extracted_row.select("id", lab.clean_number(F.col("raw_value_string")).alias("value"))


@query(
    f"""WITH s AS (SELECT id, replace(replace({sql_collapse('raw_value_string')}, ' ', ''), '''', '') AS s FROM extracted_row),
    k AS (SELECT id, s, contains(s, ',') AS c, contains(s, '.') AS d, regexp_matches(s, '^\\d+,\\d{{3}}$') AS ct, regexp_matches(s, '^\\d+[.]\\d{{3}}$') AS dt, instr(reverse(s), ',') < instr(reverse(s), '.') AS cl FROM s),
    p AS (SELECT id, s, CASE WHEN c AND d AND cl THEN replace(replace(s, '.', ''), ',', '.') WHEN c AND d THEN replace(s, ',', '') WHEN c AND ct THEN replace(s, ',', '') WHEN c THEN replace(s, ',', '.') WHEN d AND dt THEN replace(s, '.', '') ELSE s END AS plain,
      CASE WHEN c AND d THEN CASE WHEN cl THEN ',' ELSE '.' END WHEN c AND NOT ct THEN ',' WHEN d AND NOT c AND NOT dt THEN '.' END AS decimal_separator,
      CASE WHEN c AND d THEN CASE WHEN cl THEN '.' ELSE ',' END WHEN c AND ct THEN ',' WHEN d AND NOT c AND dt THEN '.' END AS thousands_separator FROM k),
    v AS (SELECT id, decimal_separator, thousands_separator, CASE WHEN regexp_matches(plain, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast(plain AS DOUBLE) END AS value FROM p)
    SELECT *, nullif(concat_ws('+', CASE decimal_separator WHEN ',' THEN 'decimal_comma' WHEN '.' THEN 'decimal_dot' END, CASE thousands_separator WHEN ',' THEN 'thousands_comma' WHEN '.' THEN 'thousands_dot' END, CASE WHEN value IS NOT NULL THEN 'normalized' END), '') AS descriptor FROM v"""
)
def sc25_sc41_locale_number(t: Tables) -> DataFrame:
    n = t.extracted_row.select("id", lab.locale_number(F.col("raw_value_string")).alias("n"))
    return n.select("id", "n.value", "n.decimal_separator", "n.thousands_separator", lab.locale_descriptor(F.col("n")).alias("descriptor"))


TOKEN_PARTS = r"^([<>]=?|≤|≥)?\s*([0-9][0-9.,]*)\s*([HLAhla*])?$"


@query(f"SELECT id, nullif(regexp_extract(raw_value_string, {Q(TOKEN_PARTS)}, 1), '') AS comparator, nullif(regexp_extract(raw_value_string, {Q(TOKEN_PARTS)}, 2), '') AS digits, nullif(upper(regexp_extract(raw_value_string, {Q(TOKEN_PARTS)}, 3)), '') AS flag FROM extracted_row")
def sc26_value_token(t: Tables) -> DataFrame:
    part = lambda i: F.nullif(F.regexp_extract("raw_value_string", TOKEN_PARTS, i), F.lit(""))
    return t.extracted_row.select("id", part(1).alias("comparator"), part(2).alias("digits"), F.upper(part(3)).alias("flag"))


@query(
    f"""WITH c AS (SELECT p_partkey, p_retailprice / 100 AS v, (['mg/dl', 'g/l', 'mg/l', 'mmol/l', 'umol/l'])[1 + p_partkey % 5] AS a, (['mmol/l', 'umol/l', 'mg/dl', 'g/l', 'mg/l'])[1 + p_partkey % 4] AS b, (['glucose', 'cholesterol', 'triglycerides', 'calcium', 'creatinine', 'sodium'])[1 + p_size % 6] AS n FROM part),
    f AS (SELECT *, {sql_map(lab.MASS_FACTORS)} AS ma, {sql_map(lab.MOLAR_FACTORS)} AS mo, {sql_map(lab.MOLAR_WEIGHTS)}[n] AS w FROM c)
    SELECT p_partkey, CASE WHEN a = b THEN v WHEN ma[a] IS NOT NULL AND mo[b] IS NOT NULL THEN round(v * ma[a] / w / mo[b], 4) WHEN mo[a] IS NOT NULL AND ma[b] IS NOT NULL THEN round(v * mo[a] * w / ma[b], 4) END AS converted FROM f"""
)
def sc28_molar_convert(t: Tables) -> DataFrame:
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    k = F.col("p_partkey")
    return t.part.select("p_partkey", lab.molar_convert(F.col("p_retailprice") / 100, pick(["mg/dl", "g/l", "mg/l", "mmol/l", "umol/l"], k % 5), pick(["mmol/l", "umol/l", "mg/dl", "g/l", "mg/l"], k % 4), pick(["glucose", "cholesterol", "triglycerides", "calcium", "creatinine", "sodium"], F.col("p_size") % 6)).alias("converted"))


UNIT = f"{sql_collapse('lower(coalesce(raw_unit_string, ' + Q('') + '))')}"


@query(
    f"""SELECT id, {sql_map(lab.SUPPORTED_UNITS)}[trim(regexp_replace(regexp_replace(replace(lower(coalesce(raw_unit_string, '')), '²', '2'), '\\{{1\\.73[_ ]?m2\\}}', '1.73 m2', 'g'), {Q(WS + '+')}, ' ', 'g'))] AS spelling,
    coalesce({sql_map(lab.UNIT_SYNONYMS)}[{UNIT}], {UNIT}) AS token, {UNIT} IN ({', '.join(map(Q, lab.BYPASS_UNITS))}) AS bypass FROM extracted_row"""
)
def sc29_sc31_units(t: Tables) -> DataFrame:
    u = F.col("raw_unit_string")
    return t.extracted_row.select("id", lab.canonical_spelling(u).alias("spelling"), lab.unit_token(u).alias("token"), lab.collapse(F.lower(F.coalesce(u, F.lit("")))).isin(lab.BYPASS_UNITS).alias("bypass"))


@query("SELECT o_orderkey, abs(o_totalprice - round(o_totalprice, 2)) <= 1e-9 * greatest(abs(o_totalprice), abs(round(o_totalprice, 2))) AS close, strftime(o_orderdate, '%Y-%m-%d') AS iso_date FROM orders")
def sc33_sc35_close_and_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", lab.is_close(F.col("o_totalprice"), F.round("o_totalprice", 2)).alias("close"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_date"))


DATE_TOKEN, TIME_TOKEN, YEAR_TOKEN = r"^\d{1,4}[/-]\d{1,2}(?:[/-]\d{1,4})?$", r"^\d{1,2}:\d{2}(?::\d{2})?$", r"^(?:19|20)\d{2}$"


@query(f"SELECT id, token, regexp_matches(token, {Q(DATE_TOKEN)}) AS is_date, regexp_matches(token, {Q(TIME_TOKEN)}) AS is_time, regexp_matches(token, {Q(YEAR_TOKEN)}) AS is_year FROM (SELECT id, unnest(list_filter(string_split(raw_text, ' '), lambda x: x <> '')) AS token FROM extracted_row) WHERE regexp_matches(token, '[0-9]')")
def sc35_date_tokens(t: Tables) -> DataFrame:
    tokens = t.extracted_row.select("id", F.explode(F.filter(F.split("raw_text", " "), lambda x: x != "")).alias("token")).where(F.col("token").rlike("[0-9]"))
    return tokens.select("id", "token", F.col("token").rlike(DATE_TOKEN).alias("is_date"), F.col("token").rlike(TIME_TOKEN).alias("is_time"), F.col("token").rlike(YEAR_TOKEN).alias("is_year"))


@query("SELECT id, sha256(document_id || ':' || source_page::VARCHAR || ':' || coalesce(raw_text, '')) AS row_digest, substr(sha256('packet:' || document_id || ':lab'), 1, 24) AS packet_id FROM extracted_row")
def sc36_row_digests(t: Tables) -> DataFrame:
    return t.extracted_row.select("id", F.sha2(F.concat_ws(":", "document_id", F.col("source_page").cast("string"), F.coalesce("raw_text", F.lit(""))), 256).alias("row_digest"), F.substring(F.sha2(F.concat(F.lit("packet:"), "document_id", F.lit(":lab")), 256), 1, 24).alias("packet_id"))


@query(
    f"""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS observation_uuid
    FROM (SELECT id, sha1(unhex('{lab.URL_NAMESPACE}') || encode(document_id || ':' || row_hash)) AS h FROM extracted_row)"""
)
def sc37_uuid5(t: Tables) -> DataFrame:
    return t.extracted_row.select("id", lab.uuid5(F.concat_ws(":", "document_id", "row_hash")).alias("observation_uuid"))


@query(
    """SELECT id, '{"current_step":' || coalesce('"' || current_step || '"', 'null') || ',"lane_type":"' || lane_type || '","retry_count":' || retry_count || ',"status":"' || status || '"}' AS canonical_json FROM jobs"""
)
def sc38_canonical_json(t: Tables) -> DataFrame:
    """Members in the order of their names, no spaces, nulls written out."""
    return t.jobs.select("id", F.to_json(F.struct("current_step", "lane_type", "retry_count", "status"), {"ignoreNullFields": "false"}).alias("canonical_json"))


@query("SELECT id, coalesce(list_extract(list_filter(suppression_reasons, lambda r: r IS NOT NULL AND r <> ''), 1), 'none') AS first_reason, coalesce(MAP {'supported': 0, 'partial': 1, 'unsupported': 2}[support_state], 9) AS state_rank, list_filter(candidates, lambda c: c.accepted)[1].candidate_code AS accepted FROM observation")
def sc39_sc40_first_and_lookup(t: Tables) -> DataFrame:
    ranks = F.create_map(F.lit("supported"), F.lit(0), F.lit("partial"), F.lit(1), F.lit("unsupported"), F.lit(2))
    first = F.get(F.filter("suppression_reasons", lambda r: r.isNotNull() & (r != "")), F.lit(0))
    accepted = F.get(F.filter("candidates", lambda c: c["accepted"]), F.lit(0))["candidate_code"]
    return t.observation.select("id", F.coalesce(first, F.lit("none")).alias("first_reason"), F.coalesce(ranks[F.col("support_state")], F.lit(9)).alias("state_rank"), accepted.alias("accepted"))


@query("SELECT job_id, string_agg(coalesce(accepted_analyte_display, raw_analyte_label) || ': ' || coalesce(raw_value_string, '-') || coalesce(' ' || raw_unit_string, ''), '; ' ORDER BY id) AS summary, count(*) AS n FROM observation GROUP BY job_id")
def sc43_job_summary(t: Tables) -> DataFrame:
    """A line of text for each job: its results in order of id."""
    line = F.concat(F.coalesce("accepted_analyte_display", "raw_analyte_label"), F.lit(": "), F.coalesce("raw_value_string", F.lit("-")), F.coalesce(F.concat(F.lit(" "), "raw_unit_string"), F.lit("")))
    rows = t.observation.select("job_id", F.struct("id", line.alias("line")).alias("r")).where("r.line is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "; ")
    counted = t.observation.groupBy("job_id").agg(F.count("*").alias("n"))
    return counted.join(rows.groupBy("job_id").agg(text.alias("summary")), "job_id", "left").select("job_id", "summary", "n")
