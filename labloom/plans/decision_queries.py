"""Derived results of rows and observations: resolution, ranges, bands, line kinds, measurements, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labloom.functions import lab
from labloom.operators import grammar, ranges, resolution
from labloom.plans.catalog import Tables, query
from labloom.plans.relational_queries import ALIASES_SQL, HEADER_PREFIXES, SIG, alias_keys, begins, sql_begins
from labloom.plans.scalar_queries import WS, Q, sql_collapse, sql_label_key, sql_map


@query(
    f"""WITH d AS (SELECT DISTINCT candidate_code, canonical_label, ordinal, k FROM {ALIASES_SQL}),
    x AS (SELECT k, count(DISTINCT candidate_code) AS n, arg_min(candidate_code, ({sql_label_key('canonical_label')} <> k, ordinal, candidate_code)) AS code FROM d GROUP BY k),
    s AS (SELECT s, count(DISTINCT candidate_code) AS n, min(candidate_code) AS code FROM (SELECT candidate_code, {SIG('k')} AS s FROM d) WHERE s IS NOT NULL GROUP BY s),
    o AS (SELECT id, k, {SIG('k')} AS s FROM (SELECT id, {sql_label_key('raw_analyte_label')} AS k FROM observation))
    SELECT o.id, CASE WHEN o.k = '' THEN NULL WHEN x.code IS NOT NULL THEN x.code WHEN s.n = 1 THEN s.code ELSE '__unmapped__' END AS candidate_code,
      CASE WHEN o.k = '' THEN 'no_label' WHEN x.code IS NOT NULL THEN NULL WHEN s.n = 1 THEN NULL WHEN s.n > 1 THEN 'ambiguous_tokens' ELSE 'unsupported_alias' END AS reason
    FROM o LEFT JOIN x ON x.k = o.k LEFT JOIN s ON s.s = o.s"""
)
def dm01_dm02_resolution(t: Tables) -> DataFrame:
    """The code of each label, by key, else by its words where they are unique, else the reason for none."""
    d = alias_keys(t.launch_scope_rules).select("candidate_code", "canonical_label", "ordinal", "k").distinct()
    best = F.struct((lab.label_key(F.col("canonical_label")) != F.col("k")).alias("other"), "ordinal", "candidate_code")
    x = d.groupBy("k").agg(F.min(best)["candidate_code"].alias("x_code"))
    s = d.select("candidate_code", lab.token_signature(F.col("k")).alias("s")).where("s is not null").groupBy("s").agg(F.count_distinct("candidate_code").alias("n"), F.min("candidate_code").alias("s_code"))
    o = t.observation.select("id", lab.label_key(F.col("raw_analyte_label")).alias("k")).withColumn("s", lab.token_signature(F.col("k"))).join(x, "k", "left").join(s, "s", "left")
    empty, unique = F.col("k") == "", F.col("n") == 1
    code = F.when(empty, None).when(F.col("x_code").isNotNull(), F.col("x_code")).when(unique, F.col("s_code")).otherwise("__unmapped__")
    reason = F.when(empty, "no_label").when(F.col("x_code").isNotNull() | unique, None).when(F.col("n") > 1, "ambiguous_tokens").otherwise("unsupported_alias")
    return o.select("id", code.alias("candidate_code"), reason.alias("reason"))


#: No table tells of metrics and profiles: codes with a molar weight or a canonical unit are numeric, every third has no profile.
METRICS_SQL = "(SELECT candidate_code, canonical_unit_ucum IS NOT NULL AS numeric, CASE WHEN ordinal % 3 > 0 THEN panel_key || ':adult' END AS profile_id FROM launch_scope_rules)"
_CLEAN = "regexp_replace(raw_value_string, '[^\\d\\.-]+', '', 'g')"
_UNIT_KEY = f"trim(regexp_replace(regexp_replace(replace(lower(coalesce(raw_unit_string, '')), '²', '2'), '\\{{1\\.73[_ ]?m2\\}}', '1.73 m2', 'g'), {Q(WS + '+')}, ' ', 'g'))"


@query(
    f"""WITH d AS (SELECT DISTINCT candidate_code, canonical_label, ordinal, k FROM {ALIASES_SQL}),
    x AS (SELECT k, arg_min(candidate_code, ({sql_label_key('canonical_label')} <> k, ordinal, candidate_code)) AS code FROM d GROUP BY k),
    s AS (SELECT s, count(DISTINCT candidate_code) AS n, min(candidate_code) AS code FROM (SELECT candidate_code, {SIG('k')} AS s FROM d) WHERE s IS NOT NULL GROUP BY s),
    o AS (SELECT *, {SIG('k')} AS sig FROM (SELECT *, {sql_label_key('raw_analyte_label')} AS k, coalesce(extraction_confidence < 0.90, false) AS gated, {_CLEAN} AS c0 FROM extracted_row)),
    n AS (SELECT *, CASE WHEN length(c0) - length(replace(c0, '.', '')) > 1 THEN substr(c0, 1, instr(c0, '.')) || replace(substr(c0, instr(c0, '.') + 1), '.', '') ELSE c0 END AS c1 FROM o),
    r AS (SELECT n.id, gated, CASE WHEN gated OR n.k = '' THEN NULL WHEN x.code IS NOT NULL THEN x.code WHEN s.n = 1 THEN s.code END AS code, CASE WHEN gated THEN 'low_extraction_confidence' WHEN n.k = '' OR x.code IS NOT NULL OR s.n = 1 THEN NULL WHEN s.n > 1 THEN 'ambiguous_tokens' ELSE 'unsupported_alias' END AS why,
      CASE WHEN gated THEN NULL ELSE coalesce(parsed_numeric_value, CASE WHEN regexp_matches(c1, '^-?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast(c1 AS DOUBLE) END) END AS value, nullif(raw_unit_string, '') AS unit, {_UNIT_KEY} AS uk FROM n LEFT JOIN x ON x.k = n.k LEFT JOIN s ON s.s = n.sig),
    v AS (SELECT r.*, coalesce(m.numeric, false) AS numeric, m.profile_id AS profile, CASE WHEN value IS NOT NULL AND unit IS NOT NULL THEN CASE WHEN {sql_collapse('lower(unit)')} IN ({', '.join(map(Q, lab.BYPASS_UNITS))}) THEN unit ELSE coalesce({sql_map(lab.SUPPORTED_UNITS)}[uk], unit) END END AS spelled FROM r LEFT JOIN {METRICS_SQL} m ON m.candidate_code = r.code)
    SELECT id, CASE WHEN code IS NULL THEN 'unsupported' WHEN numeric AND value IS NULL THEN 'partial' ELSE 'supported' END AS support_state, code AS candidate_code, array_to_string(list_sort(list_filter([why, CASE WHEN numeric AND value IS NULL THEN 'missing_numeric_value' END, CASE WHEN numeric AND value IS NOT NULL AND profile IS NULL THEN 'unresolved_reference_profile' END], lambda e: e IS NOT NULL)), ',') AS reasons,
      value, CASE WHEN numeric AND value IS NOT NULL THEN profile END AS profile_id, CASE WHEN spelled IS NOT NULL THEN value END AS canonical_value, spelled AS canonical_unit FROM v"""
)
def dm01_dm02_prj03_normalized(t: Tables) -> DataFrame:
    """Every printed row through the chain: confidence, code, number, profile, unit."""
    r = t.launch_scope_rules
    metrics = r.select("candidate_code", F.col("canonical_unit_ucum").isNotNull().alias("numeric"), F.when(F.col("ordinal") % 3 > 0, F.concat("panel_key", F.lit(":adult"))).alias("profile_id"))
    return resolution.normalize(t.extracted_row, alias_keys(r), metrics)


_S = "trim(regexp_replace(regexp_replace(lower(trim(raw_reference_range, ' ')), '^[()\\[\\]]+|[()\\[\\]]+$', '', 'g'), '\\s+', ' ', 'g'), ' ')"
_NUM = lambda c: f"CASE WHEN regexp_matches(trim({c}, ' '), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast(trim({c}, ' ') AS DOUBLE) END"
BOUNDS_SQL = f"""(SELECT id, v, r, CASE WHEN h AND a IS NOT NULL AND b IS NOT NULL THEN a WHEN NOT h AND regexp_matches(s, '^[>≥]') THEN d END AS low, CASE WHEN h AND a IS NOT NULL AND b IS NOT NULL THEN b WHEN NOT h AND regexp_matches(s, '^[<≤]') THEN u END AS high
    FROM (SELECT *, contains(s, '-') AND NOT starts_with(s, '-') AS h, {_NUM("split_part(s, '-', 1)")} AS a, {_NUM("substr(s, instr(s, '-') + 1)")} AS b, {_NUM("regexp_replace(s, '^[<=≤ ]+', '')")} AS u, {_NUM("regexp_replace(s, '^[>=≥ ]+', '')")} AS d FROM (SELECT id, parsed_numeric_value AS v, raw_reference_range AS r, {_S} AS s FROM observation)))"""


@query(f"SELECT id, low, high FROM {BOUNDS_SQL} WHERE low IS NOT NULL OR high IS NOT NULL")
def dm11_printed_bounds(t: Tables) -> DataFrame:
    return t.observation.select("id", ranges.bounds(F.col("raw_reference_range")).alias("b")).where("b is not null").select("id", "b.low", "b.high")


_G = lambda p, i: f"regexp_extract({p}, {Q(ranges.BAND)}, {i})"
_D = lambda p, i: f"try_cast({_G(p, i)} AS DOUBLE)"
_HOLDS = f"coalesce(CASE WHEN {_G('p', 2)} = '<' THEN v < {_D('p', 3)} WHEN {_G('p', 2)} <> '' THEN v <= {_D('p', 3)} WHEN {_G('p', 4)} = '>' THEN v > {_D('p', 5)} WHEN {_G('p', 4)} <> '' THEN v >= {_D('p', 5)} WHEN {_G('p', 6)} <> '' THEN v BETWEEN {_D('p', 6)} AND {_D('p', 7)} END, false)"
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, {Q(w)})" for w in words) + ")"
BAND_SQL = f"""(WITH q AS (SELECT id, parsed_numeric_value AS v, list_filter(list_transform(string_split(regexp_replace(lower(raw_reference_range), '[\\n|]+', ';', 'g'), ';'), lambda p: trim(p, ' ')), lambda p: p <> '') AS parts FROM observation WHERE raw_reference_range IS NOT NULL),
    e AS (SELECT id, v, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM q WHERE len(parts) >= 2),
    f AS (SELECT id, arg_min(p, i) AS p FROM e WHERE {_HOLDS} GROUP BY id)
    SELECT id, CASE WHEN {_ANY(_G('p', 1), ranges.NOT_ABNORMAL)} THEN 'normal' WHEN {_ANY(_G('p', 1), ranges.ABNORMAL_WORDS)} THEN 'abnormal' ELSE 'normal' END AS band FROM f)"""


@query(f"SELECT id, band FROM {BAND_SQL}")
def dm13_named_bands(t: Tables) -> DataFrame:
    """The band a value falls into, where a range is a table of bands."""
    return t.observation.select("id", ranges.band(F.col("parsed_numeric_value"), F.col("raw_reference_range")).alias("band")).where("band is not null")


@query(
    f"""SELECT b.id, CASE WHEN b.v IS NULL OR b.r IS NULL OR trim(b.r, ' ') = '' THEN NULL WHEN lower(trim(b.r, ' ')) IN ({', '.join(map(Q, ranges.NORMAL_WORDS))}) THEN true
    WHEN b.low IS NOT NULL OR b.high IS NOT NULL THEN coalesce(b.v >= b.low, true) AND coalesce(b.v <= b.high, true) ELSE n.band = 'normal' END AS within_range FROM {BOUNDS_SQL} b LEFT JOIN {BAND_SQL} n ON n.id = b.id"""
)
def dm12_within_range(t: Tables) -> DataFrame:
    return t.observation.select("id", ranges.within(F.col("parsed_numeric_value"), F.col("raw_reference_range")).alias("within_range"))


_SAID = lambda c: f"nullif(trim({c}, ' '), '')"


@query(
    f"""WITH o AS (SELECT id, coalesce(job_id, '') AS job, created_at, support_state, coalesce(canonical_value, parsed_numeric_value) AS v, coalesce(canonical_unit, '') AS u, {_SAID('specimen_context')} AS sp, {_SAID('method_context')} AS me, {_SAID('accepted_analyte_code')} AS code, {_SAID('accepted_analyte_display')} AS display, {_SAID('raw_analyte_label')} AS label FROM observation),
    m AS (SELECT c.id, c.v, s.id AS pid, s.v AS pv, s.created_at AS pat, row_number() OVER (PARTITION BY c.id ORDER BY s.created_at DESC NULLS LAST, s.id DESC) AS rn FROM o c LEFT JOIN o s ON s.support_state = 'supported' AND s.job <> c.job AND CASE WHEN c.code IS NOT NULL THEN s.code = c.code WHEN c.display IS NOT NULL THEN s.display = c.display ELSE s.label = c.label END
      AND (c.u = '' OR s.u = c.u) AND s.sp IS NOT DISTINCT FROM c.sp AND s.me IS NOT DISTINCT FROM c.me)
    SELECT id, CASE WHEN v IS NOT NULL AND pv IS NOT NULL THEN pid END AS previous_id, CASE WHEN v IS NOT NULL THEN pv END AS previous_value, CASE WHEN v IS NOT NULL AND pv IS NOT NULL THEN strftime(pat, '%Y-%m-%d') END AS previous_date,
      CASE WHEN v IS NULL OR pv IS NULL THEN 'trend_unavailable' WHEN v > pv THEN 'increased' WHEN v < pv THEN 'decreased' ELSE 'similar' END AS direction, CASE WHEN v IS NULL OR pv IS NULL THEN 'unavailable' ELSE 'available' END AS comparability_status FROM m WHERE rn = 1"""
)
def jn11_dm18_history_cards(t: Tables) -> DataFrame:
    """Each observation against the latest comparable one of another job: by code, else display, else label; same unit if it has one, same specimen and method."""
    c = resolution.comparable(t.observation)
    both = F.col("value").isNotNull() & F.col("previous_value").isNotNull()
    direction = F.when(~both, "trend_unavailable").when(F.col("value") > F.col("previous_value"), "increased").when(F.col("value") < F.col("previous_value"), "decreased").otherwise("similar")
    return c.select("id", F.when(both, F.col("previous_id")).alias("previous_id"), F.when(F.col("value").isNotNull(), F.col("previous_value")).alias("previous_value"), F.when(both, F.date_format("previous_at", "yyyy-MM-dd")).alias("previous_date"), direction.alias("direction"), F.when(both, "available").otherwise("unavailable").alias("comparability_status"))


@query(
    """WITH s AS (SELECT accepted_analyte_code AS code, job_id, coalesce(canonical_value, parsed_numeric_value) AS v, created_at, id, lag(coalesce(canonical_value, parsed_numeric_value)) OVER (PARTITION BY accepted_analyte_code, canonical_unit ORDER BY created_at, id) AS p FROM observation WHERE support_state = 'supported' AND accepted_analyte_code IS NOT NULL AND coalesce(canonical_value, parsed_numeric_value) IS NOT NULL)
    SELECT id, CASE WHEN p IS NULL THEN 'unavailable' WHEN v > p THEN 'increased' WHEN v < p THEN 'decreased' ELSE 'similar' END AS direction FROM s"""
)
def dm18_direction(t: Tables) -> DataFrame:
    """Each result against the one before it of the same kind and unit."""
    from pyspark.sql import Window

    v = F.coalesce("canonical_value", "parsed_numeric_value")
    s = t.observation.where((F.col("support_state") == "supported") & F.col("accepted_analyte_code").isNotNull() & v.isNotNull())
    p = F.lag(v).over(Window.partitionBy("accepted_analyte_code", "canonical_unit").orderBy("created_at", "id"))
    return s.withColumn("p", p).select("id", F.when(F.col("p").isNull(), "unavailable").when(v > F.col("p"), "increased").when(v < F.col("p"), "decreased").otherwise("similar").alias("direction"))


#: Fixed patterns: what continues a row without being a value.
UNIT_ONLY, RANGE_ONLY, COMPARATOR, NUMERIC = r"^(?:%|[a-zA-Z]+/[a-zA-Z0-9/]+|[a-zA-Z]{1,4}\d*)$", r"^[\[(]?\s*(?:<=|>=|<|>)?\s*\d[\d.,]*\s*[-–]\s*(?:<=|>=|<|>)?\s*\d[\d.,]*\s*[\])]?$", r"^(?:<=|>=|<|>|≤|≥)\s*\d", r"(?:^|\s)(?:<=|>=|<|>|≤|≥)?\s*\d[\d.,]*(?:\s|$)"
FLAGS = ["high", "low", "normal", "abnormal", "h", "l", "trace", "positive", "negative"]
PIECES_SQL = f"(SELECT id, field, {sql_collapse('x')} AS line FROM (SELECT id, unnest(['label', 'value', 'unit', 'range']) AS field, unnest([raw_analyte_label, raw_value_string, raw_unit_string, raw_reference_range]) AS x FROM extracted_row) WHERE x IS NOT NULL)"


@query(
    f"""SELECT id, field, CASE WHEN line = '' THEN 'empty' WHEN {sql_begins('lower(line)', HEADER_PREFIXES)} THEN 'excluded' WHEN regexp_matches(line, {Q(UNIT_ONLY)}) THEN 'continuation:unit' WHEN regexp_matches(line, {Q(RANGE_ONLY)}) THEN 'continuation:reference_range'
    WHEN lower(line) IN ({', '.join(map(Q, FLAGS))}) THEN 'continuation:flag' WHEN regexp_matches(line, {Q(COMPARATOR)}) OR regexp_matches(line, {Q(NUMERIC)}) THEN 'value' ELSE 'label' END AS kind FROM {PIECES_SQL}"""
)
def dm27_dm31_line_kinds(t: Tables) -> DataFrame:
    """What each printed piece is: excluded, continuation, value or label, by the first rule that fits."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("x")) for n, c in (("label", "raw_analyte_label"), ("value", "raw_value_string"), ("unit", "raw_unit_string"), ("range", "raw_reference_range"))])
    p = t.extracted_row.select("id", F.explode(fields).alias("f")).where("f.x is not null").select("id", "f.field", lab.collapse(F.col("f.x")).alias("line"))
    l = F.col("line")
    kind = (
        F.when(l == "", "empty").when(begins(F.lower(l), HEADER_PREFIXES), "excluded").when(l.rlike(UNIT_ONLY), "continuation:unit").when(l.rlike(RANGE_ONLY), "continuation:reference_range")
        .when(F.lower(l).isin(FLAGS), "continuation:flag").when(l.rlike(COMPARATOR) | l.rlike(NUMERIC), "value").otherwise("label")
    )
    return p.select("id", "field", kind.alias("kind"))


@query()
def dm28_dm30_measurements(t: Tables) -> DataFrame:
    """The measurement grammar over every printed line."""
    return grammar.measurements(t.extracted_row, "id", "raw_text")


@query("SELECT document_id, bool_or(regexp_matches(raw_text, '[\\x{4e00}-\\x{9fff}]')) AS bilingual, count(*) AS lines FROM extracted_row GROUP BY document_id")
def dm34_adapter_choice(t: Tables) -> DataFrame:
    """Documents with CJK text take the bilingual layout."""
    return t.extracted_row.groupBy("document_id").agg(F.coalesce(F.bool_or(F.col("raw_text").rlike(r"[\x{4e00}-\x{9fff}]")), F.lit(None)).alias("bilingual"), F.count("*").alias("lines"))


@query(
    """WITH p AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\d+\\s*[-–]\\s*\\d+')) AS ranges, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN starts_with(lower(text), 'page ') THEN 'header' WHEN ranges >= 2 THEN 'threshold' WHEN numbers = 0 THEN 'narrative' WHEN numbers > lines THEN 'table' ELSE 'mixed' END AS page_class FROM p"""
)
def dm35_page_class(t: Tables) -> DataFrame:
    """The class of a page by the first rule that fits."""
    x = F.col("text")
    n = lambda p: F.regexp_count(x, F.lit(p))
    c = F.when(F.lower(x).startswith("page "), "header").when(n(r"\d+\s*[-–]\s*\d+") >= 2, "threshold").when(n("[0-9]+") == 0, "narrative").when(n("[0-9]+") > F.size(F.split(x, "\n")), "table").otherwise("mixed")
    return t.documents.where(x.isNotNull()).select("doc_id", c.alias("page_class"))
