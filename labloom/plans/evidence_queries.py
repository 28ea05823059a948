"""Evidence of pages, lines and rows; rates, ladders, histories, validation and persistence with their unresolved references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from labloom.operators import evidence as ev
from labloom.plans.catalog import Tables, query
from labloom.plans.relational_queries import sql_list
from labloom.plans.scalar_queries import Q

# --- lines and rows -----------------------------------------------------------------------------------------------
_SPACED = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), ' ')"
_HITS = lambda words: f"len(list_filter({sql_list(words)}, lambda m: contains(x, m)))"
_N = lambda p: f"len(regexp_extract_all(x, {Q(p)}))"
_DENSITY = lambda words: f"{_HITS(words)} / greatest({_N(ev.TOKEN)}, 1)"
_LABEL = f"len(list_filter(regexp_extract_all(x, {Q(ev.TOKEN)}), lambda t: length(t) > 2 AND regexp_matches(t, '[a-z]') AND NOT list_contains({sql_list(ev.LABEL_STOPWORDS)}, t))) > 0"
# ends of words in any script, as DuckDB's own are of ASCII letters only
_EDGE = r"[^\p{L}\p{N}_]"
_WORDED = ev.UNIT_WORD.replace(r"\b", f"(?:^|{_EDGE})", 1).replace(r"\b", f"(?:$|{_EDGE})")
_UNIT = f"(regexp_matches(x, {Q(ev.RANGE)}) OR {_HITS(['reference range', 'reference interval', *ev.UNIT_HINTS])} > 0 OR regexp_matches(x, {Q(_WORDED)}))"
_VALUE = f"regexp_matches(x, {Q(ev.VALUE)})"
_NUMBERS = f"CASE WHEN {_N(ev.WORD)} = 0 THEN 0 ELSE round({_N(ev.NUMERIC)} / {_N(ev.WORD)}, 4) END"


@query(
    f"""WITH l AS (SELECT id, {_SPACED('raw_text')} AS w, lower({_SPACED('raw_text')}) AS x FROM extracted_row),
    d AS (SELECT *, CASE WHEN {_HITS(ev.THRESHOLDS)} > 0 OR regexp_matches(x, {Q(ev.RANGE)}) THEN 1.0 ELSE 0.0 END AS td FROM l)
    SELECT id, x <> '' AND ({_HITS(ev.RISK_MARKERS)} > 0 OR {_HITS(ev.NOTE_MARKERS)} > 0 OR {_HITS(ev.CITATIONS)} > 0) AND NOT ({_VALUE} AND {_LABEL} AND {_UNIT} AND {_DENSITY(ev.CITATIONS)} < 0.12 AND {_DENSITY(ev.NARRATIVE)} < 0.2) AS suppressed,
      x <> '' AND {_HITS(ev.NON_RESULT)} = 0 AND {_VALUE} AND {_LABEL} AND {_UNIT} AND {_NUMBERS} >= 0.08 AND {_DENSITY(ev.NARRATIVE)} < 0.08 AND greatest(td, {_DENSITY(ev.THRESHOLDS)}) < 0.08 AND {_DENSITY(ev.CITATIONS)} < 0.06 AS result_like,
      x <> '' AND NOT {_VALUE} AND (len(list_filter({sql_list(ev.HEADINGS)}, lambda h: x = h OR starts_with(x, h || ' '))) > 0 OR (w = upper(w) AND w <> lower(w) AND len(string_split(x, ' ')) <= 8)) AS heading FROM d"""
)
def flt13_flt14_flt15_lines(t: Tables) -> DataFrame:
    """Each printed line: suppressed before parsing, like a result, or a heading alone. A line is a block of its own."""
    x = ev.compact(F.col("raw_text"))
    l = t.extracted_row.select("id", "raw_text", x.alias("x"))
    thresholds = F.when(ev.holds(F.col("x"), ev.THRESHOLDS) | F.col("x").rlike(ev.RANGE), 1.0).otherwise(0.0)
    return l.select("id", ev.suppressed_before_parsing(F.col("x")).alias("suppressed"), ev.result_like(F.col("x"), thresholds).alias("result_like"), ev.heading_only(F.col("raw_text")).alias("heading"))


_SUPPRESSED = f"({_HITS(ev.RISK_MARKERS)} > 0 OR {_HITS(ev.NOTE_MARKERS)} > 0 OR {_HITS(ev.CITATIONS)} > 0) AND NOT ({_VALUE} AND {_LABEL} AND {_UNIT} AND {_DENSITY(ev.CITATIONS)} < 0.12 AND {_DENSITY(ev.NARRATIVE)} < 0.2)"
_LIKE = f"{_HITS(ev.NON_RESULT)} = 0 AND {_VALUE} AND {_LABEL} AND {_UNIT} AND {_NUMBERS} >= 0.08 AND {_DENSITY(ev.NARRATIVE)} < 0.08 AND {_DENSITY(ev.THRESHOLDS)} < 0.08 AND {_DENSITY(ev.CITATIONS)} < 0.06"


@query(
    f"""WITH l AS (SELECT id, lower({_SPACED('x')}) AS x FROM (SELECT id, unnest([raw_text, raw_analyte_label, raw_reference_range]) AS x FROM observation)),
    s AS (SELECT *, [CASE WHEN {_VALUE} THEN 1 + {_UNIT}::INT + ({_LABEL})::INT ELSE 0 END, {_HITS(ev.THRESHOLDS)}, {_HITS(ev.ADMIN)}, {_HITS(ev.NARRATIVE)}, {_HITS(ev.HEADER_FOOTER)}] AS sc FROM l),
    t AS (SELECT *, list_max(sc) AS top, CASE WHEN list_max(sc) > 0 THEN ({sql_list(ev.ROLES)})[list_position(sc, list_max(sc))] END AS role FROM s)
    SELECT CASE WHEN x = '' THEN 'empty' WHEN top > 0 AND len(list_filter(sc, lambda v: v = top)) > 1 THEN 'excluded:ambiguous_block_classification' WHEN role <> 'result_block' THEN 'excluded:' || role WHEN role IS NULL AND NOT ({_LIKE}) THEN 'excluded:unknown_block_non_result'
      WHEN {_SUPPRESSED} THEN 'excluded:preparse_threshold_note_citation_row' ELSE 'parsed' END AS route, count(*) AS blocks, count(DISTINCT id) AS observations FROM t GROUP BY 1"""
)
def dm32_block_routes(t: Tables) -> DataFrame:
    """What becomes of the printed pieces of observations as blocks of a page, by role and evidence, counted."""
    x = ev.compact(F.col("x"))
    blocks = t.observation.select("id", F.explode(F.array("raw_text", "raw_analyte_label", "raw_reference_range")).alias("x")).select("id", x.alias("x"))
    scored = blocks.withColumn("scores", ev.role_scores(F.col("x")))
    return scored.groupBy(ev.block_route(F.col("x"), F.col("scores"), F.lit(0.0)).alias("route")).agg(F.count("*").alias("blocks"), F.count_distinct("id").alias("observations"))


@query(
    f"""WITH r AS (SELECT *, lower({_SPACED('raw_text')}) AS x, CASE WHEN {_SPACED('raw_text')} = '' THEN 0 ELSE len(string_split({_SPACED('raw_text')}, ' ')) END AS words FROM extracted_row),
    w AS (SELECT id, CASE WHEN {_HITS(ev.SHADOWS)} > 0 AND NOT (coalesce(raw_unit_string, '') <> '' AND coalesce(raw_reference_range, '') <> '') THEN 'threshold_shadow'
      WHEN coalesce(raw_value_string, '') = '' AND parsed_numeric_value IS NULL AND (x = '' OR (words = 1 AND length(x) <= 2) OR {_HITS(ev.CITATIONS)} > 0) THEN 'label_noise' WHEN words > {ev.MOST_TOKENS} THEN 'giant_hybrid_row' END AS reason FROM r)
    SELECT id, reason FROM w"""
)
def flt16_arbitration(t: Tables) -> DataFrame:
    """Why a parsed row is none: the shadow of a threshold, noise, or several rows run together."""
    c = ev.arbitration(F.col("raw_text"), F.col("raw_value_string"), F.col("parsed_numeric_value"), F.col("raw_unit_string"), F.col("raw_reference_range"))
    return t.extracted_row.select("id", c.alias("reason"))


# --- pages --------------------------------------------------------------------------------------------------------
#: The corpus is of newspapers: its own kinds of pages stand in for those of reports.
HEADER_WORDS, ADMIN_WORDS, PRICE_WORDS, SKIPPED = ["gazette", "herald", "journal", "page ", "vol", "edition"], ["printed", "published", "office", "proprietor"], ["price", "per cent", "at from", "cwt"], {"narrative": ["said", "reported", "meeting"], "notice": ["wanted", "for sale", "apply"]}
_LINES = "list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '')"
_COUNT = lambda c, p: f"len(regexp_extract_all({c}, {Q(p)}))"
_ANY = lambda c, words: f"len(list_filter({sql_list(words)}, lambda m: contains({c}, m))) > 0"
DENSITIES_SQL = f"""(SELECT doc_id, low, ls, CASE WHEN {_COUNT('low', ev.WORD)} = 0 THEN 0 ELSE round({_COUNT('low', ev.NUMERIC)} / {_COUNT('low', ev.WORD)}, 4) END AS numeric_density,
    round(len(list_filter(ls, lambda l: ({_COUNT('l', ev.NUMERIC)} >= 2 AND {_COUNT('l', ev.WORD)} >= 4) OR contains(l, '|') OR contains(l, chr(9)))) / greatest(len(ls), 1), 4) AS table_density,
    round(len(list_filter(ls, lambda l: {_ANY('l', PRICE_WORDS)} OR regexp_matches(l, {Q(ev.RANGE)}))) / greatest(len(ls), 1), 4) AS threshold_density FROM (SELECT doc_id, lower(text) AS low, list_transform({_LINES}, lambda l: lower(l)) AS ls FROM documents WHERE text IS NOT NULL))"""


def densities(t: Tables) -> DataFrame:
    """Pages with their lines and the densities of numbers, of lines like a table's, and of lines with a threshold."""
    low = F.lower("text")
    d = t.documents.where("text is not null").select("doc_id", low.alias("low"), F.filter(F.split(low, "\n"), lambda l: F.trim(l) != "").alias("ls"))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    table = F.filter("ls", lambda l: ((count(l, ev.NUMERIC) >= 2) & (count(l, ev.WORD) >= 4)) | F.contains(l, F.lit("|")) | F.contains(l, F.lit("\t")))
    threshold = F.filter("ls", lambda l: ev.holds(l, PRICE_WORDS) | l.rlike(ev.RANGE))
    share = lambda part: F.round(F.size(part) / F.greatest(F.size("ls"), F.lit(1)), 4)
    return d.select("doc_id", "low", "ls", ev.numeric_density(F.col("low")).alias("numeric_density"), share(table).alias("table_density"), share(threshold).alias("threshold_density"))


@query(f"SELECT doc_id, numeric_density, table_density, threshold_density FROM {DENSITIES_SQL}")
def ag22_densities(t: Tables) -> DataFrame:
    return densities(t).select("doc_id", "numeric_density", "table_density", "threshold_density")


_KIND = f"CASE WHEN {_ANY('low', SKIPPED['narrative'])} THEN 'narrative' WHEN {_ANY('low', SKIPPED['notice'])} THEN 'notice' ELSE 'other' END"


@query(f"SELECT doc_id, {_KIND} AS kind, {_KIND} <> 'other' AND numeric_density < 0.08 AND table_density < 0.2 AS skipped FROM {DENSITIES_SQL}")
def flt12_pages_to_skip(t: Tables) -> DataFrame:
    """Pages of the kinds that bear no results are skipped, unless their numbers or tables say otherwise."""
    kind = F.when(ev.holds(F.col("low"), SKIPPED["narrative"]), "narrative").when(ev.holds(F.col("low"), SKIPPED["notice"]), "notice").otherwise("other")
    return densities(t).select("doc_id", kind.alias("kind"), ((kind != "other") & (F.col("numeric_density") < 0.08) & (F.col("table_density") < 0.2)).alias("skipped"))


@query(
    f"""WITH e AS (SELECT doc_id, list_concat(ls[1:2], ls[greatest(len(ls) - 1, 3):len(ls)]) AS edge FROM {DENSITIES_SQL})
    SELECT doc_id, round(len(list_filter(edge, lambda l: {_ANY('l', HEADER_WORDS)})) / greatest(len(edge), 1), 4) AS header_signal, round(len(list_filter(edge, lambda l: {_ANY('l', ADMIN_WORDS)})) / greatest(len(edge), 1), 4) AS admin_signal FROM e"""
)
def ag23_edge_signals(t: Tables) -> DataFrame:
    """The share of the first two and last two blocks of a page that speak of headers, and of administration."""
    n = F.size("ls")
    edge = F.filter(F.transform("ls", lambda l, i: F.struct(l.alias("l"), ((i < 2) | (i >= F.greatest(n - 2, F.lit(0)))).alias("on"))), lambda s: s["on"])
    share = lambda words: F.round(F.size(F.filter("edge", lambda s: ev.holds(s["l"], words))) / F.greatest(F.size("edge"), F.lit(1)), 4)
    return densities(t).select("doc_id", edge.alias("edge")).select("doc_id", share(HEADER_WORDS).alias("header_signal"), share(ADMIN_WORDS).alias("admin_signal"))


@query(
    """SELECT id, round(u / greatest(a, 1), 4) AS upper_ratio, a > 0 AND u / greatest(a, 1) >= 0.6 AS capitals FROM (SELECT id, list_count(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]+$'))) AS u, list_count(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]+$'))) AS a FROM (SELECT id, string_split(raw_text, ' ') AS w FROM extracted_row WHERE raw_text IS NOT NULL))"""
)
def ag31_upper_ratio(t: Tables) -> DataFrame:
    """The share of words in capitals, and whether it is high enough for a line of a report."""
    n = lambda p: F.size(F.filter(F.split("raw_text", " "), lambda x: F.rlike(x, F.lit(p))))
    r = t.extracted_row.where("raw_text is not null").select("id", n("^[A-Z]+$").alias("u"), n("^[A-Za-z]+$").alias("a"))
    ratio = F.col("u") / F.greatest(F.col("a"), F.lit(1))
    return r.select("id", F.round(ratio, 4).alias("upper_ratio"), ((F.col("a") > 0) & (ratio >= 0.6)).alias("capitals"))


# --- totals, ladders, histories -----------------------------------------------------------------------------------
#: What in a mismatch tells of a leak to the patient.
LEAKS = ["dob", "collected", "report printed", "normal", "ifg", "kdigo"]


@query(
    f"""WITH m AS (SELECT job_id, bool_or(len(list_filter({sql_list(LEAKS)}, lambda w: contains(lower(coalesce(raw_text, '')), w))) > 0) AS leak, bool_or(contains(lower(coalesce(raw_text, '')), 'threshold') OR contains(lower(coalesce(raw_text, '')), '<')) AS threshold, count(*) FILTER (len(suppression_reasons) > 0) AS mismatches FROM observation GROUP BY job_id),
    s AS (SELECT input_checksum, bool_or(lane_type = 'trusted_pdf') AS trusted FROM jobs GROUP BY input_checksum),
    r AS (SELECT j.lane_type, j.status <> 'pending' AS executed, coalesce(m.mismatches, 0) = 0 AS passed, coalesce(m.leak, false) AS leak, coalesce(m.threshold, false) AS threshold, j.lane_type = 'image_beta' AND coalesce(s.trusted, false) AS promoted FROM jobs j LEFT JOIN m ON m.job_id = j.id LEFT JOIN s ON s.input_checksum = j.input_checksum)
    SELECT lane_type, count(*) AS total_files, count(*) FILTER (executed) AS executed_files, count(*) FILTER (passed) AS passed_files, round(count(*) FILTER (passed) / greatest(count(*), 1), 4) AS pass_rate, round(count(*) FILTER (executed) / greatest(count(*), 1), 4) AS execution_rate,
      round(count(*) FILTER (leak) / greatest(count(*), 1), 4) AS patient_leak_rate, round(count(*) FILTER (threshold) / greatest(count(*), 1), 4) AS threshold_leak_rate, round(count(*) FILTER (promoted) / greatest(count(*) FILTER (executed), 1), 4) AS trusted_promotion_rate FROM r GROUP BY lane_type"""
)
def ag14_ag16_lane_rates(t: Tables) -> DataFrame:
    """Totals and rates of each lane: a job passes without mismatches (what was suppressed stands in for them), leaks by what its lines say, and is promoted where a trusted lane took the same file."""
    low = F.lower(F.coalesce("raw_text", F.lit("")))
    m = t.observation.groupBy(F.col("job_id").alias("id")).agg(F.bool_or(ev.holds(low, LEAKS)).alias("leak"), F.bool_or(F.contains(low, F.lit("threshold")) | F.contains(low, F.lit("<"))).alias("threshold"), F.count_if(F.size("suppression_reasons") > 0).alias("mismatches"))
    s = t.jobs.groupBy("input_checksum").agg(F.bool_or(F.col("lane_type") == "trusted_pdf").alias("trusted"))
    j = t.jobs.join(m, "id", "left").join(s, "input_checksum", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    executed, passed, promoted = F.col("status") != "pending", F.coalesce("mismatches", F.lit(0)) == 0, (F.col("lane_type") == "image_beta") & no("trusted")
    n, rate = F.greatest(F.count("*"), F.lit(1)), lambda c, of: F.round(F.count_if(c) / of, 4)
    return j.groupBy("lane_type").agg(
        F.count("*").alias("total_files"), F.count_if(executed).alias("executed_files"), F.count_if(passed).alias("passed_files"), rate(passed, n).alias("pass_rate"), rate(executed, n).alias("execution_rate"),
        rate(no("leak"), n).alias("patient_leak_rate"), rate(no("threshold"), n).alias("threshold_leak_rate"), rate(promoted, F.greatest(F.count_if(executed), F.lit(1))).alias("trusted_promotion_rate"),
    )


LADDER = "([<>])=? ?([0-9]+(?:[.][0-9]+)?)"


@query(
    f"""WITH b AS (SELECT id, parsed_numeric_value AS v, regexp_extract_all(raw_reference_range, {Q(LADDER)}, 1) AS d, regexp_extract_all(raw_reference_range, {Q(LADDER)}, 2) AS t FROM observation WHERE parsed_numeric_value IS NOT NULL),
    e AS (SELECT id, v, unnest(d) AS d, unnest(t)::DOUBLE AS t, generate_subscripts(t, 1) AS rank FROM b WHERE len(t) > 0)
    SELECT id, max(rank) FILTER ((d = '>' AND v >= t) OR (d = '<' AND v <= t)) AS rank FROM e GROUP BY id"""
)
def ag07_ladder(t: Tables) -> DataFrame:
    """The highest rung of a printed ladder of thresholds that a value crosses, upwards for '>' and downwards for '<'; null if none."""
    part = lambda i: F.regexp_extract_all("raw_reference_range", F.lit(LADDER), F.lit(i))
    b = t.observation.where("parsed_numeric_value is not null").select("id", F.col("parsed_numeric_value").alias("v"), part(1).alias("d"), part(2).alias("t")).where("size(t) > 0")
    crossed = F.transform("t", lambda x, i: F.when(F.when(F.get("d", i) == ">", F.col("v") >= x.cast("double")).otherwise(F.col("v") <= x.cast("double")), (i + 1).cast("bigint")))
    return b.select("id", F.array_max(crossed).alias("rank"))


@query(
    """WITH h AS (SELECT j.user_id, p.job_id AS id, max(p.received_at) AS recorded_at FROM proof_packs p JOIN jobs j ON j.id = p.job_id WHERE j.user_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recorded_at DESC, id DESC) AS rn FROM h) SELECT user_id, id, rn, rn <= 10 AS in_context FROM r WHERE rn <= 20"""
)
def or07_history(t: Tables) -> DataFrame:
    """The history of each user, newest first: a report sent again takes its old place's stead; twenty are kept, ten go into the context."""
    h = t.proof_packs.select(F.col("job_id").alias("id"), "received_at").join(t.jobs.where("user_id is not null").select("id", "user_id"), "id").groupBy("user_id", "id").agg(F.max("received_at").alias("recorded_at"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("recorded_at"), F.desc("id")))
    return h.withColumn("rn", rn.cast("bigint")).where("rn <= 20").select("user_id", "id", "rn", (F.col("rn") <= 10).alias("in_context"))


@query("SELECT id, list_reduce(list_concat([0::UBIGINT], list_transform(string_split(id, ''), lambda c: ord(c)::UBIGINT)), lambda a, c: (a * 31 + c) % 4294967296)::BIGINT % 3 AS variant FROM jobs")
def sc42_variant(t: Tables) -> DataFrame:
    """A stable variant of three for each id: a hash by 31 in 32 bits."""
    h = F.aggregate(F.split("id", ""), F.lit(0).cast("bigint"), lambda a, c: (a * 31 + F.ascii(c)) % 4294967296)
    return t.jobs.select("id", (h % 3).alias("variant"))


# --- validation and persistence -----------------------------------------------------------------------------------
#: Reasons that may be given, and most entries there may be.
REASONS, HARD_LIMIT = ["low_confidence", "missing_numeric_value", "unresolved_reference_profile"], 1000


@query(
    f"""WITH o AS (SELECT job_id, id, support_state, raw_analyte_label AS label, suppression_reasons[1] AS reason FROM observation WHERE job_id IS NOT NULL),
    j AS (SELECT job_id, count(*) FILTER (support_state = 'supported') AS findings, count(*) FILTER (support_state <> 'supported') AS n, bool_and(support_state = 'supported' OR support_state = 'partial') AS fully FROM o GROUP BY job_id),
    e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) - 1 AS i FROM o WHERE support_state <> 'supported'),
    d AS (SELECT *, row_number() OVER (PARTITION BY job_id, lower(trim(label, ' ')), reason ORDER BY i) AS again FROM e)
    SELECT job_id, 'not_assessed_hard_limit_exceeded:' || n AS violation FROM j WHERE n > {HARD_LIMIT} UNION ALL SELECT job_id, 'not_assessed_runtime_limit_exceeded:' || n || '>' || (findings + 1) FROM j WHERE n > findings + 1
    UNION ALL SELECT job_id, 'fully_supported_with_not_assessed_entries' FROM j WHERE fully AND n > 0 UNION ALL SELECT job_id, 'not_assessed_raw_label_invalid:' || i FROM e WHERE label IS NULL OR trim(label, ' ') = ''
    UNION ALL SELECT job_id, 'not_assessed_reason_invalid:' || i FROM e WHERE reason IS NULL OR reason NOT IN ({', '.join(map(Q, REASONS))}) UNION ALL SELECT job_id, 'not_assessed_duplicate_entry:' || i FROM d WHERE again > 1 AND label IS NOT NULL AND reason IS NOT NULL"""
)
def dm24_dm25_validation(t: Tables) -> DataFrame:
    """What is wrong with what each job reports as not assessed: limits, banner, labels, reasons, repeated entries; a row for each violation."""
    o = t.observation.where("job_id is not null").select("job_id", "id", "support_state", F.col("raw_analyte_label").alias("label"), F.get("suppression_reasons", F.lit(0)).alias("reason"))
    s = F.col("support_state")
    j = o.groupBy("job_id").agg(F.count_if(s == "supported").alias("findings"), F.count_if(s != "supported").alias("n"), F.bool_and((s == "supported") | (s == "partial")).alias("fully"))
    n = F.col("n").cast("string")
    of_job = F.array_compact(F.array(
        F.when(F.col("n") > HARD_LIMIT, F.concat(F.lit("not_assessed_hard_limit_exceeded:"), n)), F.when(F.col("n") > F.col("findings") + 1, F.concat(F.lit("not_assessed_runtime_limit_exceeded:"), n, F.lit(">"), (F.col("findings") + 1).cast("string"))),
        F.when(F.col("fully") & (F.col("n") > 0), "fully_supported_with_not_assessed_entries"),
    ))
    e = o.where(s != "supported").withColumn("i", F.row_number().over(Window.partitionBy("job_id").orderBy("id")) - 1)
    e = e.withColumn("again", F.row_number().over(Window.partitionBy("job_id", F.lower(F.trim("label")), "reason").orderBy("i")))
    at = lambda code: F.concat(F.lit(code + ":"), F.col("i").cast("string"))
    of_entry = F.array_compact(F.array(
        F.when(F.col("label").isNull() | (F.trim("label") == ""), at("not_assessed_raw_label_invalid")), F.when(F.col("reason").isNull() | ~F.col("reason").isin(REASONS), at("not_assessed_reason_invalid")),
        F.when((F.col("again") > 1) & F.col("label").isNotNull() & F.col("reason").isNotNull(), at("not_assessed_duplicate_entry")),
    ))
    return j.select("job_id", F.explode(of_job).alias("violation")).unionByName(e.select("job_id", F.explode(of_entry).alias("violation")))


@query(
    """WITH r AS (SELECT e.id, j.id IS NOT NULL AS ok FROM extracted_row e LEFT JOIN jobs j ON j.id = e.job_id), h AS (SELECT job_id, row_hash, min(id) AS row_id FROM extracted_row GROUP BY 1, 2),
    o AS (SELECT o.id, h.row_id IS NOT NULL AS ok, len(o.candidates) AS n FROM observation o LEFT JOIN h ON h.job_id = o.job_id AND h.row_hash = o.row_hash), p AS (SELECT p.record_id, j.id IS NOT NULL AS ok FROM proof_packs p LEFT JOIN jobs j ON j.id = p.job_id)
    SELECT 'job' AS entity, count(*) AS persisted, 0 AS missing FROM jobs UNION ALL SELECT 'extracted_row', count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM r UNION ALL SELECT 'observation', count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM o
    UNION ALL SELECT 'candidate', coalesce(sum(n) FILTER (ok), 0)::BIGINT, coalesce(sum(n) FILTER (NOT ok), 0)::BIGINT FROM o UNION ALL SELECT 'pack', count(*) FILTER (ok), count(*) FILTER (NOT ok) FROM p"""
)
def snk03_five_entities(t: Tables) -> DataFrame:
    """The five entities with their references resolved, observations through the hash of their row within the job: how many are persisted and how many lack what they refer to. None is dropped unseen."""
    jobs = t.jobs.select(F.col("id").alias("job_id"), F.lit(True).alias("there"))
    rows = t.extracted_row.select("job_id", "row_hash")
    known = rows.where("job_id is not null and row_hash is not null").distinct().withColumn("there", F.lit(True))
    ok = F.coalesce("there", F.lit(False))
    count = lambda name, df, n: df.agg(F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).cast("bigint").alias("persisted"), F.coalesce(F.sum(F.when(~ok, n)), F.lit(0)).cast("bigint").alias("missing")).select(F.lit(name).alias("entity"), "persisted", "missing")
    o = t.observation.select("job_id", "row_hash", F.greatest(F.size("candidates"), F.lit(0)).alias("n")).join(known, ["job_id", "row_hash"], "left")
    one = F.lit(1)
    parts = [count("job", jobs, one), count("extracted_row", rows.join(jobs, "job_id", "left"), one), count("observation", o, one), count("candidate", o, F.col("n")), count("pack", t.proof_packs.select("job_id").join(jobs, "job_id", "left"), one)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
