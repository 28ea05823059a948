"""Aggregations, windows, sorts, set operations and mutations over the lab tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from labloom.functions import lab
from labloom.operators import relational as rel
from labloom.plans import packs_sql
from labloom.plans.catalog import Tables, query
from labloom.plans.relational_queries import COUNTERS, PAGE_WORDS, QA_SQL, panels, qa_verdicts, sql_list
from labloom.plans.scalar_queries import sql_label_key

BY_JOB = ["job_id"]
PANEL_SQL = """(SELECT o.*, coalesce(c.panel_key, l.panel_key, 'unclassified') AS panel FROM observation o LEFT JOIN launch_scope_rules c ON c.candidate_code = o.accepted_analyte_code
    LEFT JOIN (SELECT canonical_label AS k, min(panel_key) AS panel_key FROM launch_scope_rules GROUP BY 1) l ON l.k = lower(trim(o.raw_analyte_label, ' ')))"""
STATE_CASE = "CASE WHEN bool_and(support_state = 'supported') THEN 'supported' WHEN bool_or(support_state = 'supported') THEN 'partial' ELSE 'unsupported' END"


def support_of(column: str = "support_state"):
    """All supported, some, or none."""
    ok = F.col(column) == "supported"
    return F.when(F.bool_and(ok), "supported").when(F.bool_or(ok), "partial").otherwise("unsupported")


@query(
    """WITH l AS (SELECT job_id, split_part(replace(lower(trim(coalesce(language_id, 'en'), ' ')), '_', '-'), '-', 1) AS lang, created_at FROM extracted_row),
    c AS (SELECT job_id, lang, count(*) AS n, min(created_at) AS f FROM l GROUP BY job_id, lang)
    SELECT job_id, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, f, lang) AS rn FROM c) WHERE rn = 1"""
)
def ag01_prj01_language_mode(t: Tables) -> DataFrame:
    """The most frequent language of each job, the one seen first of equal ones."""
    rows = t.extracted_row.select("job_id", lab.language(F.col("language_id")).alias("language"), "created_at")
    return rel.mode_first_seen(rows, BY_JOB, "language", "created_at")


@query(f"SELECT job_id, panel, list(id ORDER BY id) AS ids, count(*) AS n, {STATE_CASE} AS state FROM {PANEL_SQL} GROUP BY job_id, panel")
def ag02_panels(t: Tables) -> DataFrame:
    return panels(t).groupBy("job_id", "panel").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"), support_of().alias("state"))


@query(
    """SELECT j.id, CASE WHEN count(o.id) = 0 THEN 'could_not_assess' WHEN bool_and(o.support_state = 'supported') THEN 'fully_supported' WHEN bool_or(o.support_state = 'supported') THEN 'partially_supported' ELSE 'could_not_assess' END AS banner,
    count(DISTINCT o.support_state) AS states FROM jobs j LEFT JOIN observation o ON o.job_id = j.id GROUP BY j.id"""
)
def ag03_support_banner(t: Tables) -> DataFrame:
    """One banner for each job, also for jobs without observations."""
    ok = F.col("support_state") == "supported"
    per = t.observation.groupBy(F.col("job_id").alias("id")).agg(F.when(F.bool_and(ok), "fully_supported").when(F.bool_or(ok), "partially_supported").otherwise("could_not_assess").alias("b"), F.count_distinct("support_state").alias("s"))
    return t.jobs.select("id").join(per, "id", "left").select("id", F.coalesce("b", F.lit("could_not_assess")).alias("banner"), F.coalesce("s", F.lit(0)).alias("states"))


RANKS = {"supported": 0, "partial": 1, "unsupported": 2}


@query(
    """WITH r AS (SELECT job_id, support_state, MAP {'supported': 0, 'partial': 1, 'unsupported': 2}[support_state] AS rk FROM observation)
    SELECT job_id, arg_max(support_state, rk) AS worst, array_to_string(list_transform(list_reverse_sort(list(DISTINCT struct_pack(rk := rk, s := support_state))), lambda x: x.s), ',') AS states FROM r GROUP BY job_id"""
)
def ag05_ag06_worst_state(t: Tables) -> DataFrame:
    """The worst state of each job and all of its states, worst first."""
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("support_state")]
    r = t.observation.select("job_id", "support_state", rank.alias("rk"))
    states = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("rk", "support_state")), False), lambda x: x["support_state"]), ",")
    return r.groupBy("job_id").agg(F.max_by("support_state", "rk").alias("worst"), states.alias("states"))


@query(f"SELECT source_feed, verdict, count(*) AS n FROM ({QA_SQL}) GROUP BY source_feed, verdict")
def ag08_verdict_counts(t: Tables) -> DataFrame:
    return qa_verdicts(t.extracted_row).groupBy("source_feed", "verdict").agg(F.count("*").alias("n"))


@query(
    f"""SELECT source_feed, round(count(*) FILTER (verdict = 'clean') / greatest(count(*), 1), 4) AS pass_rate,
    round(count(*) FILTER (verdict = 'clean' AND trim(coalesce(raw_unit_string, ''), ' ') <> '') / greatest(count(*) FILTER (verdict = 'clean'), 1), 4) AS unit_ratio,
    round(count(*) FILTER (verdict = 'clean' AND trim(coalesce(raw_reference_range, ''), ' ') <> '') / greatest(count(*) FILTER (verdict = 'clean'), 1), 4) AS reference_ratio FROM ({QA_SQL}) GROUP BY source_feed"""
)
def ag09_ag14_linkage_ratios(t: Tables) -> DataFrame:
    clean = F.col("verdict") == "clean"
    present = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    n = F.greatest(F.count_if(clean), F.lit(1))
    return (
        qa_verdicts(t.extracted_row)
        .groupBy("source_feed")
        .agg(F.round(F.count_if(clean) / F.greatest(F.count("*"), F.lit(1)), 4).alias("pass_rate"), F.round(F.count_if(clean & present("raw_unit_string")) / n, 4).alias("unit_ratio"), F.round(F.count_if(clean & present("raw_reference_range")) / n, 4).alias("reference_ratio"))
    )


@query("SELECT job_id, count(*) AS runs, max(received_at) AS latest FROM proof_packs GROUP BY job_id")
def ag10_runs_per_job(t: Tables) -> DataFrame:
    return t.proof_packs.groupBy("job_id").agg(F.count("*").alias("runs"), F.max("received_at").alias("latest"))


@query("SELECT CASE WHEN dead_letter THEN 'errors' WHEN status = 'completed' THEN 'completed' WHEN status = 'partial' THEN 'partial' WHEN status = 'failed' THEN 'blocked' ELSE 'other' END AS outcome, count(*) AS n FROM jobs GROUP BY 1")
def ag11_ag15_exclusive_totals(t: Tables) -> DataFrame:
    """Every job counted under the first outcome that fits."""
    s = F.col("status")
    outcome = F.when(F.col("dead_letter"), "errors").when(s == "completed", "completed").when(s == "partial", "partial").when(s == "failed", "blocked").otherwise("other")
    return t.jobs.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT lane_type, source_feed, grouping(lane_type)::INT * 2 + grouping(source_feed)::INT AS level, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (dead_letter) AS errors FROM jobs GROUP BY GROUPING SETS ((lane_type), (source_feed), ())")
def ag12_ag13_grouping_sets(t: Tables) -> DataFrame:
    """Totals by lane, by feed and over all in one pass."""
    lane, feed = F.col("lane_type"), F.col("source_feed")
    sets = t.jobs.groupingSets([[lane], [feed], []], lane, feed)
    level = (F.grouping("lane_type") * 2 + F.grouping("source_feed")).cast("int")
    return sets.agg(level.alias("level"), F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if("dead_letter").alias("errors")).select("lane_type", "source_feed", "level", "total", "completed", "errors")


@query(
    """WITH e AS (SELECT panel_key, count(*) AS expected FROM launch_scope_rules GROUP BY panel_key), f AS (SELECT job_id, bool_and(support_state = 'supported') AS fully FROM observation GROUP BY job_id), s AS (SELECT o.job_id, r.panel_key, count(DISTINCT o.accepted_analyte_code) AS seen FROM observation o JOIN launch_scope_rules r ON r.candidate_code = o.accepted_analyte_code GROUP BY 1, 2)
    SELECT s.job_id, s.panel_key, round(seen / expected, 4) AS coverage, seen / expected >= CASE WHEN expected = 1 THEN 1.0 WHEN expected <= 5 THEN 0.7 ELSE 0.5 END AS enough, CASE WHEN expected <= 1 THEN 1 ELSE greatest(1, ceil(expected * CASE WHEN fully THEN 0.7 ELSE 0.5 END)) END::BIGINT AS floor FROM s JOIN e USING (panel_key) JOIN f ON f.job_id IS NOT DISTINCT FROM s.job_id"""
)
def ag17_ag18_panel_coverage(t: Tables) -> DataFrame:
    """How much of a panel a job covers, against a share that depends on the panel's size, and the least number expected: 0.7 of it where all of the job is supported, else half."""
    e = t.launch_scope_rules.groupBy("panel_key").agg(F.count("*").alias("expected"))
    r = t.launch_scope_rules.select(F.col("candidate_code").alias("accepted_analyte_code"), "panel_key")
    fully = t.observation.groupBy(F.col("job_id").alias("_job")).agg(F.bool_and(F.col("support_state") == "supported").alias("fully"))
    s = t.observation.join(r, "accepted_analyte_code").groupBy("job_id", "panel_key").agg(F.count_distinct("accepted_analyte_code").alias("seen")).join(e, "panel_key")
    ratio = F.col("seen") / F.col("expected")
    need = F.when(F.col("expected") == 1, 1.0).when(F.col("expected") <= 5, 0.7).otherwise(0.5)
    floor = F.when(F.col("expected") <= 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("expected") * F.when(F.col("fully"), 0.7).otherwise(0.5))))
    s = s.join(fully, F.col("job_id").eqNullSafe(F.col("_job")))
    return s.select("job_id", "panel_key", F.round(ratio, 4).alias("coverage"), (ratio >= need).alias("enough"), floor.cast("bigint").alias("floor"))


HITS_SQL = ", ".join(f"list_count(list_filter({sql_list(w)}, lambda w: contains(lower(text), w)))::INT AS {k}" for k, w in PAGE_WORDS.items())
KINDS = list(PAGE_WORDS)


@query(
    f"""WITH s AS (SELECT doc_id, {HITS_SQL} FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, [{', '.join(KINDS)}] AS v, {' + '.join(KINDS)} AS total FROM s),
    m AS (SELECT doc_id, v, total, list_max(v) AS top, list_reverse_sort(v)[2] AS second FROM l)
    SELECT doc_id, top AS top_score, top - second AS margin, CASE WHEN top = 0 THEN 0.0 ELSE round(top / total, 3) END AS confidence,
      CASE WHEN top = 0 OR (top = second AND top / total < 0.3) THEN 'unknown' ELSE ({sql_list(KINDS)})[list_position(v, top)] END AS kind FROM m"""
)
def ag20_ag21_page_kind(t: Tables) -> DataFrame:
    """Keyword scores of each page, the best kind with its margin; unknown without hits or between equals."""
    low = F.lower("text")
    hits = F.array(*[F.aggregate(F.array(*map(F.lit, w)), F.lit(0), lambda n, x: n + F.contains(low, x).cast("int")) for w in PAGE_WORDS.values()])
    s = t.documents.where("text is not null").select("doc_id", hits.alias("v")).withColumn("top", F.array_max("v")).withColumn("second", F.get(F.sort_array("v", False), F.lit(1))).withColumn("total", F.aggregate("v", F.lit(0), lambda a, b: a + b))
    unknown = (F.col("top") == 0) | ((F.col("top") == F.col("second")) & (F.col("top") / F.col("total") < 0.3))
    kind = F.when(unknown, "unknown").otherwise(F.get(F.array(*map(F.lit, KINDS)), (F.array_position("v", F.col("top")) - 1).cast("int")))
    return s.select("doc_id", F.col("top").alias("top_score"), (F.col("top") - F.col("second")).alias("margin"), F.when(F.col("top") == 0, 0.0).otherwise(F.round(F.col("top") / F.col("total"), 3)).alias("confidence"), kind.alias("kind"))


BOX_SQL = "(SELECT doc_id, n_columns, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.conf AS conf, pos, total FROM (SELECT doc_id, n_columns, unnest(lines) AS b, generate_subscripts(lines, 1) - 1 AS pos, len(lines) AS total FROM documents))"


def boxes(t: Tables) -> DataFrame:
    """One row for each printed line's box, with its place on the page."""
    return t.documents.select("doc_id", "n_columns", F.size("lines").alias("total"), F.posexplode("lines").alias("pos", "b")).select("doc_id", "n_columns", "pos", "total", "b.*")


@query(
    f"""WITH p AS (SELECT *, (pos + 0.5) / total AS spot FROM {BOX_SQL})
    SELECT doc_id, CASE WHEN spot <= 0.18 THEN 'header' WHEN spot >= 0.82 THEN 'footer' ELSE 'body' END AS band, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(avg(conf), 4) AS conf FROM p GROUP BY 1, 2"""
)
def ag24_wn12_bands(t: Tables) -> DataFrame:
    """Bands of a page by relative position, with the box around their lines."""
    at = (F.col("pos") + 0.5) / F.col("total")
    band = F.when(at <= 0.18, "header").when(at >= 0.82, "footer").otherwise("body")
    return boxes(t).groupBy("doc_id", band.alias("band")).agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.avg("conf"), 4).alias("conf"))


@query("SELECT reason, count(*) AS n FROM (SELECT DISTINCT job_id, raw_analyte_label, unnest(suppression_reasons) AS reason FROM observation) GROUP BY reason")
def ag25_set04_not_assessed(t: Tables) -> DataFrame:
    """Distinct (job, label, reason) items, counted by reason."""
    items = t.observation.select("job_id", "raw_analyte_label", F.explode("suppression_reasons").alias("reason")).distinct()
    return items.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT c.name, count(j.id) AS n FROM (SELECT unnest({sql_list(COUNTERS)}) AS name) c LEFT JOIN jobs j ON j.status = c.name GROUP BY c.name")
def ag26_known_counters(t: Tables) -> DataFrame:
    """A count for each counter known, also where nothing happened."""
    known = t.spark.createDataFrame([(c,) for c in COUNTERS], "name string")
    per = t.jobs.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("k"))
    return known.join(per, "name", "left").select("name", F.coalesce("k", F.lit(0)).alias("n"))


@query("SELECT 'extracted_row' AS entity, count(*) AS n FROM extracted_row UNION ALL SELECT 'observation', count(*) FROM observation UNION ALL SELECT 'candidate', sum(len(candidates))::BIGINT FROM observation UNION ALL SELECT 'job', count(*) FROM jobs")
def ag27_entity_counts(t: Tables) -> DataFrame:
    of = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("entity"), F.col("n").cast("bigint").alias("n"))
    one = F.count("*")
    return of("extracted_row", t.extracted_row, one).unionByName(of("observation", t.observation, one)).unionByName(of("candidate", t.observation, F.sum(F.size("candidates")))).unionByName(of("job", t.jobs, one))


@query(packs_sql.TIMINGS)
def ag28_ag29_timing_metrics(t: Tables) -> DataFrame:
    """Metrics of all packs by name, timings told from the rest by their suffix."""
    from labloom.operators.nested import pack_tables

    m = pack_tables(t.proof_packs)["metrics"]
    return m.groupBy("name", F.col("name").endswith("_ms").alias("timing")).agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("greatest"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, count(*) AS boxes, round(count(*) FILTER (len(string_split(x, ' ')) <= 3) / count(*), 4) AS short_ratio, count(*) >= 16 AND count(*) FILTER (len(string_split(x, ' ')) <= 3) / count(*) >= 0.45 AND count(*) FILTER (len(string_split(x, ' ')) <= 2 AND regexp_matches(x, '[0-9]')) >= 6 AS fragmented FROM l GROUP BY doc_id"""
)
def ag32_fragmentation(t: Tables) -> DataFrame:
    ls = F.split("text", "\n")
    words = lambda x: F.size(F.split(x, " "))
    few = F.size(F.filter(ls, lambda x: words(x) <= 3))
    values = F.size(F.filter(ls, lambda x: (words(x) <= 2) & F.rlike(x, F.lit("[0-9]"))))
    n = F.size(ls)
    return t.documents.where("text is not null").select("doc_id", n.cast("bigint").alias("boxes"), F.round(few / n, 4).alias("short_ratio"), ((n >= 16) & (few / n >= 0.45) & (values >= 6)).alias("fragmented"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ag33_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count_distinct("l_suppkey").alias("suppliers"))


# --- windows ------------------------------------------------------------------------------------------------------
@query("SELECT record_id, job_id, received_at FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY received_at DESC, record_id DESC) AS rn FROM proof_packs) WHERE rn = 1")
def wn01_latest_per_job(t: Tables) -> DataFrame:
    return rel.latest_per_key(t.proof_packs.select("record_id", "job_id", "received_at"), BY_JOB, "received_at", "record_id")


@query(
    """WITH u AS (SELECT id, document_id, source_page, raw_analyte_label, raw_value_string, 0 AS src, created_at FROM extracted_row WHERE row_bbox IS NOT NULL UNION ALL SELECT id, document_id, source_page, raw_analyte_label, raw_value_string, 1, created_at FROM extracted_row WHERE row_bbox IS NULL),
    k AS (SELECT *, lower(trim(raw_analyte_label, ' ')) AS l, lower(trim(coalesce(raw_value_string, ''), ' ')) AS v FROM u WHERE coalesce(raw_analyte_label, '') <> ''),
    d AS (SELECT *, row_number() OVER (PARTITION BY document_id, l, source_page, v ORDER BY src, created_at, id) AS rn FROM k)
    SELECT document_id, id, 'row-' || (row_number() OVER (PARTITION BY document_id ORDER BY src, created_at, id) - 1) AS row_hash FROM d WHERE rn = 1 OR l = ''"""
)
def wn02_wn03_set01_merge_sources(t: Tables) -> DataFrame:
    """Two sources of rows united, the first of each (label, page, value) kept, blank labels kept as they are, ids given anew."""
    base = t.extracted_row.select("id", "document_id", "source_page", "raw_analyte_label", "raw_value_string", "row_bbox", "created_at")
    u = base.where("row_bbox is not null").withColumn("src", F.lit(0)).unionByName(base.where("row_bbox is null").withColumn("src", F.lit(1))).where("coalesce(raw_analyte_label, '') <> ''")
    u = u.withColumn("l", F.lower(F.trim("raw_analyte_label"))).withColumn("v", F.lower(F.trim(F.coalesce("raw_value_string", F.lit("")))))
    w = Window.partitionBy("document_id", "l", "source_page", "v").orderBy("src", "created_at", "id")
    kept = u.withColumn("rn", F.row_number().over(w)).where("rn = 1 or l = ''")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("src", "created_at", "id")) - 1
    return kept.select("document_id", "id", F.concat(F.lit("row-"), place.cast("string")).alias("row_hash"))


@query("SELECT panel_key, candidate_code FROM (SELECT *, row_number() OVER (PARTITION BY panel_key ORDER BY ordinal, candidate_code) AS rn FROM launch_scope_rules) WHERE rn = 1")
def wn05_or05_first_rule(t: Tables) -> DataFrame:
    return t.launch_scope_rules.groupBy("panel_key").agg(F.min_by("candidate_code", F.struct("ordinal", "candidate_code")).alias("candidate_code"))


@query("SELECT job_id, arg_min(id, (created_at, id)) AS observation_id, arg_min(coalesce(canonical_value, parsed_numeric_value), (created_at, id)) AS value FROM observation WHERE support_state = 'supported' AND coalesce(canonical_value, parsed_numeric_value) IS NOT NULL GROUP BY job_id")
def wn06_first_qualifying(t: Tables) -> DataFrame:
    """The first supported observation with a number of each job."""
    value = F.coalesce("canonical_value", "parsed_numeric_value")
    first = F.struct("created_at", "id")
    return t.observation.where((F.col("support_state") == "supported") & value.isNotNull()).groupBy("job_id").agg(F.min_by("id", first).alias("observation_id"), F.min_by(value, first).alias("value"))


@query("SELECT id, document_id, row_hash FROM (SELECT *, row_number() OVER (PARTITION BY document_id, source_page, row_hash ORDER BY created_at, id) AS rn FROM extracted_row) WHERE rn = 1")
def wn07_first_of_hash(t: Tables) -> DataFrame:
    r = t.extracted_row.select("id", "document_id", "source_page", "row_hash", "created_at")
    return rel.top_per_key(r, ["document_id", "source_page", "row_hash"], [F.col("created_at"), F.col("id")]).select("id", "document_id", "row_hash")


@query(
    """WITH p AS (SELECT doc_id, source, issue_date, page_no, coalesce(n_columns, 0) AS kind FROM documents),
    c AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN kind IS DISTINCT FROM lag(kind) OVER w THEN 1 ELSE 0 END AS s FROM p WINDOW w AS (PARTITION BY source ORDER BY issue_date, page_no, doc_id)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY issue_date, page_no, doc_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
    SELECT source, island::BIGINT AS island, kind, count(*) AS pages, substr(sha256(source || ':' || kind || ':' || string_agg(doc_id::VARCHAR, ',' ORDER BY issue_date, page_no, doc_id)), 1, 16) AS group_id FROM g GROUP BY source, island, kind"""
)
def wn08_page_groups(t: Tables) -> DataFrame:
    """Runs of pages of one kind within a paper, each with an id made of its pages. A paper is numbered month by month."""
    p = t.documents.select("doc_id", "source", "issue_date", "page_no", F.coalesce("n_columns", F.lit(0)).alias("kind")).where("source is not null")
    g = rel.islands(p, ["source"], ["issue_date", "page_no", "doc_id"], ["kind"], block=F.date_trunc("month", "issue_date"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("issue_date", "page_no", "doc_id"))), lambda s: s["doc_id"].cast("string")), ",")
    g = g.groupBy("source", "island", "kind").agg(F.count("*").alias("pages"), ids.alias("ids"))
    return g.select("source", F.col("island").cast("bigint").alias("island"), "kind", "pages", F.substring(F.sha2(F.concat_ws(":", "source", F.col("kind").cast("string"), "ids"), 256), 1, 16).alias("group_id"))


@query(
    f"""WITH e AS (SELECT doc_id, pos, lead(pos) OVER w AS next_pos, lead(y0) OVER w - y1 AS gap FROM {BOX_SQL} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, pos, next_pos, CASE WHEN gap BETWEEN 0 AND 18 THEN 'adjacent_vertical_block' ELSE 'next_in_reading_order' END AS kind FROM e WHERE next_pos IS NOT NULL"""
)
def wn09_page_edges(t: Tables) -> DataFrame:
    """Edges between lines that follow each other, those close beneath told apart."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    e = boxes(t).select("doc_id", "pos", F.lead("pos").over(w).alias("next_pos"), (F.lead("y0").over(w) - F.col("y1")).alias("gap")).where("next_pos is not null")
    return e.select(F.col("doc_id"), F.col("pos").cast("bigint").alias("pos"), F.col("next_pos").cast("bigint").alias("next_pos"), F.when(F.col("gap").between(0, 18), "adjacent_vertical_block").otherwise("next_in_reading_order").alias("kind"))


@query(
    f"""WITH s AS (SELECT id, document_id, source_page, {sql_label_key('raw_analyte_label')} AS k, (CASE WHEN coalesce(raw_value_string, '') <> '' THEN 10 ELSE 0 END + CASE WHEN coalesce(raw_unit_string, '') <> '' THEN 4 ELSE 0 END + CASE WHEN coalesce(raw_reference_range, '') <> '' THEN 2 ELSE 0 END) AS score, parsed_numeric_value IS NOT NULL AS num, length(coalesce(raw_text, '')) AS len FROM extracted_row),
    r AS (SELECT *, row_number() OVER w AS rn, first_value(id) OVER w AS winner FROM s WINDOW w AS (PARTITION BY document_id, source_page, k ORDER BY score DESC, num DESC, len DESC, id))
    SELECT id, CASE WHEN rn = 1 THEN 'kept' ELSE 'overlap_shadow_row' END AS outcome, winner FROM r"""
)
def wn10_overlap_arbitration(t: Tables) -> DataFrame:
    """Of rows with one label on a page the best wins, the others say which."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    score = F.when(has("raw_value_string"), 10).otherwise(0) + F.when(has("raw_unit_string"), 4).otherwise(0) + F.when(has("raw_reference_range"), 2).otherwise(0)
    s = t.extracted_row.select("id", "document_id", "source_page", lab.label_key(F.col("raw_analyte_label")).alias("k"), score.alias("score"), F.col("parsed_numeric_value").isNotNull().alias("num"), F.length(F.coalesce("raw_text", F.lit(""))).alias("len"))
    w = Window.partitionBy("document_id", "source_page", "k").orderBy(F.col("score").desc(), F.col("num").desc(), F.col("len").desc(), "id")
    return s.select("id", F.when(F.row_number().over(w) == 1, "kept").otherwise("overlap_shadow_row").alias("outcome"), F.first("id").over(w).alias("winner"))


@query(
    f"""WITH o AS (SELECT id, document_id, source_page, created_at, {sql_label_key('raw_analyte_label')} AS k FROM extracted_row),
    c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR k IS DISTINCT FROM lag(k) OVER w THEN 1 ELSE 0 END AS s FROM o WINDOW w AS (PARTITION BY document_id, source_page ORDER BY created_at, id)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY document_id, source_page ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS island FROM c),
    n AS (SELECT *, (row_number() OVER (PARTITION BY document_id, source_page, island ORDER BY created_at, id) - 1) // 2 AS pair FROM g)
    SELECT document_id, source_page, island::BIGINT AS island, pair::BIGINT AS pair, count(*) AS rows_merged, min(id) AS first_id FROM n GROUP BY 1, 2, 3, 4"""
)
def wn11_pairwise_merge(t: Tables) -> DataFrame:
    """Runs of equal labels merged two at a time."""
    o = t.extracted_row.select("id", "document_id", "source_page", "created_at", lab.label_key(F.col("raw_analyte_label")).alias("k"))
    g = rel.islands(o, ["document_id", "source_page"], ["created_at", "id"], ["k"]).withColumn("island", F.col("island") + 1)
    pair = F.floor((F.row_number().over(Window.partitionBy("document_id", "source_page", "island").orderBy("created_at", "id")) - 1) / 2)
    return g.withColumn("pair", pair).groupBy("document_id", "source_page", F.col("island").cast("bigint").alias("island"), F.col("pair").cast("bigint").alias("pair")).agg(F.count("*").alias("rows_merged"), F.min("id").alias("first_id"))


@query("SELECT event_id, user_id, row_number() OVER w AS rn, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def wn14_frames(t: Tables) -> DataFrame:
    """Ranking and framed windows over the event log."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", "user_id", F.row_number().over(w).cast("bigint").alias("rn"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("rank"))


# --- sorts and top-k ----------------------------------------------------------------------------------------------
@query("SELECT id, status, updated_at FROM jobs ORDER BY updated_at DESC, created_at DESC, id DESC LIMIT 20")
def or01_recent_jobs(t: Tables) -> DataFrame:
    """The twenty latest jobs (the limit is the feature; it may be 1 to 100)."""
    return t.jobs.orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("id")).limit(20).select("id", "status", "updated_at")


@query("SELECT input_checksum, arg_max(id, (created_at, id)) AS id FROM jobs GROUP BY input_checksum")
def or02_latest_by_checksum(t: Tables) -> DataFrame:
    return t.jobs.groupBy("input_checksum").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("SELECT user_id, list(event_id ORDER BY ts DESC, event_id DESC) AS event_ids FROM events WHERE event_type = 'click' GROUP BY user_id")
def or03_events_newest_first(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id")), False).alias("e"))
    return e.select("user_id", F.transform("e", lambda s: s["event_id"]).alias("event_ids"))


@query("SELECT doc_id, list_transform(list_sort(list_transform(lines, lambda b, i: struct_pack(y := b.y0, x := b.x0, i := i))), lambda s: (s.i - 1)::INT) AS reading FROM documents WHERE lines IS NOT NULL")
def or06_layout_order(t: Tables) -> DataFrame:
    """The order of a page's lines from top to bottom, then from the left."""
    s = F.transform("lines", lambda b, i: F.struct(b["y0"].alias("y"), b["x0"].alias("x"), i.alias("i")))
    return t.documents.where("lines is not null").select("doc_id", F.transform(F.array_sort(s), lambda b: b["i"].cast("int")).alias("reading"))


@query("SELECT lane_type, id FROM (SELECT lane_type, id, row_number() OVER (PARTITION BY lane_type ORDER BY id) AS rn FROM jobs WHERE status = 'completed') WHERE rn <= 5")
def or08_select_per_tier(t: Tables) -> DataFrame:
    return rel.top_per_key(t.jobs.where("status = 'completed'").select("lane_type", "id"), ["lane_type"], [F.col("id")], 5)


@query("SELECT job_id, count(*) AS items, count(*) > 1000 AS over_cap FROM observation WHERE support_state <> 'supported' GROUP BY job_id")
def or09_cap_check(t: Tables) -> DataFrame:
    """Items not assessed per job, and whether they exceed the contract's thousand."""
    return t.observation.where("support_state <> 'supported'").groupBy("job_id").agg(F.count("*").alias("items"), (F.count("*") > 1000).alias("over_cap"))


# --- sets ---------------------------------------------------------------------------------------------------------
@query(
    """WITH a AS (SELECT job_id, raw_analyte_label AS label FROM extracted_row), b AS (SELECT job_id, raw_analyte_label AS label FROM observation)
    SELECT job_id, label, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT job_id, label, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""
)
def set03_parity(t: Tables) -> DataFrame:
    """Labels of rows and of observations that have no counterpart, counted."""
    of = lambda df: df.select("job_id", F.col("raw_analyte_label").alias("label"))
    return rel.symmetric_difference(of(t.extracted_row), of(t.observation))


@query("SELECT DISTINCT job_id, raw_analyte_label AS label, reason FROM (SELECT job_id, raw_analyte_label, unnest(suppression_reasons) AS reason FROM observation UNION ALL SELECT job_id, raw_analyte_label, 'no_value' FROM observation WHERE raw_value_string IS NULL)")
def set06_items_from_two_sources(t: Tables) -> DataFrame:
    a = t.observation.select("job_id", "raw_analyte_label", F.explode("suppression_reasons").alias("reason"))
    b = t.observation.where("raw_value_string is null").select("job_id", "raw_analyte_label", F.lit("no_value").alias("reason"))
    return a.unionByName(b).distinct().withColumnRenamed("raw_analyte_label", "label")


@query("SELECT row_hash, count(*) AS deliveries, min(created_at) AS first_at FROM extracted_row GROUP BY row_hash HAVING count(*) > 1")
def set07_duplicates(t: Tables) -> DataFrame:
    """Rows delivered more than once."""
    return t.extracted_row.groupBy("row_hash").agg(F.count("*").alias("deliveries"), F.min("created_at").alias("first_at")).where("deliveries > 1")


@query("SELECT accepted_analyte_code AS code FROM observation WHERE accepted_analyte_code IS NOT NULL INTERSECT SELECT candidate_code FROM launch_scope_rules")
def set08_intersect(t: Tables) -> DataFrame:
    return t.observation.where("accepted_analyte_code is not null").select(F.col("accepted_analyte_code").alias("code")).intersect(t.launch_scope_rules.select(F.col("candidate_code").alias("code")))


# --- mutations ----------------------------------------------------------------------------------------------------
@query(
    """WITH j AS (SELECT id, CASE WHEN retry_count > 1 THEN NULL ELSE input_checksum END AS input_checksum, created_at FROM jobs), e AS (SELECT * FROM j WHERE created_at < TIMESTAMP '2025-10-01'), i AS (SELECT * FROM j WHERE created_at >= TIMESTAMP '2025-10-01')
    SELECT id, input_checksum FROM (SELECT *, row_number() OVER (PARTITION BY input_checksum ORDER BY created_at, id) AS rn FROM i WHERE input_checksum IS NOT NULL) WHERE rn = 1 AND input_checksum NOT IN (SELECT input_checksum FROM e WHERE input_checksum IS NOT NULL)
    UNION ALL SELECT id, NULL FROM i WHERE input_checksum IS NULL"""
)
def mu01_st03_insert_if_absent(t: Tables) -> DataFrame:
    """Later jobs whose checksum hasn't come before, once each; jobs retried more than once stand in for those without one, which always go in."""
    cols = t.jobs.select("id", F.when(~(F.col("retry_count") > 1), F.col("input_checksum")).alias("input_checksum"), "created_at")
    new = rel.insert_if_absent(cols.where("created_at < timestamp '2025-10-01'"), cols.where("created_at >= timestamp '2025-10-01'"), "input_checksum", [F.col("created_at"), F.col("id")])
    return new.select("id", "input_checksum")


@query("SELECT id, CASE WHEN retry_count < 2 AND NOT dead_letter THEN retry_count + 1 END AS new_count, retry_count >= 2 OR dead_letter AS refused FROM jobs")
def mu02_conditional_increment(t: Tables) -> DataFrame:
    """The counter after one more try, none where the bound is reached."""
    open_ = (F.col("retry_count") < 2) & ~F.col("dead_letter")
    return t.jobs.select("id", F.when(open_, F.col("retry_count") + 1).alias("new_count"), (~open_).alias("refused"))


@query(
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value, max(ts) AS ts FROM (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type IN ('click', 'purchase') THEN value END AS value FROM events) GROUP BY user_id"""
)
def mu03_st02_last_known_state(t: Tables) -> DataFrame:
    """Partial updates folded into the present state of each user."""
    e = t.events.select("user_id", "event_id", "ts", "event_type", F.when(F.col("event_type").isin("click", "purchase"), F.col("value")).alias("value"))
    return rel.last_known(e, "user_id", "ts", "event_id", ["event_type", "value", "ts"])


@query(
    """SELECT j.id, j.status, coalesce(p.runs, 0) AS runs, p.latest_record, coalesce(o.n, 0) AS observations, o.last_at FROM jobs j
    LEFT JOIN (SELECT job_id, count(*) AS runs, arg_max(record_id, (received_at, record_id)) AS latest_record FROM proof_packs GROUP BY job_id) p ON p.job_id = j.id
    LEFT JOIN (SELECT job_id, count(*) AS n, max(created_at) AS last_at FROM observation GROUP BY job_id) o ON o.job_id = j.id"""
)
def mu08_audit_rollup(t: Tables) -> DataFrame:
    """Everything about a job in one row: its runs, the latest of them, its observations."""
    p = t.proof_packs.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("runs"), F.max_by("record_id", F.struct("received_at", "record_id")).alias("latest_record"))
    o = t.observation.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    return t.jobs.select("id", "status").join(p, "id", "left").join(o, "id", "left").select("id", "status", F.coalesce("runs", F.lit(0)).alias("runs"), "latest_record", F.coalesce("n", F.lit(0)).alias("observations"), "last_at")
