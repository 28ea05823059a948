"""Page blocks: adapters, source precedence, likeness and routing; cards, validations and coercions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labloom.functions import lab
from labloom.operators import routes
from labloom.plans.catalog import Tables, query

LINES = "string_split(coalesce(text, ''), chr(10))"


@query(
    f"""WITH b AS (SELECT doc_id, unnest(lines) AS b, unnest({LINES}[1:len(lines)]) AS t, generate_subscripts(lines, 1) - 1 AS i FROM documents WHERE lines IS NOT NULL AND len(lines) > 0)
    SELECT doc_id, doc_id || '-b' || i AS block_id, i::INT AS reading_order, CASE WHEN b.conf < 60 THEN 'unknown_block' WHEN regexp_matches(coalesce(t, ''), '[0-9]') THEN 'result_block' ELSE 'narrative_block' END AS block_role, b.x0 AS x0, b.y0 AS y0, greatest(b.x1, b.x0) AS x1, greatest(b.y1, b.y0) AS y1 FROM b"""
)
def src08_src09_blocks(t: Tables) -> DataFrame:
    """Lines and their boxes as blocks with id, order, role and a box that isn't inside out."""
    d = t.documents.where("lines is not null and size(lines) > 0").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ts"), F.posexplode("lines").alias("i", "b"))
    text = F.coalesce(F.get("ts", F.col("i")), F.lit(""))
    role = F.when(F.col("b.conf") < 60, "unknown_block").when(text.rlike("[0-9]"), "result_block").otherwise("narrative_block")
    return d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("-b"), F.col("i").cast("string")).alias("block_id"), F.col("i").alias("reading_order"), role.alias("block_role"), "b.x0", "b.y0", F.greatest("b.x1", "b.x0").alias("x1"), F.greatest("b.y1", "b.y0").alias("y1"))


@query(f"SELECT doc_id, CASE WHEN coalesce(len(lines), 0) > 0 THEN 'boxes' WHEN trim(coalesce(text, ''), ' ') <> '' THEN 'lines' ELSE 'none' END AS source, CASE WHEN coalesce(len(lines), 0) > 0 THEN len(lines) WHEN trim(coalesce(text, ''), ' ') <> '' THEN len({LINES}) ELSE 0 END AS n, NOT coalesce(len(lines), 0) > 0 AS degraded FROM documents")
def src10_src14_precedence(t: Tables) -> DataFrame:
    """Of the forms a page comes in the best there is, marked where it is a lesser one."""
    boxes = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    text = F.trim(F.coalesce("text", F.lit(""))) != ""
    n = F.when(boxes > 0, boxes).when(text, F.size(F.split("text", "\n"))).otherwise(0)
    return t.documents.select("doc_id", F.when(boxes > 0, "boxes").when(text, "lines").otherwise("none").alias("source"), n.cast("bigint").alias("n"), (~(boxes > 0)).alias("degraded"))


@query(
    """SELECT id, replace(replace(replace(replace(replace(coalesce(accepted_analyte_display, raw_analyte_label), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS title, coalesce(canonical_value, parsed_numeric_value) AS value, coalesce(canonical_unit, raw_unit_string, '') AS unit
    FROM observation WHERE support_state = 'supported' AND coalesce(canonical_value, parsed_numeric_value) IS NOT NULL"""
)
def dm19_cards(t: Tables) -> DataFrame:
    """What a card of a supported result shows, escaped, the best value and unit there is."""
    v = F.coalesce("canonical_value", "parsed_numeric_value")
    o = t.observation.where((F.col("support_state") == "supported") & v.isNotNull())
    return o.select("id", lab.html_escape(F.coalesce("accepted_analyte_display", "raw_analyte_label")).alias("title"), v.alias("value"), F.coalesce("canonical_unit", "raw_unit_string", F.lit("")).alias("unit"))


_TEXT = "lower(regexp_replace(coalesce(raw_text, ''), '\\s+', ' ', 'g'))"
_SCORES = ", ".join("(" + " + ".join(f"max(contains(x, '{w}')::INT)" for w in ws) + f")::INT AS {kind}" for kind, ws in routes.KEYWORDS.items())


@query(
    f"""WITH l AS (SELECT *, {_TEXT} AS x FROM extracted_row WHERE document_id IS NOT NULL), s AS (SELECT document_id, {_SCORES}, coalesce(max(source_page), 0) AS pages, coalesce(avg(extraction_confidence), 0.0) AS extractability, sum(length(coalesce(raw_text, '')))::BIGINT AS chars FROM l GROUP BY document_id),
    d AS (SELECT s.*, 1 - extractability AS density, CASE WHEN j.lane_type = 'image_beta' AND j.retry_count > 0 THEN '.png' ELSE '.pdf' END AS extension, j.lane_type NOT IN ('image_beta', 'vlm') AS has_text, j.lane_type <> 'structured' AS has_image, j.dead_letter AS protected, j.status = 'failed' AS corrupt FROM s JOIN jobs j USING (document_id))
    SELECT document_id, {routes.case(0)} AS lane, {routes.case(1)} AS document_class, round(least(1.0, {routes.case(3, False)}), 3) AS confidence, {routes.case(4)} AS reason FROM d"""
)
def dm21_dm22_route(t: Tables) -> DataFrame:
    """The route of each document and how sure it is, by keyword scores and structure; its job stands in for the file's layers."""
    lines = t.extracted_row.where("document_id is not null")
    e = F.coalesce(F.avg("extraction_confidence"), F.lit(0.0))
    whole = lines.groupBy("document_id").agg(F.coalesce(F.max("source_page"), F.lit(0)).alias("pages"), e.alias("extractability"), F.sum(F.length(F.coalesce("raw_text", F.lit("")))).alias("chars"))
    lane = F.col("lane_type")
    j = t.jobs.select("document_id", F.when((lane == "image_beta") & (F.col("retry_count") > 0), ".png").otherwise(".pdf").alias("extension"), (~lane.isin("image_beta", "vlm")).alias("has_text"), (lane != "structured").alias("has_image"), F.col("dead_letter").alias("protected"), (F.col("status") == "failed").alias("corrupt"))
    d = routes.scores(lines, "document_id", "raw_text").join(whole, "document_id").join(j, "document_id").withColumn("density", 1 - F.col("extractability"))
    return routes.decided(d).select("document_id", "lane", "document_class", "confidence", "reason")


@query(
    """SELECT id, try_cast(replace(CASE WHEN regexp_matches(raw_value_string, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN raw_value_string END, ',', '') AS DOUBLE) AS strict, try_cast(CASE WHEN regexp_matches(replace(raw_value_string, ',', ''), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN replace(raw_value_string, ',', '') END AS DOUBLE) AS without_commas,
    coalesce(parsed_numeric_value, try_cast(CASE WHEN regexp_matches(raw_value_string, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN raw_value_string END AS DOUBLE)) AS first_of FROM extracted_row"""
)
def sc27_coercions(t: Tables) -> DataFrame:
    """The number a text is taken for under each rule in use; never an error."""
    number = lambda c: F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), c.try_cast("double"))
    v = F.col("raw_value_string")
    return t.extracted_row.select("id", number(v).alias("strict"), number(F.replace(v, F.lit(","), F.lit(""))).alias("without_commas"), F.coalesce("parsed_numeric_value", number(v)).alias("first_of"))


@query(
    """WITH b AS (SELECT job_id, CASE WHEN bool_and(support_state = 'supported') THEN 2 WHEN bool_or(support_state = 'supported') THEN 1 ELSE 0 END AS base, count(*) FILTER (len(suppression_reasons) > 0) AS held, count(*) AS n FROM observation GROUP BY job_id)
    SELECT job_id, (['could_not_assess', 'partially_supported', 'fully_supported'])[1 + least(base, CASE WHEN held = 0 THEN 2 WHEN held < n THEN 1 ELSE 0 END)] AS banner FROM b"""
)
def ag04_lowered_banner(t: Tables) -> DataFrame:
    """The banner of a job, lowered by what was held back: the lesser of two ranks."""
    ok = F.col("support_state") == "supported"
    base = F.when(F.bool_and(ok), 2).when(F.bool_or(ok), 1).otherwise(0)
    held, n = F.count_if(F.size("suppression_reasons") > 0), F.count("*")
    rank = F.least(base, F.when(held == 0, 2).when(held < n, 1).otherwise(0))
    return t.observation.groupBy("job_id").agg(F.get(F.array(*map(F.lit, ["could_not_assess", "partially_supported", "fully_supported"])), rank).alias("banner"))
