"""Folds over pages, sources, sinks and streams."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Window, functions as F

from labloom.functions import lab
from labloom.operators import folds
from labloom.plans.aggregate_queries import BOX_SQL, boxes
from labloom.plans.catalog import Tables, query
from labloom.plans.relational_queries import HEADER_PREFIXES, begins, sql_begins
from labloom.plans.scalar_queries import Q
from labloom.session import checkpoint_dir
from labloom.sources import readers, writers
from labloom.streaming import streams


LINES_SQL = "(SELECT doc_id, line_no, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) WHERE trim(line, ' ') <> '')"


# --- folds --------------------------------------------------------------------------------------------------------
def _banded(t: Tables, bands) -> DataFrame:
    d = t.documents.where("lines is not null and size(lines) > 0").select("doc_id", F.explode(bands(F.col("lines"))).alias("b"))
    return d.select("doc_id", F.col("b.i").alias("line_no"), F.col("b.band").alias("band"))


def fold_sql(order: str, value: str, close: str, update: str) -> str:
    """Bands by a running value, line by line: b is the line, r what stands before it."""
    return f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM documents WHERE lines IS NOT NULL),
    b AS (SELECT doc_id, i, v, row_number() OVER (PARTITION BY doc_id ORDER BY {order}, i) AS n FROM (SELECT doc_id, i::INT AS i, x.x0 AS x0, x.y0 AS y0, ({value})::DOUBLE AS v FROM l)),
    r AS (SELECT doc_id, n, i, 0 AS band, v AS c, 1 AS k FROM b WHERE n = 1 UNION ALL SELECT b.doc_id, b.n, b.i, r.band + CASE WHEN {close} THEN 0 ELSE 1 END, CASE WHEN {close} THEN {update} ELSE b.v END, CASE WHEN {close} THEN r.k + 1 ELSE 1 END FROM r JOIN b ON b.doc_id = r.doc_id AND b.n = r.n + 1)
    SELECT doc_id, i AS line_no, band FROM r"""


@query(fold_sql("y0, x0", "x.y0", "abs(b.v - r.c) <= 3.0", "(r.c + b.v) / 2"))
def seq01_line_bands(t: Tables) -> DataFrame:
    """Lines in bands by the running median of their tops."""
    return _banded(t, folds.line_bands)


@query(fold_sql("v, x0", "(x.y0 + x.y1) / 2", "abs(b.v - r.c) <= 4.5", "r.c + (b.v - r.c) / (r.k + 1)"))
def seq03_mean_rows(t: Tables) -> DataFrame:
    return _banded(t, folds.mean_rows)


@query(fold_sql("v, x0", "(x.y0 + x.y1) / 2", "abs(b.v - r.c) < 5.0", "r.c"))
def seq04_anchored_rows(t: Tables) -> DataFrame:
    return _banded(t, folds.anchored_rows)


@query(
    f"""WITH w AS (SELECT doc_id, median(greatest(1.0, x1 - x0)) AS m FROM {BOX_SQL} GROUP BY doc_id),
    g AS (SELECT b.doc_id, b.pos, b.x0, CASE WHEN b.x0 - lag(b.x1) OVER o > greatest(28.0, w.m * 4.5) THEN 1 ELSE 0 END AS s FROM {BOX_SQL} b JOIN w USING (doc_id) WINDOW o AS (PARTITION BY b.doc_id ORDER BY b.x0, b.pos))
    SELECT doc_id, segment::BIGINT AS segment, count(*) AS n, min(x0) AS x0 FROM (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY x0, pos ROWS UNBOUNDED PRECEDING) AS segment FROM g) GROUP BY 1, 2"""
)
def seq02_segments(t: Tables) -> DataFrame:
    """Boxes from left to right, split where the gap exceeds four and a half usual widths."""
    width = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")).cast("double"))
    b = boxes(t)
    m = b.groupBy("doc_id").agg(F.median(width).alias("m"))
    o = Window.partitionBy("doc_id").orderBy("x0", "pos")
    start = F.when(F.col("x0") - F.lag("x1").over(o) > F.greatest(F.lit(28.0), F.col("m") * 4.5), 1).otherwise(0)
    g = b.join(m, "doc_id").withColumn("s", start)
    g = g.withColumn("segment", F.sum("s").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("doc_id", "segment").agg(F.count("*").alias("n"), F.min("x0").alias("x0"))


@query()
def seq05_overlap_clusters(t: Tables) -> DataFrame:
    """Rows of a page whose labels hold each other in greedy clusters, the fullest row kept."""
    has = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0)
    rows = t.extracted_row.select("id", "document_id", "source_page", "created_at", lab.label_key(F.col("raw_analyte_label")).alias("k"), (has("raw_value_string") * 10 + has("raw_unit_string") * 4 + has("raw_reference_range") * 2).alias("score"))
    return folds.greedy_clusters(rows.where("k <> ''"), ["document_id", "source_page"], "created_at", "k", "score", "id")


_LOW = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' '))"
_HELD = lambda x, words: f"regexp_matches({x}, {Q('|'.join(map(re.escape, words)))})"
_HEADING = f"(NOT regexp_matches({_LOW('x')}, '[0-9]') AND ({_HELD(_LOW('x'), folds.HEADINGS)} OR (x = upper(x) AND regexp_matches(x, '[A-Z]') AND len(string_split({_LOW('x')}, ' ')) <= 6)))"


@query(
    f"""WITH k AS (SELECT doc_id, line_no, line, CASE WHEN {sql_begins('lower(line)', HEADER_PREFIXES)} THEN 'excluded' WHEN regexp_matches(lower(line), '^[\\(\\[]?(ref|range)(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 'continuation' WHEN regexp_matches(line, '[0-9]') THEN 'value' ELSE 'label' END AS kind FROM {LINES_SQL}),
    p AS (SELECT * FROM (SELECT *, coalesce(sum((kind = 'excluded')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM k) WHERE kind <> 'excluded'),
    h AS (SELECT * REPLACE (CASE WHEN kind = 'value' AND held = 'value' AND regexp_matches({_LOW('line')}, {Q(folds.BESIDE)}) THEN 'continuation' ELSE kind END AS kind) FROM (SELECT *, coalesce(last_value(nullif(kind, 'continuation') IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'label') AS held FROM p)),
    v AS (SELECT *, coalesce(sum((kind = 'value')::INT) OVER w, 0) - CASE WHEN kind = 'continuation' AND coalesce(last_value(nullif(kind, 'continuation') IGNORE NULLS) OVER w, 'label') = 'value' THEN 1 ELSE 0 END AS r FROM h WINDOW w AS (PARTITION BY doc_id, part ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT doc_id, part, r, list(line ORDER BY line_no) AS ls, list_position(list(kind ORDER BY line_no), 'value') AS v FROM v GROUP BY 1, 2, 3),
    f AS (SELECT *, ls[1:v - 1] AS front, array_to_string(list_transform(ls[1:v - 1], lambda x: {_LOW('x')}), ' ') AS text FROM g WHERE v > 0),
    j AS (SELECT *, len(front) BETWEEN 1 AND 3 AND len(string_split(text, ' ')) <= 10 AND regexp_matches(text, '\\p{{L}}') AND len(list_filter(front, lambda x: ends_with({_LOW('x')}, ':'))) = 0 AND NOT {_HELD('text', folds.NOT_JOINED)} AS joined, list_position(list_transform(front, lambda x: NOT {_HEADING}), true) AS begins_at FROM f)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, r) - 1)::INT AS "group", list_concat(CASE WHEN joined AND begins_at > 0 THEN front[begins_at:] ELSE [] END, ls[v:]) AS lines FROM j"""
)
def seq06_seq07_label_value_groups(t: Tables) -> DataFrame:
    """Lines of a page grouped into rows of labels and the value that follows: SEQ06 (V3); SEQ07 (V2) is seq07_measurement_groups."""
    lines = readers.text_lines(t.documents, "doc_id", "text")
    low = F.lower("line")
    kind = F.when(begins(low, HEADER_PREFIXES), "excluded").when(low.rlike(r"^[\(\[]?(ref|range)\b"), "continuation").when(low.rlike("[0-9]"), "value").otherwise("label")
    return folds.label_value_groups(lines.withColumn("kind", kind), ["id"], "line_no").withColumnRenamed("id", "doc_id")


#: Words that are a result by themselves.
QUALITATIVE = ["positive", "negative", "reactive", "non reactive", "non-reactive", "detected", "not detected", "trace", "absent", "present"]
BARE_UNIT, BARE_RANGE, BARE_FLAG, BARE_INDEX, ANY_NUMBER = r"^(?:%|[a-zA-Z]+/[a-zA-Z0-9/]+)$", r"^[\[(]?\s*\d[\d.,]*\s*[-–]\s*\d[\d.,]*\s*[\])]?$", r"^(?:high|low|normal|abnormal|h|l)$", r"^\d{1,2}$", r"(?:^|\s)(?:<=|>=|<|>|≤|≥)?\s*\d[\d.,]*(?:\s|$)"


@query(
    f"""WITH l AS (SELECT doc_id, line_no, line, lower(line) AS low FROM {LINES_SQL}),
    k AS (SELECT *, CASE WHEN regexp_matches(line, {Q(BARE_INDEX)}) THEN 'index' WHEN regexp_matches(line, {Q(BARE_UNIT)}) OR regexp_matches(line, {Q(BARE_RANGE)}) OR regexp_matches(low, {Q(BARE_FLAG)}) THEN 'continuation' WHEN regexp_matches(line, {Q(ANY_NUMBER)}) OR low IN ({', '.join(map(Q, QUALITATIVE))}) THEN 'value' ELSE 'label' END AS kind,
      regexp_matches(line, {Q(ANY_NUMBER)}) AS bearing, {sql_begins('low', HEADER_PREFIXES)} AS excluded, regexp_matches(line, {Q(BARE_UNIT)}) AS unit_only, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l),
    s AS (WITH RECURSIVE r AS (SELECT doc_id, n, CASE kind WHEN 'value' THEN true WHEN 'index' THEN true ELSE false END AS full, false AS was, 0 AS grp FROM k WHERE n = 1
      UNION ALL SELECT k.doc_id, k.n, CASE k.kind WHEN 'value' THEN NOT r.full WHEN 'index' THEN true WHEN 'label' THEN false ELSE r.full END, r.full, r.grp + CASE WHEN r.full AND k.kind IN ('label', 'value') THEN 1 ELSE 0 END FROM r JOIN k ON k.doc_id = r.doc_id AND k.n = r.n + 1) SELECT * FROM r),
    t AS (SELECT k.*, s.grp, k.kind IN ('value', 'index') AND NOT s.was AS first FROM k JOIN s USING (doc_id, n)),
    u AS (SELECT * FROM (SELECT *, bool_and(excluded) OVER w AND NOT bool_or(first) OVER w AND bool_or(first) OVER (PARTITION BY doc_id, grp) AS trimmed FROM t WINDOW w AS (PARTITION BY doc_id, grp ORDER BY n ROWS UNBOUNDED PRECEDING)) WHERE NOT trimmed),
    g AS (SELECT doc_id, grp, bool_or(bearing) AS has, bool_and(excluded) AS none, arg_min(unit_only, n) AS unit_first FROM u GROUP BY 1, 2),
    h AS (SELECT *, (SELECT min(x.grp) FROM g x WHERE x.doc_id = g.doc_id AND x.has AND x.grp >= g.grp) AS target FROM g),
    i AS (SELECT * FROM h WHERE target IS NOT NULL AND (has OR NOT none)),
    j AS (SELECT doc_id, target, arg_max(unit_first, (NOT has, grp)) AS unit_first FROM i GROUP BY 1, 2),
    m AS (SELECT doc_id, target, sum(CASE WHEN rn = 1 OR NOT unit_first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY target ROWS UNBOUNDED PRECEDING) - 1 AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY target) AS rn FROM j))
    SELECT u.doc_id, m.g::BIGINT AS "group", list(u.line ORDER BY i.target, i.has, -i.grp, u.n) AS lines FROM u JOIN i ON i.doc_id = u.doc_id AND i.grp = u.grp JOIN m ON m.doc_id = i.doc_id AND m.target = i.target GROUP BY 1, 2"""
)
def seq07_measurement_groups(t: Tables) -> DataFrame:
    """Lines of a page grouped into measurements, labels carried to the next value however many there are (SEQ07, V2)."""
    lines = readers.text_lines(t.documents, "doc_id", "text").withColumnRenamed("id", "doc_id")
    l, low = F.col("line"), F.lower("line")
    continuation = l.rlike(BARE_UNIT) | l.rlike(BARE_RANGE) | low.rlike(BARE_FLAG)
    kind = F.when(l.rlike(BARE_INDEX), "index").when(continuation, "continuation").when(l.rlike(ANY_NUMBER) | low.isin(QUALITATIVE), "value").otherwise("label")
    told = lines.select("doc_id", "line_no", "line", kind.alias("kind"), l.rlike(ANY_NUMBER).alias("bearing"), begins(low, HEADER_PREFIXES).alias("excluded"), l.rlike(BARE_UNIT).alias("unit_only"))
    return folds.measurement_groups(told, ["doc_id"], "line_no")


@query(
    """WITH r AS (SELECT job_id, id, created_at, CASE WHEN raw_unit_string IS NOT NULL THEN id END AS target, raw_unit_string IS NULL AND parsed_numeric_value IS NOT NULL AS side FROM extracted_row),
    l AS (SELECT *, last_value(target IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS into_id FROM r)
    SELECT id, into_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, into_id ORDER BY created_at, id) AS rn FROM l WHERE side AND into_id IS NOT NULL) WHERE rn = 1"""
)
def seq08_sidecars(t: Tables) -> DataFrame:
    """Values without a unit joined to the row before them that has one, the first to each."""
    o = Window.partitionBy("job_id").orderBy("created_at", "id")
    r = t.extracted_row.select("job_id", "id", "created_at", F.when(F.col("raw_unit_string").isNotNull(), F.col("id")).alias("target"), (F.col("raw_unit_string").isNull() & F.col("parsed_numeric_value").isNotNull()).alias("side"))
    l = r.withColumn("into_id", F.last("target", True).over(o.rowsBetween(Window.unboundedPreceding, -1))).where("side and into_id is not null")
    return l.withColumn("rn", F.row_number().over(Window.partitionBy("job_id", "into_id").orderBy("created_at", "id"))).where("rn = 1").select("id", "into_id")


RATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, ts, event_id, n, true AS allowed, [ts] AS held FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.ts, e.event_id, e.n, len(list_filter(r.held, lambda x: e.ts - x <= INTERVAL 300 SECOND)) < 20, CASE WHEN len(list_filter(r.held, lambda x: e.ts - x <= INTERVAL 300 SECOND)) < 20 THEN list_append(list_filter(r.held, lambda x: e.ts - x <= INTERVAL 300 SECOND), e.ts) ELSE list_filter(r.held, lambda x: e.ts - x <= INTERVAL 300 SECOND) END
      FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, ts, event_id, allowed FROM r"""


@query(RATE_SQL)
def seq09_st05_rate_limit(t: Tables) -> DataFrame:
    """Twenty events of a user in 300 seconds; refused ones don't count."""
    return folds.rate_limited(t.events, "user_id", "ts", "event_id")


@query(
    f"""WITH l AS (SELECT *, regexp_matches(line, '[0-9]') AS v FROM {LINES_SQL}),
    g AS (SELECT *, coalesce(sum(v::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM l)
    SELECT doc_id, g::BIGINT AS carried, string_agg(line, ' ' ORDER BY line_no) AS text, bool_or(v) AS complete FROM g GROUP BY doc_id, g"""
)
def wn13_carried_lines(t: Tables) -> DataFrame:
    """Lines without a number wait for the next one with a number."""
    l = readers.text_lines(t.documents, "doc_id", "text").withColumn("v", F.col("line").rlike("[0-9]"))
    o = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    g = l.withColumn("g", F.coalesce(F.sum(F.col("v").cast("int")).over(o), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), " ")
    return g.groupBy(F.col("id").alias("doc_id"), F.col("g").cast("bigint").alias("carried")).agg(text.alias("text"), F.bool_or("v").alias("complete"))


# --- sources ------------------------------------------------------------------------------------------------------
EXTENSIONS, MIMES = [".pdf", ".json", ".PNG", ".jpg", ".exe", ""], ["application/x-pdf", "application/json", "image/png", "image/jpg", "application/octet-stream", ""]
_M = "{" + ", ".join(f"{Q(k)}: {Q(v)}" for k, v in readers.MIME_ALIASES.items()) + "}"


@query(
    f"""WITH f AS (SELECT doc_id, 'in/' || doc_id || ({[*EXTENSIONS]!r})[1 + doc_id % 6] AS path, ({[*MIMES]!r})[1 + (doc_id % 7) % 6] AS mime, (CASE WHEN doc_id % 2 = 0 THEN '%PDF' ELSE '' END) || coalesce(text, '') AS content FROM documents),
    k AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename, lower(regexp_extract(path, '(\\.[^.]+)$', 1)) AS extension, coalesce(MAP {_M}[mime], mime) AS m, octet_length(encode(content)) AS length FROM f)
    SELECT path, filename, extension, m AS mime_type, length, sha256(content) AS checksum, CASE WHEN rj IS NULL THEN CASE extension WHEN '.json' THEN 'structured' WHEN '.pdf' THEN 'trusted_pdf' ELSE 'image_beta' END END AS lane_type, rj AS reject FROM (SELECT *, CASE
      WHEN length > 20000 THEN 'file_too_large' WHEN filename = '' THEN 'filename_missing' WHEN extension = '' THEN 'unsupported_extension:missing' WHEN extension NOT IN ('.pdf', '.png', '.jpg', '.json') THEN 'unsupported_extension:' || extension
      WHEN NOT ((extension = '.pdf' AND m = 'application/pdf') OR (extension = '.png' AND m = 'image/png') OR (extension = '.jpg' AND m = 'image/jpeg') OR (extension = '.json' AND m = 'application/json')) THEN 'mime_type_mismatch:' || extension || ':' || coalesce(nullif(m, ''), 'missing')
      WHEN extension = '.pdf' AND NOT starts_with(content, '%PDF') THEN 'magic_byte_mismatch:pdf' WHEN extension IN ('.png', '.jpg') THEN 'magic_byte_mismatch:' || substr(extension, 2) END AS rj FROM k)"""
)
def src01_src04_classify_uploads(t: Tables) -> DataFrame:
    """Uploads with size, name, kind and first bytes checked; the corpus stands in for the files."""
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    d = F.col("doc_id")
    content = F.concat(F.when(d % 2 == 0, "%PDF").otherwise(""), F.coalesce("text", F.lit("")))
    files = t.documents.select(F.concat(F.lit("in/"), d.cast("string"), pick(EXTENSIONS, d % 6)).alias("path"), pick(MIMES, (d % 7) % 6).alias("mime_type"), F.encode(content, "UTF-8").alias("content"))
    return readers.classify_uploads(files.withColumn("length", F.octet_length("content").cast("bigint")), 20_000)


_O = "source_page, row_hash, raw_text, raw_analyte_label, raw_value_string, raw_unit_string, raw_reference_range, parsed_numeric_value"


@query(
    f"""WITH r AS (SELECT * REPLACE (CASE WHEN source_page > 3 THEN 0 ELSE source_page END AS source_page) FROM extracted_row),
    o AS (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY {', '.join(c + ' NULLS FIRST' for c in _O.split(', '))}) - 1)::INT AS index FROM r),
    e AS (SELECT *, list_filter([CASE WHEN source_page IS NULL THEN 'source_page' END, CASE WHEN row_hash IS NULL THEN 'row_hash' END, CASE WHEN raw_analyte_label IS NULL THEN 'raw_analyte_label' END], lambda x: x IS NOT NULL) AS missing FROM o)
    SELECT job_id AS id, index, row_hash, raw_analyte_label, CASE WHEN len(missing) > 0 THEN 'structured_observation_missing_fields:' || index || ':' || array_to_string(missing, ',') WHEN source_page < 1 THEN 'structured_observation_invalid_source_page:' || index
      WHEN trim(row_hash, ' ') = '' THEN 'structured_observation_invalid_row_hash:' || index WHEN trim(raw_analyte_label, ' ') = '' THEN 'structured_observation_invalid_analyte_label:' || index END AS error FROM e"""
)
def src05_structured_rows(t: Tables) -> DataFrame:
    """Structured payloads with the error of each row that has one; every job is one payload."""
    row = F.struct(F.when(F.col("source_page") > 3, F.lit(0)).otherwise(F.col("source_page")).alias("source_page"), "row_hash", "raw_text", "raw_analyte_label", "raw_value_string", "raw_unit_string", "raw_reference_range", "parsed_numeric_value")
    payload = t.extracted_row.groupBy("job_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("observations"))).alias("payload"))
    return readers.structured_rows(payload, "job_id", "payload").select("id", "index", "row.row_hash", "row.raw_analyte_label", "error")


_CLEANED = r"regexp_replace(regexp_replace(regexp_replace(trim(payload, ' '), '^```(?:json)?\s*', ''), '```\s*$', ''), ',\s*([}\]])', '\1', 'g')"
_PIECES = f"list_filter(regexp_extract_all(cleaned, {Q(r'(?s)(\{[^{}]*?"metric"[^{}]*?\})')}, 1), lambda p: json_valid(p))"
_ROWS = lambda j: f"CASE WHEN json_type({j}::JSON, '$.rows') = 'ARRAY' THEN json_array_length({j}::JSON, '$.rows') ELSE 1 END"


@query(
    f"""WITH c AS (SELECT record_id, payload, {_CLEANED} AS cleaned FROM proof_packs WHERE payload IS NOT NULL), p AS (SELECT *, {_PIECES} AS pieces FROM c)
    SELECT record_id AS id, CASE WHEN json_valid(payload) THEN 'strict' WHEN json_valid(cleaned) THEN 'repaired' WHEN len(pieces) > 0 THEN 'harvested' ELSE 'lost' END AS how, (CASE WHEN json_valid(payload) THEN {_ROWS('payload')} WHEN json_valid(cleaned) THEN {_ROWS('cleaned')} ELSE len(pieces) END)::INT AS objects FROM p"""
)
def src12_lenient_json(t: Tables) -> DataFrame:
    """What can be recovered of payloads that may be damaged."""
    return readers.lenient_objects(t.proof_packs.where("payload is not null"), "record_id", "payload", "metric").select("id", "how", F.size("objects").alias("objects"))


@query(
    "SELECT id, concat_ws(' ', coalesce(raw_analyte_label, ''), coalesce(raw_value_string, ''), coalesce(raw_unit_string, ''), coalesce(raw_reference_range, '')) AS raw_text, coalesce(raw_analyte_label, '') AS raw_analyte_label, coalesce(raw_value_string, '') AS raw_value_string, coalesce(raw_unit_string, '') AS raw_unit_string, coalesce(raw_reference_range, '') AS raw_reference_range FROM extracted_row"
)
def src13_html_cells(t: Tables) -> DataFrame:
    cells = [F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>")) for c in ("raw_analyte_label", "raw_value_string", "raw_unit_string", "raw_reference_range")]
    return readers.html_rows(t.extracted_row.select("id", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html")), "id", "html")


@query(f"SELECT doc_id, line_no::INT AS line_no, line FROM {LINES_SQL}")
def src06_text_lines(t: Tables) -> DataFrame:
    return readers.text_lines(t.documents, "doc_id", "text").withColumnRenamed("id", "doc_id")


@query()
def src17_src18_manifest(t: Tables) -> DataFrame:
    """The files of the data folder by tier, with checksums."""
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(t.sf_dir)
    return readers.manifest(files).groupBy("tier", "kind").agg(F.count("*").alias("files"), F.count_distinct("checksum").alias("contents"))


# --- sinks --------------------------------------------------------------------------------------------------------
#: Columns of the reference's extracted rows, and the widths of those that are bounded there.
STAGE_COLUMNS = ["id", "document_id", "job_id", "source_page", "row_hash", "raw_text", "raw_analyte_label", "raw_value_string", "raw_unit_string", "raw_reference_range", "extraction_confidence"]
STAGE_WIDTHS = {"raw_value_string": 64, "raw_unit_string": 64, "raw_reference_range": 128}


@query("SELECT id, document_id, job_id, source_page, row_hash, raw_text, raw_analyte_label, substr(raw_value_string, 1, 64) AS raw_value_string, substr(raw_unit_string, 1, 64) AS raw_unit_string, substr(raw_reference_range, 1, 128) AS raw_reference_range, extraction_confidence FROM extracted_row")
def snk01_extracted_stage(t: Tables) -> DataFrame:
    """The reference's stage table of extracted rows, with its columns and widths: text and label are whole."""
    path = f"{checkpoint_dir(t.spark)}/stage-{uuid.uuid4().hex}"
    writers.append_stage(t.extracted_row.select(STAGE_COLUMNS), path, STAGE_WIDTHS)
    return t.spark.read.parquet(path)


@query("""SELECT lane_type, '{"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '","dead_letter":' || dead_letter || ',"id":"' || id || '","user_id":' || coalesce('"' || user_id || '"', 'null') || '}' AS document FROM jobs""")
def snk05_snk09_documents(t: Tables) -> DataFrame:
    """Jobs as JSON documents by lane."""
    return writers.documents_json(t.jobs.select("lane_type", "id", "created_at", "dead_letter", "user_id"), "lane_type")


@query("SELECT source_feed, '## ' || source_feed || chr(10) || string_agg('- ' || status, chr(10) ORDER BY status) AS section FROM (SELECT DISTINCT source_feed, status FROM jobs) GROUP BY source_feed")
def snk08_markdown(t: Tables) -> DataFrame:
    return writers.markdown_report(t.jobs, "source_feed", "status")


# --- streams ------------------------------------------------------------------------------------------------------
def _event_stream(t: Tables) -> DataFrame:
    s = streams.folder_stream(t.spark, t.sf_dir, t.events.schema, glob="events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _complete(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    """The stream run to its end; what its last batch holds, or all of them. A batch tried again overwrites its own folder, so no row comes twice."""
    base = f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    streams.each_batch_to_end(stream, f"{base}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={n}"), mode)
    out = t.spark.read.parquet(f"{base}/out")
    return out if mode == "complete" else out.drop("batch")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 0")
def st02_progress(t: Tables) -> DataFrame:
    return _complete(t, streams.progress(_event_stream(t), "user_id", "event_type", "ts"), "complete").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def st_tumbling_windows(t: Tables) -> DataFrame:
    w = streams.windowed(_event_stream(t), "ts", ["event_type"], "1 hour")
    return _complete(t, w, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM g GROUP BY user_id, g.g"""
)
def st_sessions(t: Tables) -> DataFrame:
    s = streams.sessions(_event_stream(t), "ts", ["user_id"], "30 minutes")
    return _complete(t, s, "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT DISTINCT event_id FROM events")
def st01_st03_st06_idempotent_log(t: Tables) -> DataFrame:
    """Events delivered twice go into the append-only log once."""
    s = streams.idempotent(_event_stream(t), "event_id", "ts").select("event_id")
    return _complete(t, s, "append")


@query(RATE_SQL)
def st05_rate_limit_stream(t: Tables) -> DataFrame:
    return _complete(t, streams.rate_limited_stream(_event_stream(t), "user_id", "ts", "event_id"), "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
