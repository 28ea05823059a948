"""Label, unit and number spelling; persistence with resolved keys; artifact parts; append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from labloom.functions import lab
from labloom.plans.catalog import Tables, query
from labloom.plans.scalar_queries import Q, sql_collapse, sql_map
from labloom.session import checkpoint_dir
from labloom.sources import readers, writers

# --- fixed values -----------------------------------------------------------------------------------------------
UNIT_PREFIXES = {
    "%": "%", "mg/dl": "mg/dL", "g/dl": "g/dL", "mmol/l": "mmol/L", "umol/l": "umol/L", "miu/l": "mIU/L", "uiu/ml": "uIU/mL", "iu/l": "IU/L", "u/l": "U/L", "mcg/dl": "mcg/dL", "ng/ml": "ng/mL",
    "mg/l": "mg/L", "g/l": "g/L", "/ul": "/uL", "/µl": "/uL", "/μl": "/uL", "x10e3/ul": "x10E3/uL", "x10e6/ul": "x10E6/uL", "x10e9/l": "x10E9/L", "mm/h": "mm/h", "fl": "fL", "pg": "pg",
}
UNIT_PREFIX = r"^(%|mg/dl|g/dl|mmol/l|umol/l|miu/l|uiu/ml|iu/l|u/l|mcg/dl|ng/ml|mg/l|g/l|/ul|/µl|/μl|x10e3/ul|x10e6/ul|x10e9/l|mm/h|fl|pg)(?:[^a-z0-9_]|$)"
NO_UNIT = ["normal", "normeal", "abnormal", "dnr", "ldnr", "oor"]
OCR_LINE = r"^\s*(.*?)(?:\s+|[:=\-–—|])([+-]?\d+(?:\.\d+)?)(?:$|([^0-9A-Za-z_.].*)$)"


@query(
    """SELECT id, CASE WHEN regexp_matches(l, '^(?i)basophils?$') THEN 'BASOPHILS P' ELSE l END AS label FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(raw_analyte_label, '(?i)\\bcd\\s+([0-9])\\b', 'cd\\1', 'g'), '(?i)\\babs\\.?\\s+cd([0-9])\\b', 'absolute cd\\1', 'g'), '(?i)\\bmagnesium\\s*,?\\s*rbc\\b', 'MAGNESIUM RBMC', 'g') AS l FROM observation)"""
)
def sc08_label_rewrites(t: Tables) -> DataFrame:
    """Spellings that look-ups downstream expect."""
    l = F.col("raw_analyte_label")
    for pattern, to in ((r"(?i)\bcd\s+([0-9])\b", "cd$1"), (r"(?i)\babs\.?\s+cd([0-9])\b", "absolute cd$1"), (r"(?i)\bmagnesium\s*,?\s*rbc\b", "MAGNESIUM RBMC")):
        l = F.regexp_replace(l, pattern, to)
    return t.observation.select("id", F.when(l.rlike("^(?i)basophils?$"), "BASOPHILS P").otherwise(l).alias("label"))


_TOKENS_SQL = "list_filter(list_transform(string_split(raw_analyte_label, ' '), lambda x: regexp_replace(regexp_replace(x, '^[,;:()\\[\\]{}]+', ''), '[,;:()\\[\\]{}]+$', '')), lambda x: x <> '')"


@query(f"SELECT id, regexp_replace(array_to_string({_TOKENS_SQL}, ' '), '( [0-9]{{1,2}})+$', '') AS label FROM observation")
def sc09_label_tokens(t: Tables) -> DataFrame:
    """Tokens without marks around them, footnote numbers at the end off."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[,;:()\[\]{}]+", ""), r"[,;:()\[\]{}]+$", "")
    tokens = F.filter(F.transform(F.split("raw_analyte_label", " "), clean), lambda x: x != "")
    return t.observation.select("id", F.regexp_replace(F.array_join(tokens, " "), "( [0-9]{1,2})+$", "").alias("label"))


@query(f"SELECT id, CASE lower(replace(v, ' ', '')) WHEN 'nonreactive' THEN 'Non Reactive' WHEN 'notdetected' THEN 'Not Detected' ELSE v END AS value FROM (SELECT id, {sql_collapse('raw_value_string')} AS v FROM extracted_row)")
def sc10_value_phrases(t: Tables) -> DataFrame:
    v = lab.collapse(F.col("raw_value_string"))
    bare = F.lower(F.replace(v, F.lit(" "), F.lit("")))
    return t.extracted_row.select("id", F.when(bare == "nonreactive", "Non Reactive").when(bare == "notdetected", "Not Detected").otherwise(v).alias("value"))


@query("SELECT id, regexp_replace(raw_text, '(?i)(1\\.73 ?m) ([23])', '\\1\\2', 'g') AS text FROM extracted_row")
def sc11_superscripts(t: Tables) -> DataFrame:
    """A superscript torn off its unit is put back."""
    return t.extracted_row.select("id", F.regexp_replace("raw_text", r"(?i)(1\.73 ?m) ([23])", "$1$2").alias("text"))


@query(f"SELECT id, regexp_matches(raw_text, {Q(OCR_LINE)}) AS parsed, nullif(trim(regexp_extract(raw_text, {Q(OCR_LINE)}, 1), ' '), '') AS label, nullif(regexp_extract(raw_text, {Q(OCR_LINE)}, 2), '') AS value, nullif(trim(regexp_extract(raw_text, {Q(OCR_LINE)}, 3), ' '), '') AS unit FROM extracted_row")
def sc22_ocr_line(t: Tables) -> DataFrame:
    """Label, first number and what follows it of a scanned line."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract("raw_text", OCR_LINE, i)), F.lit(""))
    return t.extracted_row.select("id", F.col("raw_text").rlike(OCR_LINE).alias("parsed"), part(1).alias("label"), part(2).alias("value"), part(3).alias("unit"))


_U = f"regexp_replace({sql_collapse('raw_unit_string')}, '( [0-9]{{1,2}})+$', '')"


@query(
    f"""SELECT id, CASE WHEN u IS NULL OR u = '' OR lower(u) IN ({', '.join(map(Q, NO_UNIT))}) THEN NULL WHEN starts_with(lower(u), '% not estab') OR lower(u) IN ('% o', '% 0') THEN '%'
    ELSE coalesce({sql_map(UNIT_PREFIXES)}[regexp_extract(lower(u), {Q(UNIT_PREFIX)}, 1)], u) END AS unit FROM (SELECT id, {_U} AS u FROM extracted_row)"""
)
def sc32_printed_unit(t: Tables) -> DataFrame:
    """The canonical spelling of the unit a text begins with."""
    u = F.regexp_replace(lab.collapse(F.col("raw_unit_string")), "( [0-9]{1,2})+$", "")
    low = F.lower(u)
    known = F.create_map(*[F.lit(x) for kv in UNIT_PREFIXES.items() for x in kv])[F.regexp_extract(low, UNIT_PREFIX, 1)]
    unit = F.when(u.isNull() | (u == "") | low.isin(NO_UNIT), None).when(low.startswith("% not estab") | low.isin("% o", "% 0"), "%").otherwise(F.coalesce(known, u))
    return t.extracted_row.select("id", unit.alias("unit"))


def six_digits(v: Column) -> Column:
    """A number with six significant digits as C's %g writes it (a digit beyond the sixth that is exactly a half rounds away from zero)."""
    e = F.format_string("%.5e", F.abs(v))
    digits, exp = F.replace(F.substring_index(e, "e", 1), F.lit("."), F.lit("")), F.substring_index(e, "e", -1).try_cast("int")
    cut = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    whole = F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, F.lit(6)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    science = F.concat(cut(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 6))), F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), 2, "0"))
    text = F.when(v.isNull(), None).when(v == 0, "0").when((exp < -4) | (exp >= 6), science).when(exp >= 0, cut(whole)).otherwise(cut(small))
    return F.when(v < 0, F.concat(F.lit("-"), text)).otherwise(text)


@query("SELECT id, format('{:g}', parsed_numeric_value) AS parsed, format('{:g}', -parsed_numeric_value / 1e7) AS small FROM observation")
def sc34_six_digits(t: Tables) -> DataFrame:
    v = F.col("parsed_numeric_value")
    return t.observation.select("id", six_digits(v).alias("parsed"), six_digits(-v / 1e7).alias("small"))


@query("SELECT candidate_code, canonical_label, len(aliases)::INT AS aliases, threshold_used FROM launch_scope_rules")
def src15_json_dimension(t: Tables) -> DataFrame:
    """A dimension written as JSON and loaded with its schema."""
    path = f"{checkpoint_dir(t.spark)}/dimension-{uuid.uuid4().hex}"
    t.launch_scope_rules.write.json(path)
    d = readers.json_dimension(t.spark, path, t.launch_scope_rules.schema)
    return d.select("candidate_code", "canonical_label", F.size("aliases").alias("aliases"), "threshold_used")


@query("SELECT * FROM (VALUES ('row-0', 'Glucose', 180.0::DOUBLE, 'mg/dL'), ('row-1', 'HbA1c', 6.8::DOUBLE, '%')) AS s(row_hash, raw_analyte_label, parsed_numeric_value, raw_unit_string)")
def src16_seeded_rows(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("row-0", "Glucose", 180.0, "mg/dL"), ("row-1", "HbA1c", 6.8, "%")], "row_hash string, raw_analyte_label string, parsed_numeric_value double, raw_unit_string string")


@query(
    """WITH o AS (SELECT o.id, o.job_id, r.id AS row_id FROM observation o JOIN extracted_row r ON r.row_hash = o.row_hash AND r.id = o.extracted_row_id),
    c AS (SELECT o.id, unnest(x.candidates) AS c FROM o JOIN observation x ON x.id = o.id)
    SELECT 'observation' AS entity, count(*) AS n FROM o UNION ALL SELECT 'candidate', count(*) FROM c UNION ALL SELECT 'accepted', count(*) FROM c WHERE c.accepted"""
)
def snk03_snk04_persist_linked(t: Tables) -> DataFrame:
    """Observations with their row's key resolved, and their candidates as a child table, written and counted."""
    base = f"{checkpoint_dir(t.spark)}/bundle-{uuid.uuid4().hex}"
    rows = t.extracted_row.select(F.col("id").alias("extracted_row_id"), "row_hash")
    linked = t.observation.join(rows, ["extracted_row_id", "row_hash"])
    writers.append_stage(linked.select("id", "job_id", "extracted_row_id", "raw_analyte_label"), f"{base}/observation", {"raw_analyte_label": 255})
    writers.append_stage(linked.select("id", F.explode("candidates").alias("c")).select("id", "c.*"), f"{base}/candidate")
    o, c = t.spark.read.parquet(f"{base}/observation"), t.spark.read.parquet(f"{base}/candidate")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
    return count("observation", o).unionByName(count("candidate", c)).unionByName(count("accepted", c.where("accepted")))


@query(
    """SELECT job_id, count(*) AS cards, list(id ORDER BY created_at DESC, id)[1:3] AS latest, any_value(language) AS language FROM (SELECT o.id, o.job_id, o.created_at, CASE WHEN coalesce(j.language_id, '') = '' THEN 'en' ELSE lower(j.language_id) END AS language FROM observation o JOIN jobs j ON j.id = o.job_id WHERE o.support_state = 'supported') GROUP BY job_id"""
)
def prj02_prj03_artifact_parts(t: Tables) -> DataFrame:
    """What an artifact of a job shows: how many results, the three latest, its language."""
    j = t.jobs.select(F.col("id").alias("job_id"), F.when(F.coalesce("language_id", F.lit("")) == "", "en").otherwise(F.lower("language_id")).alias("language"))
    o = t.observation.where("support_state = 'supported'").select("job_id", "id", "created_at")
    newest = Window.partitionBy("job_id").orderBy(F.desc("created_at"), "id")
    top = o.withColumn("rn", F.row_number().over(newest)).where("rn <= 3").groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("latest"))
    return o.groupBy("job_id").agg(F.count("*").alias("cards")).join(top, "job_id").join(j, "job_id").select("job_id", "cards", "latest", "language")


COPY = {"en": ("result", "results"), "vi": ("kết quả", "kết quả")}


@query("SELECT job_id, CASE WHEN language = 'vi' THEN n || ' kết quả' WHEN n = 1 THEN '1 result' ELSE n || ' results' END AS text FROM (SELECT o.job_id, count(*) AS n, any_value(CASE WHEN lower(coalesce(j.language_id, 'en')) = 'vi' THEN 'vi' ELSE 'en' END) AS language FROM observation o JOIN jobs j ON j.id = o.job_id GROUP BY o.job_id)")
def prj04_prj05_localized_text(t: Tables) -> DataFrame:
    """A sentence for each job in its language, with the plural it needs."""
    j = t.jobs.select(F.col("id").alias("job_id"), F.when(F.lower(F.coalesce("language_id", F.lit("en"))) == "vi", "vi").otherwise("en").alias("language"))
    n = t.observation.groupBy("job_id").agg(F.count("*").alias("n")).join(j, "job_id")
    words = F.create_map(*[x for k, (one, many) in COPY.items() for x in (F.lit(k), F.array(F.lit(one), F.lit(many)))])[F.col("language")]
    return n.select("job_id", F.concat_ws(" ", F.col("n").cast("string"), F.get(words, F.when(F.col("n") == 1, 0).otherwise(1))).alias("text"))


@query("SELECT job_id, list(id ORDER BY raw_analyte_label NULLS FIRST, row_hash, id) AS ids FROM observation GROUP BY job_id")
def or04_ordered_lists(t: Tables) -> DataFrame:
    """Lists in a fixed order of several columns."""
    return t.observation.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("raw_analyte_label", "row_hash", "id"))), lambda x: x["id"]).alias("ids"))


@query(
    "SELECT job_id, CASE WHEN record_id % 3 = 0 THEN 'clinician' ELSE 'patient' END AS artifact_type, count(*) AS views, max(received_at) AS latest FROM proof_packs GROUP BY 1, 2"
)
def mu07_share_log(t: Tables) -> DataFrame:
    """Each view of a patient's or clinician's artifact appended to the log as it comes, the log read by job; deliveries stand in for views."""
    path = f"{checkpoint_dir(t.spark)}/share-{uuid.uuid4().hex}"
    views = t.proof_packs.select("job_id", F.when(F.col("record_id") % 3 == 0, "clinician").otherwise("patient").alias("artifact_type"), F.col("received_at").alias("created_at"))
    for kind in ("patient", "clinician"):
        writers.append_stage(views.where(F.col("artifact_type") == kind), path)
    return t.spark.read.parquet(path).groupBy("job_id", "artifact_type").agg(F.count("*").alias("views"), F.max("created_at").alias("latest"))


@query(
    """WITH r AS (SELECT *, CASE WHEN raw_analyte_label IS NULL THEN 'null:raw_analyte_label' WHEN raw_text IS NULL THEN 'null:raw_text' END AS missing FROM extracted_row),
    k AS (SELECT *, row_number() OVER (PARTITION BY job_id, row_hash ORDER BY created_at, id) AS rn FROM r WHERE missing IS NULL AND job_id IS NOT NULL AND row_hash IS NOT NULL)
    SELECT r.id, coalesce(r.missing, CASE WHEN k.rn > 1 THEN 'duplicate_key' END) AS reject FROM r LEFT JOIN k ON k.id = r.id"""
)
def snk02_admitted_rows(t: Tables) -> DataFrame:
    """Rows that a table with a key and required columns takes, and those it refuses, each with its reason: one bad row costs no other."""
    rows = t.extracted_row.select("id", "job_id", "row_hash", "raw_analyte_label", "raw_text", "created_at")
    good, bad = writers.admitted(rows, ["job_id", "row_hash"], ["raw_analyte_label", "raw_text"], ["created_at", "id"])
    return good.select("id", F.lit(None).cast("string").alias("reject")).unionByName(bad.select("id", "reject"))


@query("SELECT source_feed, count(*) AS documents FROM extracted_row WHERE source_feed IS NOT NULL GROUP BY source_feed")
def snk07_debug_dump(t: Tables) -> DataFrame:
    """Extracted rows dumped as JSON where both gates are open, and read again."""
    path = f"{checkpoint_dir(t.spark)}/debug-{uuid.uuid4().hex}"
    rows = t.extracted_row.where("source_feed is not null").select("id", "source_feed", "raw_text", "raw_value_string", "created_at")
    writers.debug_dump(rows, path, "source_feed", debug=True, allowed=True)
    return t.spark.read.json(path).groupBy("source_feed").agg(F.count("id").alias("documents"))


@query(
    """SELECT n.n_name, r.r_name, count(DISTINCT o.o_orderkey) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
    WHERE l.l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n.n_name, r.r_name"""
)
def jn19_star_join(t: Tables) -> DataFrame:
    """A star join with a pushed filter; Catalyst picks how each table joins."""
    l = t.lineitem.where("l_shipdate >= timestamp_ntz '1995-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = l.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))
