"""The queries of the operators for training text, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labloom.llm.canonical import map_observations

    return map_observations(*(_table(spark, sf_dir, t) for t in ("observation", "launch_scope_rules", "unit_dim")))


def p2_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many observations each label without an entry has, over all labels."""
    found = p2_found(spark, sf_dir).where("candidate_code = '__unmapped__'")
    labels = _table(spark, sf_dir, "observation").select(F.col("id").alias("observation_id"), "raw_analyte_label")
    return found.join(labels, "observation_id").groupBy("raw_analyte_label").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labloom.llm.truncation import cut_fields

    return cut_fields(_table(spark, sf_dir, "extracted_row"), _table(spark, sf_dir, "unit_dim"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labloom.llm.truncation import cut_rates

    return cut_rates(_table(spark, sf_dir, "extracted_row"), _table(spark, sf_dir, "unit_dim"))


PLAIN_FIELDS = ["raw_analyte_label", "raw_reference_range", "raw_text"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labloom.llm.plain import changed_fields

    return changed_fields(_table(spark, sf_dir, "observation"), PLAIN_FIELDS).select(F.col("id").alias("observation_id"), "field_name")


def p5_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labloom.llm.plain import plain_fields

    return plain_fields(_table(spark, sf_dir, "observation"), PLAIN_FIELDS).withColumnRenamed("id", "observation_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labloom.llm.tokens import encode

    return encode(_table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labloom.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "container_spec"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the tokens of every window of containers are from the shares of the papers."""
    from labloom.llm.packing import mixture, pack_documents

    return mixture(pack_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "container_spec"), keep_source=True))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labloom.llm.spans import shared_spans

    return shared_spans(_table(spark, sf_dir, "documents"))


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labloom.llm.spans import shared_share

    return shared_share(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_misses": p2_misses, "p3_found": p3_found, "p3_rates": p3_rates, "p5_found": p5_found, "p5_plain": p5_plain, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_mixture": p7_mixture, "p8_found": p8_found, "p8_share": p8_share}


def _p5_sql() -> str:
    """Each field by what it must not hold, rather than by what becomes of it."""
    from labloom.llm import plain

    invisible, spaces, compat = plain._tables()
    look, words = plain._class("".join(plain.LOOKALIKES)), r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{M}]+"
    q = plain._quoted
    # words are told apart once what is invisible is gone and wide letters are narrow
    wide = [c for c in compat if "！" <= c <= "～"]
    bare = f"regexp_replace(translate(t, {q(''.join(wide))}, {q(''.join(compat[c] for c in wide))}), {q(plain._class(invisible))}, '', 'g')"
    alike = f"list_filter(regexp_extract_all({bare}, {q(words)}), lambda w: regexp_matches(w, {q(look)}) AND (regexp_matches(w, '\\p{{Latin}}') OR regexp_full_match(w, {q('(?:' + look + '|' + chr(92) + 'p{M})+')})))"
    fields = ", ".join(f"'{f}'" for f in PLAIN_FIELDS)
    return f"""SELECT observation_id, field_name FROM (SELECT id AS observation_id, unnest([{fields}]) AS field_name, unnest([{', '.join(PLAIN_FIELDS)}]) AS t FROM observation)
    WHERE regexp_matches(t, '[^\\x00-\\x7f]') AND (regexp_matches(t, {q(plain._class(''.join(compat)))}) OR regexp_matches(t, {q(plain._class(invisible))}) OR regexp_matches(t, {q(plain._class(spaces))}) OR nfc_normalize(t) <> t OR len({alike}) > 0)"""


P8_SQL = """WITH w AS (SELECT doc_id, i, hash(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM w SEMI JOIN r USING (h)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM g GROUP BY doc_id, island"""


P8_SHARE_SQL = f"""SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(s.n, 0)::BIGINT AS shared_chars, CASE WHEN coalesce(length(d.text), 0) > 0 THEN coalesce(s.n, 0) / length(d.text) ELSE 0.0 END AS share
FROM documents d LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n FROM ({P8_SQL}) GROUP BY doc_id) s USING (doc_id)"""


def _p5_plain_sql() -> str:
    """The expressions of the operator over the table itself, outside of Spark."""
    from labloom.llm import plain

    def of(column: str) -> str:
        source = f"SELECT id, {column} AS s FROM observation"
        for step in plain.plain_sql("s"):
            source = f"SELECT id, {step} AS s FROM ({source})"
        return source

    joined = " ".join(f"JOIN ({of(f)}) {f[4]}{i} ON {f[4]}{i}.id = o.id" for i, f in enumerate(PLAIN_FIELDS))
    names = [f"{f[4]}{i}" for i, f in enumerate(PLAIN_FIELDS)]
    changed = ", ".join(f"CASE WHEN {n}.s <> o.{f} THEN '{f}' END" for n, f in zip(names, PLAIN_FIELDS, strict=True))
    return f"SELECT o.id AS observation_id, {', '.join(f'{n}.s AS {f}' for n, f in zip(names, PLAIN_FIELDS, strict=True))}, list_filter([{changed}], lambda x: x IS NOT NULL) AS changed_fields FROM observation o {joined}"


def oracle_sql() -> dict[str, str]:
    return {"p5_found": _p5_sql(), "p5_plain": _p5_plain_sql(), "p8_found": P8_SQL, "p8_share": P8_SHARE_SQL}
