"""All queries outside the llm subpackage, by name, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labloom.operators.nested import node_rows, pack_rows
from labloom.operators.units import other_units, recorded_units
from labloom.plans import aggregate_queries, block_queries, catalog, decision_queries, evidence_queries, more_queries, page_queries, relational_queries, scalar_queries  # noqa: F401  (entering their queries)
from labloom.plans import packs_sql, units_sql
from labloom.plans.catalog import Query
from labloom.session import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coded observation with its value in the canonical unit."""
    return p4_canonical(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each child of each pack in the payloads."""
    return pack_rows(table(spark, sf_dir, "proof_packs"), attributes=False).drop("pack_no")


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each value of its own that a child has."""
    return pack_rows(table(spark, sf_dir, "proof_packs")).select("record_id", "pack_ord", "pack_no", "child", "parent_key", "child_key", F.explode("attributes").alias("name", "value"))


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every payload, linked to the one around it."""
    return node_rows(table(spark, sf_dir, "proof_packs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations printed in another unit than their analyte's canonical one."""
    return other_units(*(table(spark, sf_dir, t) for t in ("observation", "launch_scope_rules", "unit_dim")))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coded observation with its value in the canonical unit."""
    return recorded_units(*(table(spark, sf_dir, t) for t in ("observation", "launch_scope_rules", "unit_dim")))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_rows": p1_rows, "p1_nodes": p1_nodes, "p4_found": p4_found, "p4_canonical": p4_canonical} | catalog.QUERIES



def oracle_sql() -> dict[str, str]:
    return {"p1_found": packs_sql.FOUND, "p1_rows": packs_sql.VALUES, "p1_nodes": packs_sql.NODES, "p4_found": units_sql.FOUND, "p4_canonical": units_sql.CANONICAL} | catalog.SQL
