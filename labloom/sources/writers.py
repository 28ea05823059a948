"""Sinks: stage tables, proof packs as JSON, reports; each write is atomic per table or partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def clipped(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """String columns cut to the width their table has."""
    return df.withColumns({c: F.substring(c, 1, n) for c, n in widths.items()})


def append_stage(df: DataFrame, path: str, widths: dict[str, int] | None = None) -> None:
    """Rows of a stage appended to its table."""
    clipped(df, widths or {}).write.mode("append").parquet(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Columns a JSON document can hold: timestamps and dates as ISO text, binaries as hexadecimal."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.BinaryType):
            out[f.name] = F.lower(F.hex(f.name))
    return df.withColumns(out) if out else df


def documents_json(df: DataFrame, partition: str | None = None) -> DataFrame:
    """Every row as a JSON document, members in the order of their names, nulls written out: (partition,) document."""
    safe = json_safe(df)
    members = F.struct(*sorted(c for c in safe.columns if c != partition))
    doc = F.to_json(members, {"ignoreNullFields": "false"}).alias("document")
    return safe.select(*([partition] if partition else []), doc)


def write_documents(df: DataFrame, path: str, partition: str | None = None) -> None:
    """documents_json as text files, one folder for each value of ``partition``."""
    w = documents_json(df, partition).write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).text(path)


def markdown_report(df: DataFrame, group: str, item: str) -> DataFrame:
    """A Markdown section for each group: heading and list, items in order. One row for each group: group, section."""
    items = F.array_join(F.transform(F.array_sort(F.collect_set(F.col(item))), lambda x: F.concat(F.lit("- "), x)), "\n")
    return df.groupBy(group).agg(F.concat(F.lit("## "), F.first(group), F.lit("\n"), items).alias("section"))


def admitted(df: DataFrame, unique: list[str], required: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows a table may take, and those it must refuse with the reason: what a bulk write that fails and is tried row by row leaves.

    A row is refused for its first required column that is null ('null:column') or for a key that an earlier row, by
    ``order``, has ('duplicate_key'); a null in a unique column is no key. The first of each key is found by aggregation, so a
    frequent key is combined before the shuffle.
    """
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"null:{c}")) for c in required], F.lit(None).cast("string")) if required else F.lit(None).cast("string")
    rows = df.withColumn("_missing", missing).withColumn("_at", F.struct(*order))
    keyed = F.lit(True)
    for c in unique:
        keyed = keyed & F.col(c).isNotNull()
    first = rows.where(keyed & F.col("_missing").isNull()).groupBy(*unique).agg(F.min("_at").alias("_first"))
    marked = rows.join(first, unique, "left").withColumn("reject", F.when(F.col("_missing").isNotNull(), F.col("_missing")).when(F.col("_first").isNotNull() & (F.col("_at") != F.col("_first")), "duplicate_key"))
    return marked.where("reject is null").select(df.columns), marked.where("reject is not null").select(*df.columns, "reject")


def debug_dump(df: DataFrame, path: str, partition: str, *, debug: bool, allowed: bool) -> bool:
    """Rows as JSON documents, a folder for each value of ``partition``, only where both gates are open; says whether it wrote."""
    if debug and allowed:
        write_documents(df, path, partition)
    return debug and allowed
