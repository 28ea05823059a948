"""Sources: binary uploads, structured JSON, lenient JSON, HTML tables, page text, manifests; rejects come out beside what is accepted."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# --- fixed values -----------------------------------------------------------------------------------------------
MIME_BY_EXTENSION = {
    ".pdf": ["application/pdf"], ".png": ["image/png"], ".jpg": ["image/jpeg"], ".jpeg": ["image/jpeg"], ".webp": ["image/webp"], ".gif": ["image/gif"],
    ".bmp": ["image/bmp"], ".tif": ["image/tiff"], ".tiff": ["image/tiff"], ".json": ["application/json", "application/fhir+json"],
}
MIME_ALIASES = {"application/x-pdf": "application/pdf", "image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "image/x-png": "image/png", "image/x-bmp": "image/bmp", "image/x-tiff": "image/tiff"}
MAGIC = {"application/pdf": "25504446", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF"}
MAX_BYTES = 20 * 1024 * 1024
#: Files are hashed in blocks of this size.
BLOCK_BYTES = 1 << 20
ROW_TYPE = "struct<source_page:int,row_hash:string,raw_text:string,raw_analyte_label:string,raw_value_string:string,raw_unit_string:string,raw_reference_range:string,parsed_numeric_value:double,specimen_context:string,language_id:string>"


def uploads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files of a folder with filename, extension, checksum, lane and the reason to reject, if there is one. Contents stay out of the result."""
    return classify_uploads(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), max_bytes)


def sanitized(path: Column) -> Column:
    """The last part of a path, without NULs and outer spaces."""
    return F.trim(F.replace(F.regexp_extract(path, r"([^/\\]*)$", 1), F.lit("\x00"), F.lit("")))


def mime(c: Column) -> Column:
    """Lower case, aliases replaced."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MIME_ALIASES.items() for x in kv])[s], s)


def classify_uploads(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` has path, content, length and maybe mime_type."""
    name = sanitized(F.col("path"))
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    expected = F.create_map(*[x for k, v in MIME_BY_EXTENSION.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("extension")]
    given = mime(F.col("mime_type")) if "mime_type" in files.columns else F.get(expected, F.lit(0))
    magic = F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv])[F.col("mime_type")]
    head = F.hex(F.substring("content", 1, 8))
    out = files.withColumn("filename", name).withColumn("extension", extension).withColumn("mime_type", given)
    reject = (
        F.when(F.col("length") > max_bytes, "file_too_large")
        .when(F.col("filename") == "", "filename_missing")
        .when(expected.isNull(), F.concat(F.lit("unsupported_extension:"), F.coalesce(F.nullif(F.col("extension"), F.lit("")), F.lit("missing"))))
        .when(~F.array_contains(expected, F.col("mime_type")), F.concat(F.lit("mime_type_mismatch:"), "extension", F.lit(":"), F.coalesce(F.nullif(F.col("mime_type"), F.lit("")), F.lit("missing"))))
        .when(magic.isNotNull() & ~F.startswith(head, magic), F.concat(F.lit("magic_byte_mismatch:"), F.substring("extension", 2, 10)))
    )
    lane = F.when(F.col("extension") == ".json", "structured").when(F.col("extension") == ".pdf", "trusted_pdf").otherwise("image_beta")
    out = out.withColumn("reject", F.when(F.col("length") > max_bytes, "file_too_large").otherwise(reject)).withColumn("checksum", F.sha2("content", 256))
    return out.select("path", "filename", "extension", "mime_type", "length", "checksum", F.when(F.col("reject").isNull(), lane).alias("lane_type"), "reject")


def structured_rows(payloads: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Rows of ``{"observations": [...]}``, each with the first error found in it; a payload that isn't such an object gives one row with its error."""
    v = payloads.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("v"))
    items = F.expr("try_variant_get(v, '$.observations', 'array<variant>')")
    v = v.select("id", items.alias("items"), F.when(F.col("v").isNull(), "invalid_json").when(items.isNull(), "structured_observations_not_list").alias("error"))
    bad = v.where("error is not null").select("id", F.lit(-1).alias("index"), F.lit(None).cast(ROW_TYPE).alias("row"), "error")
    each = v.where("error is null").select("id", F.posexplode("items").alias("index", "o"))
    get = lambda name, kind: F.expr(f"try_variant_get(o, '$.{name}', '{kind}')")
    is_kind = lambda name, kind: F.expr(f"schema_of_variant(variant_get(o, '$.{name}', 'variant'))").isin(kind, "VOID") if isinstance(kind, str) else F.expr(f"schema_of_variant(variant_get(o, '$.{name}', 'variant'))").rlike("^(" + "|".join(kind) + ")")
    has = lambda name: F.expr(f"variant_get(o, '$.{name}', 'variant')").isNotNull()
    blank = lambda name: F.trim(F.coalesce(get(name, "string"), F.lit(""))) == ""
    number = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "VOID")
    missing = F.array_compact(F.array(*[F.when(~has(n), F.lit(n)) for n in ("source_page", "row_hash", "raw_analyte_label")]))
    at = lambda code: F.concat(F.lit(code + ":"), F.col("index").cast("string"))
    error = (
        F.when(~F.expr("schema_of_variant(o)").startswith("OBJECT"), at("structured_observation_not_object"))
        .when(F.size(missing) > 0, F.concat(at("structured_observation_missing_fields"), F.lit(":"), F.array_join(missing, ",")))
        .when(~is_kind("source_page", ("BIGINT", "INT")) | (F.coalesce(get("source_page", "int"), F.lit(0)) < 1), at("structured_observation_invalid_source_page"))
        .when(~is_kind("row_hash", "STRING") | blank("row_hash"), at("structured_observation_invalid_row_hash"))
        .when(~is_kind("raw_analyte_label", "STRING") | blank("raw_analyte_label"), at("structured_observation_invalid_analyte_label"))
        .when(has("raw_value_string") & ~is_kind("raw_value_string", "STRING"), at("structured_observation_invalid_raw_value_type"))
        .when(has("raw_unit_string") & ~is_kind("raw_unit_string", "STRING"), at("structured_observation_invalid_raw_unit_type"))
        .when(has("parsed_numeric_value") & ~is_kind("parsed_numeric_value", number), at("structured_observation_invalid_parsed_numeric_value"))
    )
    fields = [get(f.name, f.dataType.simpleString()).alias(f.name) for f in T._parse_datatype_string(ROW_TYPE).fields]
    return each.select("id", "index", F.struct(*fields).alias("row"), error.alias("error")).unionByName(bad)


def lenient_objects(texts: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """Objects out of JSON that may be damaged: as it stands, without fences and trailing commas, or at last every flat object that bears ``key``.

    Comes out as id, how (strict, repaired, harvested, lost), objects array<string>.
    """
    raw = F.col(text_col)
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"```\s*$", ""), r",\s*([}\]])", "$1")
    pieces = F.filter(F.regexp_extract_all(cleaned, F.lit(r"(?s)(\{[^{}]*?\"" + key + r"\"[^{}]*?\})"), F.lit(1)), lambda p: F.try_parse_json(p).isNotNull())
    rows = lambda j: F.coalesce(F.transform(F.expr(f"try_variant_get(try_parse_json({j}), '$.rows', 'array<variant>')"), lambda x: F.to_json(x)), F.array(F.to_json(F.expr(f"try_parse_json({j})"))))
    t = texts.select(F.col(id_col).alias("id"), raw.alias("raw"), cleaned.alias("cleaned"), pieces.alias("pieces"))
    ok = lambda c: F.try_parse_json(c).isNotNull()
    how = F.when(ok("raw"), "strict").when(ok("cleaned"), "repaired").when(F.size("pieces") > 0, "harvested").otherwise("lost")
    objects = F.when(ok("raw"), rows("raw")).when(ok("cleaned"), rows("cleaned")).when(F.size("pieces") > 0, F.col("pieces")).otherwise(F.array().cast("array<string>"))
    return t.select("id", how.alias("how"), objects.alias("objects"))


def html_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The first four cells of tables with at least four, as a row."""
    cells = F.regexp_extract_all(html_col, F.lit(r"<td>(.*?)</td>"), F.lit(1))
    c = pages.select(F.col(id_col).alias("id"), cells.alias("c")).where("size(c) >= 4")
    names = ["raw_analyte_label", "raw_value_string", "raw_unit_string", "raw_reference_range"]
    return c.select("id", F.array_join(F.slice("c", 1, 4), " ").alias("raw_text"), *[F.col("c")[i].alias(n) for i, n in enumerate(names)])


def text_lines(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of page texts with their place, trimmed, blank ones left out."""
    lines = pages.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return lines.select("id", "line_no", F.trim("line").alias("line")).where("line <> ''")


def _opened(path: str):
    """A file by the path that binaryFile gives it, as a stream of bytes."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    from urllib.parse import quote

    from pyarrow import fs

    there, at = fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe=":/@"))
    return there.open_input_stream(at)


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (path) -> (path, checksum). Files are read in blocks, so their size doesn't matter."""
    for batch in batches:
        sums = []
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as f:
                while block := f.read(BLOCK_BYTES):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], ["path", "checksum"])


def manifest(files: DataFrame) -> DataFrame:
    """path, tier (the folder), checksum and kind of every file, whatever its size; of ``files`` only the path is read."""
    hashed = files.select("path").mapInArrow(_hash_files, "path string, checksum string")
    return hashed.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("tier"), "checksum", F.when(F.lower("path").endswith(".pdf"), "pdf").otherwise("metadata").alias("kind"))


def json_dimension(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """A dimension kept as JSON, read with its schema; lines that aren't JSON of it fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)
