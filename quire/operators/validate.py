"""Validation as expressions and as rows of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import BLOCK_TYPES, CONTENT_TYPES, MAX_FILE_BYTES, ROLES, SAMPLE_BYTES
from quire.functions.text import extension, strip, strip_text


def error(code: str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))


def first_error(*checks: tuple[Column, Column]) -> Column:
    """The error of the first check that holds, else null."""
    return F.coalesce(*[F.when(condition, e) for condition, e in checks])


def range_ok(start: Column, end: Column) -> Column:
    return start.isNull() | end.isNull() | (end >= start)


def block_error(block_type: Column, text: Column, level: Column) -> Column:
    """A page break alone may be without text; headings alone have a level, from 1 to 6."""
    return first_error(
        (~F.coalesce(block_type, F.lit("")).isin(*BLOCK_TYPES), error("INVALID_BLOCK_TYPE", "unknown block type")),
        ((block_type != "page_break") & (F.coalesce(strip_text(text), F.lit("")) == ""), error("EMPTY_BLOCK_TEXT", "text is required")),
        ((block_type == "heading") & (level.isNull() | ~level.between(1, 6)), error("INVALID_HEADING_LEVEL", "headings need a level from 1 to 6")),
        ((block_type != "heading") & level.isNotNull(), error("UNEXPECTED_HEADING_LEVEL", "only headings have a level")),
    )


def location_error(**spans: tuple[Column, Column]) -> Column:
    """Of named spans (first, last) the first whose numbers are below 1 or turned round."""
    checks = []
    for name, (start, end) in spans.items():
        checks += [((start < 1) | (end < 1), error("INVALID_LOCATION", f"{name} numbers begin at 1")), (~range_ok(start, end), error("INVALID_LOCATION", f"{name} ends before it begins"))]
    return first_error(*checks)


def chunk_error(text: Column, token_count: Column, block_orders: Column) -> Column:
    """A chunk has text, at least one token, and at least one block that it comes from."""
    return first_error(
        (F.coalesce(strip_text(text), F.lit("")) == "", error("EMPTY_CHUNK_TEXT", "text is required")),
        (F.coalesce(token_count, F.lit(0)) < 1, error("INVALID_TOKEN_COUNT", "a chunk has at least one token")),
        (F.coalesce(F.size(block_orders), F.lit(0)) < 1, error("MISSING_SOURCE_BLOCKS", "a chunk comes from at least one block")),
    )


def documents_without_blocks(documents: DataFrame, blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents that no block belongs to; a parsed document has at least one."""
    return documents.join(blocks.select(key).distinct(), key, "left_anti")


def block_sets(blocks: DataFrame, document: str, block_id: str, order: str) -> DataFrame:
    """A row per document: its blocks, distinct ids, and whether orders are 0 to n - 1; code is null if it is sound."""
    stats = blocks.groupBy(document).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_distinct(block_id).alias("n_ids"),
        F.count_distinct(order).alias("n_orders"),
        F.min(order).cast("long").alias("min_order"),
        F.max(order).cast("long").alias("max_order"),
    )
    code = F.when(F.col("n_ids") < F.col("n_blocks"), "DUPLICATE_BLOCK_ID").when((F.col("min_order") != 0) | (F.col("max_order") != F.col("n_blocks") - 1) | (F.col("n_orders") < F.col("n_blocks")), "INVALID_BLOCK_ORDER")
    return stats.withColumn("code", code)


def sound_vector(vector: Column, dimensions: int | None = None) -> Column:
    sound = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return sound & (F.size(vector) == dimensions) if dimensions else sound


def message_error(role: Column, content: Column) -> Column:
    return first_error(
        (~F.coalesce(role, F.lit("")).isin(*ROLES), error("INVALID_ROLE", "unknown role")),
        (F.coalesce(strip(content), F.lit("")) == "", error("EMPTY_MESSAGE", "content is required")),
    )


def looks_binary(content: Column) -> Column:
    """A NUL among the first bytes, or over 30 % control bytes."""
    sample = F.substring(F.hex(F.substring(content, 1, SAMPLE_BYTES)), 1, 2 * SAMPLE_BYTES)
    pairs = F.regexp_extract_all(sample, F.lit("(..)"), 1)
    odd = F.filter(pairs, lambda p: (p < "20") & ~p.isin("07", "08", "09", "0A", "0C", "0D", "1B"))
    return F.array_contains(pairs, "00") | (F.size(odd) > 0.3 * F.size(pairs))


def content_type(content: Column, ext: Column) -> Column:
    """pdf, docx, pptx, xlsx, zip, binary, json, csv, markdown or text, from the bytes and the extension."""
    head = F.hex(F.substring(content, 1, 5))
    names = F.decode(content, "ISO-8859-1")
    # Entries of the zip directory: a mark, 42 bytes, the name.
    entries = F.regexp_extract_all(names, F.lit("(?s)PK\x01\x02.{42}([!-~]+?)(?=PK\x01\x02|PK\x05\x06|[^!-~]|$)"), 1)
    has = lambda start: F.exists(entries, lambda e: e.startswith(start))
    office = F.when(~has("[Content_Types].xml"), "zip").when(has("word/"), "docx").when(has("ppt/"), "pptx").when(has("xl/"), "xlsx").otherwise("zip")
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(names)
    plain = (
        F.when(ext == ".json", F.when(F.try_parse_json(text).isNotNull(), "json").otherwise("text"))
        .when(ext == ".csv", "csv")
        .when(ext.isin(".md", ".markdown"), "markdown")
        .otherwise("text")
    )
    return F.when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304"), office).when(looks_binary(content), "binary").otherwise(plain)


def check_files(files: DataFrame, allowed: tuple[str, ...] = tuple(CONTENT_TYPES), most: int = MAX_FILE_BYTES) -> DataFrame:
    """Files of the binaryFile source with ext, detected and error (null if sound); the first failing check counts."""
    ext = extension(F.col("path"))
    fits = F.lit(True)  # of an extension that a caller allows, any content
    for e, kinds in CONTENT_TYPES.items():
        fits = F.when(F.col("ext") == e, F.col("detected").isin(*kinds)).otherwise(fits)
    return (
        files.withColumn("ext", ext)
        .withColumn("detected", F.when((F.col("length") > 0) & (F.col("length") <= most), content_type(F.col("content"), F.col("ext"))))
        .withColumn(
            "error",
            first_error(
                (~F.col("ext").isin(*allowed), error("UNSUPPORTED_FILE_TYPE", "unsupported extension")),
                (F.col("length") == 0, error("EMPTY_FILE", "the file is empty")),
                (F.col("length") > most, error("FILE_TOO_LARGE", "the file is too large")),
                (~fits, error("FILE_CONTENT_TYPE_MISMATCH", "the content does not fit the extension")),
            ),
        )
    )


def collision_free(names: DataFrame, name: str, order: str) -> DataFrame:
    """Adds unique_name: later rows of a name get -2, -3 and so on before the extension."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    ext = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    bare = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return names.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(bare, F.lit("-"), n.cast("string"), ext)))
