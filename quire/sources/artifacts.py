"""Parsed and chunked documents as JSON files: a document a line, or (to read) an object or an array a file.

A document is one value: its file's size bounds it (`config.MAX_FILE_BYTES`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.schemas import TABLES

#: The names that the artifacts give to a block's places.
LOCATION = "page_number int, slide_number int, sheet_name string, json_path string, line_start int, line_end int, row_start int, row_end int, source_ref string"
BLOCK = f"block_type string, text string, `order` int, level int, parent_path array<string>, source_location struct<{LOCATION}>"
DOCUMENT = "id string, title string, file_name string, file_type string, source_path string, metadata string"
PARSED = f"{DOCUMENT}, blocks array<struct<{BLOCK}>>"
CHUNKED = f"document struct<{DOCUMENT}>, parent_chunks array<struct<{TABLES['parent_chunks']}>>, child_chunks array<struct<{TABLES['child_chunks']}>>"


def names(schema: str) -> list[str]:
    return [part.split()[0].strip("`") for part in schema.split(", ")]


def read_json(spark: SparkSession, paths: list[str], schema: str, whole: bool, key: str) -> DataFrame:
    """Documents of files with one a line, which are read in splits, or of `whole` files that are an object or an array of them.

    What is no JSON, or has no `key`, fails the query.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(whole).lower()).json(paths)
    missing = F.raise_error(f"a document without {key}").cast("boolean")
    return rows.filter(F.when(F.col(key).isNull(), missing).otherwise(True))


def read_parsed(spark: SparkSession, paths: list[str], whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks) of parsed documents; blocks have the columns that chunking takes, but for the document's own."""
    rows = read_json(spark, paths, PARSED, whole, "title")
    own = rows.withColumn("document_id", F.coalesce("id", F.sha2(F.concat_ws("|", "source_path", "file_name", "title", "file_type"), 256)))
    blocks = own.select("document_id", F.explode("blocks").alias("b"))
    places = [F.col(f"b.source_location.{n}").alias(n) for n in names(LOCATION)]
    path = F.coalesce("b.parent_path", F.array().cast("array<string>")).alias("parent_path")
    return own.drop("id", "blocks"), blocks.select("document_id", F.col("b.order").alias("block_order"), "b.block_type", F.coalesce("b.text", F.lit("")).alias("text"), "b.level", path, *places)


def parsed(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each document with its blocks in order; the shuffle is by document."""
    at = F.struct(*names(LOCATION)).alias("source_location")
    block = F.struct("block_type", "text", F.col("block_order").alias("order"), "level", "parent_path", at)
    grouped = blocks.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_order", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    empty = F.array().cast(f"array<struct<{BLOCK}>>")
    joined = documents.join(grouped, "document_id", "left").withColumn("blocks", F.coalesce(F.col("blocks").cast(f"array<struct<{BLOCK}>>"), empty))
    return joined.select(F.col("document_id").alias("id"), *names(DOCUMENT)[1:], "blocks")


def write_parsed(documents: DataFrame, blocks: DataFrame, path: str) -> None:
    """Parsed documents below a folder, one a line. `documents`: document_id and the fields of a document."""
    parsed(documents, blocks).write.mode("overwrite").json(path)


def write_chunked(documents: DataFrame, parents: DataFrame, children: DataFrame, path: str) -> None:
    """Documents with their parent and child chunks below a folder, one a line. All have the stored tables' columns."""

    def listed(rows: DataFrame, table: str, order: str) -> DataFrame:
        columns = rows.sparkSession.createDataFrame([], TABLES[table]).columns
        value = F.struct(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns]).cast(f"struct<{TABLES[table]}>")
        ordered = F.array_sort(F.collect_list(F.struct(order, value.alias("c"))))
        return rows.groupBy(F.col("document_id").alias("id")).agg(F.transform(ordered, lambda x: x["c"]).alias(table))

    both = documents.join(listed(parents, "parent_chunks", "parent_index"), "id", "left").join(listed(children, "child_chunks", "child_index"), "id", "left")
    both.select(F.struct(*names(DOCUMENT)).alias("document"), "parent_chunks", "child_chunks").write.mode("overwrite").json(path)


def read_chunked(spark: SparkSession, paths: list[str], whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, parents, children) of chunked documents, as `Store.index_documents` takes them once children are embedded."""
    rows = read_json(spark, paths, CHUNKED, whole, "document.id")
    of = lambda c: rows.select(F.explode(c).alias("c")).select("c.*")
    return rows.select("document.*"), of("parent_chunks"), of("child_chunks")
