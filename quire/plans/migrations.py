"""Changes of the catalogue's schema from numbered SQL files, each applied once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import base_name
from quire.store import Store


def present(store: Store, folder: str) -> DataFrame:
    """version, name, checksum and sql of a folder's *.sql files; a version is what stands before a name's first underscore."""
    files = store.spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").load(folder)
    name = base_name(F.col("path"))
    version = F.substring_index(F.regexp_replace(name, r"\.sql$", ""), "_", 1)
    return files.select(version.alias("version"), name.alias("name"), F.sha2("content", 256).alias("checksum"), F.col("content").cast("string").alias("sql"))


def pending(found: DataFrame, applied: DataFrame) -> DataFrame:
    """Those found that are not applied, by version."""
    return found.join(applied.select("version"), "version", "left_anti")


def changed(found: DataFrame, applied: DataFrame) -> DataFrame:
    """Those applied whose file is another one now."""
    return found.join(applied.select("version", F.col("checksum").alias("applied_checksum")), "version").filter("checksum <> applied_checksum")


def apply(store: Store, folder: str) -> list[str]:
    """Run what is pending, in the order of names; the versions that ran.

    Nothing runs if an applied file has changed. Spark has no transactions over statements:
    each file is recorded when its last one is done, so files should bear being run again.
    """
    try:
        found = present(store, folder)
    except AnalysisException:
        raise LookupError(f"MIGRATION_DIRECTORY_NOT_FOUND: {folder}") from None
    applied = store.read("schema_migrations")
    other = changed(found, applied).select("name").first()
    if other:
        raise ValueError(f"MIGRATION_CHECKSUM_MISMATCH: {other.name}")
    done = []
    for row in pending(found, applied).orderBy("name").collect():  # a handful of small files
        for statement in statements(row.sql):
            store.spark.sql(statement)
        record = store.spark.createDataFrame([(row.version, row.name, row.checksum)], "version string, name string, checksum string")
        store.append("schema_migrations", record.withColumn("applied_at", F.current_timestamp()))
        done.append(row.version)
    return done


def statements(sql: str) -> list[str]:
    """Statements end with a semicolon at the end of a line; lines of comments go."""
    rows = [line.rstrip() for line in sql.splitlines() if line.strip() and not line.lstrip().startswith("--")]
    out, own = [], []
    for row in rows:
        own.append(row.removesuffix(";"))
        if row.endswith(";"):
            out.append("\n".join(own))
            own = []
    return [s for s in [*out, "\n".join(own)] if s.strip()]
