"""Tables as logged changes in Parquet files.

A commit adds one small file to the log: the folders of rows it appends and the
keys whose earlier rows it drops, for any number of tables at once. Nothing is
rewritten but by `compact`, which puts a table's rows into one folder again and
starts by itself when a table has COMPACT folders; see `quire.log` for how commits
stay apart.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.log import Change, ConflictError, Log, Snapshot
from quire.schemas import TABLES

__all__ = ["Change", "ChunkIndex", "ConflictError", "Store"]
INDEX = ("documents", "parent_chunks", "child_chunks")
#: Folders of rows or drops that a table has before it is compacted.
COMPACT = 48
Result = TypeVar("Result")


def kept(old: DataFrame, new: DataFrame, keys: list[str], keep: dict[str, str] | None = None) -> DataFrame:
    """The new rows, with the old row's value where there is one in the columns of `keep`."""
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        new = new.join(before, keys, "left")
        for c in keep:
            new = new.withColumn(c, F.coalesce(F.col(f"_old_{c}"), F.col(c))).drop(f"_old_{c}")
    return new


class ChunkIndex(Protocol):
    """What ingestion needs of an index: `Store`, or a caller's own."""

    spark: SparkSession
    root: str

    def read(self, table: str) -> DataFrame: ...

    def upsert(self, table: str, rows: DataFrame, keys: list[str], keep: dict[str, str] | None = None) -> None: ...

    def index_documents(self, documents: DataFrame, parents: DataFrame, children: DataFrame, replace: bool = True) -> None: ...

    def clear(self, tables: tuple[str, ...] = INDEX) -> None: ...

    def stats(self) -> dict[str, int]: ...


class Store:
    """Tables under one folder: those of the index, or others by their schemas."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] | None = None):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), tables or TABLES
        self.log = Log(spark, f"{self.root}/_log")
        #: How tables with a layout of their own are compacted.
        self.compactors: dict[str, Callable[[], None]] = {}

    # commits

    def state(self) -> Snapshot:
        return self.log.state()

    def commit(self, change: Change) -> int:
        """Log the change; a table that has many folders then is compacted."""
        version = self.log.commit(change)
        tables = {a["table"] for a in change.actions if a["kind"] in ("rows", "drop")}
        for table in sorted(t for t in tables if len(self.state().actions(t)) >= COMPACT):
            self.compact(table)
        return version

    def attempt(self, work: Callable[[Snapshot, Change], Result], tries: int = 50) -> Result:
        """Work out a change from a state and commit it; from a newer state if another commit touched its keys meanwhile."""
        for k in range(tries):
            state = self.state()
            change = Change(read=state.version)
            result = work(state, change)
            try:
                if change.actions:
                    self.commit(change)
                return result
            except ConflictError:
                time.sleep(min(1.0, 0.02 * k))
        raise ConflictError(f"no commit in {tries} tries")

    def saved(self, table: str, rows: DataFrame, kind: str = "rows") -> str:
        path = f"{self.root}/{table}/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    # tables

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(self.schemas[table])

    def read(self, table: str, at: Snapshot | None = None) -> DataFrame:
        """The table's rows as of now, or of a state. Drops are joined with the rows they may concern; a compacted table is a plain scan."""
        schema, entries = self.schema(table), (at or self.state()).actions(table)
        parts = [e for e in entries if e["kind"] in ("rows", "base") and e["path"]]
        if not parts:
            return self.spark.createDataFrame([], schema)
        if not any(e["kind"] == "drop" for e in entries):
            return self.spark.read.schema(schema).parquet(*[p["path"] for p in parts])
        return self.alive(self.versioned(schema, parts), table, entries).drop("_version").select(*schema.names)

    def alive(self, rows: DataFrame, table: str, entries: list[dict], **named: str) -> DataFrame:
        """Rows with a `_version` without those that a later commit dropped; `named` gives the columns that hold a key of another name."""
        drops = [e for e in entries if e["kind"] == "drop"]
        for key in sorted({d["key"] for d in drops}):
            column = named.get(key, key)
            kind = T.StructType([T.StructField(key, self.schema(table)[key].dataType)]) if key in self.schema(table).names else T.StructType.fromDDL(f"{key} string")
            gone = self.versioned(kind, [d for d in drops if d["key"] == key]).groupBy(F.col(key).alias(column)).agg(F.max("_version").alias("_gone"))
            # A commit's own rows come after its drops. A base stands for its last version.
            rows = rows.join(gone, column, "left").filter(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_version"))).drop("_gone")
        return rows

    def versioned(self, schema: T.StructType, entries: list[dict], paths: list[str] | None = None) -> DataFrame:
        """The rows of several folders, in one scan, with the name and version of each (`_folder`, `_version`); `paths` are the parts of the folders to read, all by default."""
        of_folder = F.create_map(*[F.lit(x) for e in entries for x in (e["path"].rsplit("/", 1)[1], e["version"])])
        folder = F.regexp_extract("_metadata.file_path", "/((?:rows|base|drop)-[0-9a-f]{32})/", 1)
        rows = self.spark.read.schema(schema).parquet(*(paths or [e["path"] for e in entries]))
        return rows.withColumn("_folder", folder).withColumn("_version", F.element_at(of_folder, F.col("_folder")).cast("long"))

    def append(self, table: str, rows: DataFrame) -> None:
        change = Change()
        change.rows(table, self.saved(table, aligned(rows, self.read_schema(table))))
        self.commit(change)

    def read_schema(self, table: str) -> list[str]:
        return self.schema(table).names

    def upsert(self, table: str, rows: DataFrame, keys: list[str], keep: dict[str, str] | None = None) -> None:
        """Rows in place of those of the same key."""
        change = Change()
        self.put(change, table, rows, keys[0], keep)
        self.commit(change)

    def put(self, change: Change, table: str, rows: DataFrame, key: str, keep: dict[str, str] | None = None, at: Snapshot | None = None) -> None:
        """Add to a change: rows in place of those of the same key."""
        path = self.saved(table, aligned(kept(self.read(table, at), rows, [key], keep) if keep else rows, self.read_schema(table)))
        written = self.spark.read.schema(self.schema(table)).parquet(path)
        change.drop(table, key, self.saved(table, written.select(key).distinct(), "drop"))
        change.rows(table, path)

    def delete(self, table: str, key: str, values: DataFrame) -> None:
        """Drop the rows whose `key` is among the values (a column of that name)."""
        change = Change()
        kind = self.schema(table)[key].dataType if key in self.schema(table).names else T.StringType()
        change.drop(table, key, self.saved(table, values.select(F.col(key).cast(kind)).distinct(), "drop"))
        self.commit(change)

    def compact(self, table: str) -> None:
        """Put the table's rows into one folder. They are read as of one version, and the folder stands for that; changes committed meanwhile come after it."""
        if table in self.compactors:
            return self.compactors[table]()
        state = self.state()
        change, marks = Change(), [e["units"] for e in state.actions(table) if "units" in e]
        change.base(table, self.saved(table, self.read(table, state), "base"), state.version, **({"units": max(marks)} if marks else {}))
        self.log.commit(change)

    # the index

    def index_documents(self, documents: DataFrame, parents: DataFrame, children: DataFrame, replace: bool = True) -> None:
        """Upsert documents with their chunks in one commit; `replace` first drops all chunks of these documents, else stale ones stay."""
        self.commit(self.index_change(documents, parents, children, replace))

    def index_change(self, documents: DataFrame, parents: DataFrame, children: DataFrame, replace: bool = True) -> Change:
        change = Change()
        self.put(change, "documents", documents, "id", None if replace else {"created_at": "created_at"})
        ids = self.spark.read.schema(self.schema("documents")).parquet(change.actions[-1]["path"]).select(F.col("id").alias("document_id"))
        for table, rows in (("parent_chunks", parents), ("child_chunks", children)):
            if replace:
                change.drop(table, "document_id", self.saved(table, ids, "drop"))
            self.put(change, table, rows, "id")
        return change

    def delete_document(self, document_id: str) -> bool:
        """Drop a document and its chunks; whether it was there."""
        there = not self.read("documents").filter(F.col("id") == document_id).isEmpty()
        if there:
            self.commit(self.delete_change(document_id))
        return there

    def delete_change(self, document_id: str) -> Change:
        change = Change()
        for table, key in zip(INDEX, ("id", "document_id", "document_id"), strict=True):
            change.drop(table, key, self.saved(table, self.spark.createDataFrame([(document_id,)], f"{key} string"), "drop"))
        return change

    def clear(self, tables: tuple[str, ...] = INDEX) -> None:
        """Empty the index's tables, or those given; its settings stay."""
        change = Change()
        for table in tables:
            change.base(table, None)
        self.commit(change)

    def reset(self, sure: bool = False) -> None:
        """Empty every table, settings and records too."""
        if not sure:
            raise ValueError("a reset empties all tables: call it with sure=True")
        self.clear(tuple(self.schemas))

    def initialise(self) -> list[str]:
        """Make the tables that are missing, empty, in one commit; their names. Of two that do so at once one makes them."""

        def work(state: Snapshot, change: Change) -> list[str]:
            missing = [t for t in self.schemas if t not in state.tables]
            if missing:
                change.touch("_schema", "tables")
            for table in missing:
                change.base(table, None, 0)  # stands for no commit: rows that come in meanwhile stay
            return missing

        return self.attempt(work)

    def stats(self) -> dict[str, int]:
        """Rows of the index's tables."""
        return {table: self.read(table).count() for table in INDEX}

    def health(self) -> dict:
        """Whether the store answers, and what its tables lack; it never raises."""
        try:
            missing = self.missing_tables()
            return {"ok": True, "initialised": not set(INDEX) & set(missing), "missing_tables": missing, "error": None}
        except Exception as e:
            return {"ok": False, "initialised": False, "missing_tables": [], "error": f"{type(e).__name__}: {e}"[:500]}

    def missing_tables(self) -> list[str]:
        """Tables of the schema that have never been written."""
        known = self.state().tables
        return [t for t in self.schemas if t not in known]


def aligned(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*columns)
