"""From files to stored chunks."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import Chunking
from quire.functions.ids import document_id
from quire.functions.text import base_name, clean_metadata, preview, stem, token_count
from quire.operators.admin import index_stats
from quire.operators.chunking import children_of, chunk, folded, parents_of, with_structure
from quire.operators.embeddings import Provider, check_model, embed_column
from quire.operators.normalize import normalize_blocks
from quire.operators.retrieval import norm
from quire.operators.validate import check_files
from quire.plans import records
from quire.sources.files import discover
from quire.sources.registry import Registry, blocks_of_parts, default_registry, parse_files, titles_of_parts
from quire.store import ChunkIndex, Store

#: The columns of a block, whatever its source; those a source does not have are null.
COLUMNS = {
    "document_id": "string", "block_order": "int", "block_type": "string", "text": "string", "level": "int", "parent_path": "array<string>",
    "page_number": "int", "slide_number": "int", "sheet_name": "string", "json_path": "string", "line_start": "int", "line_end": "int",
    "row_start": "int", "row_end": "int", "source_ref": "string", "table_rows": "int", "table_columns": "int",
}


def aligned(rows: DataFrame, **given: str) -> DataFrame:
    """Rows with the columns of a block; `given` names other columns that take a block column's place."""
    have = set(rows.columns)
    empty = F.array().cast("array<string>")
    pick = lambda c, t: F.col(given[c]) if c in given else F.col(c) if c in have else empty if c == "parent_path" else F.lit(None)
    return rows.select(*[pick(c, t).cast(t).alias(c) for c, t in COLUMNS.items()])


def checked(files: DataFrame, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(sound files with their document columns, failures with path, code and message)."""
    types = (registry or default_registry()).types
    rows = check_files(files.filter(~base_name(F.col("path")).startswith("~$")), tuple(types))
    kind = F.lit(None).cast("string")
    for e, t in types.items():
        kind = F.when(F.col("ext") == e, F.lit(t)).otherwise(kind)
    named = rows.withColumn("file_name", base_name(F.col("path"))).withColumn("file_type", kind).withColumn("title", stem(F.col("path")))
    sound = named.filter("error IS NULL").withColumn("document_id", document_id(F.col("path"), F.col("file_name"), F.col("title"), F.col("file_type")))
    return sound, named.filter("error IS NOT NULL").select("path", "error.code", "error.message")


def failures_of(parts: DataFrame, sound: DataFrame) -> DataFrame:
    """path, code and message of the files that no parser could read."""
    typed = F.col("error").startswith("PDF_") | (F.col("error") == "NO_PARSER")
    coded = parts.filter("error IS NOT NULL").select("document_id", F.when(typed, F.col("error")).otherwise("PARSE_FAILED").alias("code"), F.col("error").alias("message"))
    return coded.join(sound.select("document_id", "path"), "document_id").select("path", "code", "message")


def kept(store: ChunkIndex, rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once below the store's folder: what follows reads them as often as it needs to."""
    path = f"{store.root}/_work/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return store.spark.read.schema(rows.schema).parquet(path)


def ingest(
    files: DataFrame,
    store: ChunkIndex,
    provider: Provider,
    config: Chunking | None = None,
    replace: bool = True,
    normalize: Callable[[DataFrame], DataFrame] = normalize_blocks,
    progress: Callable[[str, str, float | None], None] | None = None,
    recorder: Callable[[str, int, int], None] | None = None,
    counter: Callable[[Column], Column] = token_count,
    grouper: Callable[[DataFrame], DataFrame] = with_structure,
    registry: Registry | None = None,
) -> dict[str, int]:
    """Check, parse, chunk, embed and store files (of the binaryFile source); failures are kept apart and counted.

    One pass gives each file to its parser in the registry. What it finds, and the chunks, are each
    written once below the store's folder, so no step runs twice. `normalize`, `counter` and `grouper` may be replaced. `progress` is told each stage, its status, and
    at its end the milliseconds it took; `recorder` each file type with its parsed documents and blocks.
    """
    check_model(store.spark, store.read("index_metadata"), provider)
    began = [time.perf_counter()]

    def tell(stage: str, status: str) -> None:
        if progress:
            progress(stage, status, round((time.perf_counter() - began[0]) * 1000, 3) if status == "completed" else None)
        if status == "started":
            began[0] = time.perf_counter()

    tell("parse", "started")
    sound, refused = checked(files, registry)
    about = ["document_id", "path", "file_name", "file_type", "title", "length"]
    # The files' bytes are read for the checks and the parsers; what follows needs them no longer.
    found = kept(store, parse_files(sound, registry), "parts")
    listed = kept(store, sound.select(*about), "sound")
    blocks = kept(store, blocks_of_parts(found, COLUMNS), "blocks")
    failures = kept(store, refused.union(failures_of(found, listed)), "failures")
    titled = listed.withColumnRenamed("path", "source_path").join(titles_of_parts(found), "document_id", "left")
    named = titled.withColumn("title", F.coalesce("own_title", "title")).drop("own_title")
    tell("parse", "completed")
    if recorder:
        per_type = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).join(named.select("document_id", "file_type"), "document_id").groupBy("file_type")
        for r in per_type.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("blocks")).orderBy("file_type").collect():
            recorder(r["file_type"], r["documents"], r["blocks"])
    tell("chunk", "started")
    normal = kept(store, normalize(blocks), "normal")
    counts = normal.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"))
    front = found.filter("block_type = 'front_matter'").select("document_id", F.col("text").alias("front"), "line_end")
    about = clean_metadata(F.create_map(F.lit("parser"), F.col("file_type"), F.lit("size_bytes"), F.col("length").cast("string"), F.lit("block_count"), F.col("blocks").cast("string")))
    # Front matter is part of the metadata, as it is nested.
    more = F.concat(F.lit(',"front_matter":'), F.col("front"), F.lit(',"front_matter_source":{"line_start":1,"line_end":'), F.col("line_end").cast("string"), F.lit("}}"))
    metadata = F.when(F.col("front").isNull(), F.to_json(about)).otherwise(F.concat(F.regexp_replace(F.to_json(about), r"\}$", ""), more))
    documents = named.join(counts, "document_id").join(front, "document_id", "left").select(
        F.col("document_id").alias("id"), "title", "file_name", "file_type", "source_path", metadata.alias("metadata"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )
    config = config or Chunking()
    rows = kept(store, folded(normal.join(named.drop("length"), "document_id"), config, counter, grouper), "folded")
    parents, children = kept(store, parents_of(rows, config, counter), "parents"), kept(store, children_of(rows, config, counter), "children")
    tell("chunk", "completed")
    tell("index", "started")
    store.index_documents(documents, parents, embed_column(children, provider), replace)
    settings = [("embedding_model", provider.name), ("embedding_dimensions", str(provider.dimensions)), ("schema_version", "1")]
    store.upsert("index_metadata", store.spark.createDataFrame(settings, "key string, value string"), ["key"])
    tell("index", "completed")
    return {"failures": failures.count(), "documents": store.read("documents").count(), "children": store.read("child_chunks").count()}


def reindex(store: Store, provider: Provider, document_id: str, config: Chunking | None = None) -> dict[str, int]:
    """Ingest one stored document's file again, in place of what is stored of it."""
    row = store.read("documents").filter(F.col("id") == document_id).select("source_path").first()
    if row is None:
        raise LookupError(f"no document {document_id}")
    return ingest(store.spark.read.format("binaryFile").load(row["source_path"]), store, provider, config)


def run_job(store: Store, provider: Provider, job_id: str, claimed: bool = False) -> str:
    """Run a queued job, or one that the caller has claimed: its files, with an event for each stage; a failure becomes the job's. Its status at the end."""
    request = json.loads(records.jobs(store).filter(F.col("job_id") == job_id).first()["request"])
    if not claimed:
        records.emit(store, job_id, "job", "running")
    try:
        found = discover(store.spark, request["paths"], recursive=True)
        done = ingest(found, store, provider, replace=request["replace"], progress=lambda stage, status, ms: records.emit(store, job_id, stage, status, "", ms))
        records.emit(store, job_id, "job", "completed", json.dumps(done))
    except Exception as e:
        records.emit(store, job_id, "job", "failed", f"{getattr(e, 'code', type(e).__name__)}: {e}"[:2000])
    return records.job_status(store, job_id)[0]


def run_next_job(store: Store, provider: Provider) -> str | None:
    """Claim the oldest queued job and run it; its id, or null if none is queued."""
    job_id = records.claim(store)
    if job_id is not None:
        run_job(store, provider, job_id, claimed=True)
    return job_id


def work_queue(store: Store, provider: Provider, poll_seconds: float = 2.0, stop: Callable[[], bool] = lambda: False, once: bool = False) -> int:
    """Run queued jobs one after the other, any number of workers at a time; the number this one ran. With `once` it ends when none is queued."""
    done = 0
    while not stop():
        if run_next_job(store, provider) is not None:
            done += 1
        elif once:
            break
        else:
            time.sleep(poll_seconds)
    return done


def submit(store: Store, provider: Provider, paths: list[str], replace: bool = True, worker: bool | None = None) -> str:
    """Queue a job and run it here and now, unless a worker does (by default as QUIRE_INGEST_MODE=worker says)."""
    job_id = records.create_job(store, paths, replace)
    if not (os.environ.get("QUIRE_INGEST_MODE", "").strip().lower() == "worker" if worker is None else worker):
        run_job(store, provider, job_id)
    return job_id


#: Rows that a probe shows, and chunks that it embeds.
PREVIEW_ROWS, EMBEDDED = 5, 3


def probe(files: DataFrame, stage: str, provider: Provider, store: Store | None = None, config: Chunking | None = None) -> DataFrame:
    """What the pipeline makes of files up to a stage: validate, parse, chunk, embed or index. Nothing is written.

    Only the stages before it are part of the plan; parse and chunk show the first
    rows, embed the first few chunks' vectors, index the counts of the index
    beside those of the files.
    """
    rows = check_files(files)
    if stage == "validate":
        return rows.select(base_name(F.col("path")).alias("file_name"), "ext", "length", "detected", "error.code", "error.message")
    sound, _ = checked(files)
    blocks = normalize_blocks(blocks_of_parts(parse_files(sound), COLUMNS))
    if stage == "parse":
        return blocks.orderBy("document_id", "block_order").limit(PREVIEW_ROWS).select("document_id", "block_order", "block_type", preview(F.col("text")).alias("text"), "parent_path", "source_ref")
    named = sound.select("document_id", "title", "file_name", "file_type", F.col("path").alias("source_path"))
    parents, children = chunk(blocks.join(named, "document_id"), config)
    first = children.orderBy("document_id", "child_index")
    if stage == "chunk":
        return first.limit(PREVIEW_ROWS).select("id", "parent_chunk_id", "token_count", "parent_path", "source_refs", preview(F.col("text")).alias("text"))
    vectors = embed_column(first.limit(EMBEDDED), provider)
    if stage == "embed":
        values = F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x, 6))
        return vectors.select("id", preview(F.col("text"), 220).alias("text"), F.size("embedding").alias("dimensions"), F.round(norm(F.col("embedding")), 6).alias("l2_norm"), values.alias("first_values"))
    if stage != "index" or store is None:
        raise ValueError("stages are validate, parse, chunk, embed, and index with a store")
    stored = {f"index_{t}": store.read(t) for t in ("documents", "parent_chunks", "child_chunks")}
    return index_stats(candidate_parents=parents, candidate_children=children, **stored)
