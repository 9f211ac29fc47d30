"""Token ids in Parquet list columns, in the order of the documents.

Layout: `tokens` is a list column, dictionary-encoded while its page dictionary
fits, in row groups of a set size whose pages are indexed by Spark's writer, so
that a reader can take the small columns alone or a few documents' tokens. Each
row also holds its writer's number (`part`) and the ids before it in that part
(`part_start`): a document's global start needs no pass over the tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, byte_slices, staged
from quire.llm.plain_ids import byte_encoder

ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 2000
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"


def vocabulary(name: str) -> tuple[str, str, str]:
    """The library's file of a byte-level vocabulary, the same as a rank file, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def tokenize(documents: DataFrame, files: tuple[str, str, str], end_id: int) -> DataFrame:
    """Rows of SCHEMA, one per document, each ended by `end_id`. Rows keep their order within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(*files)
        part, at = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<i4")
        for batch, texts in byte_slices(batches, "text"):
            packed = [ids for text in texts for ids in (encoder.ids(text), end)]
            sizes = np.array([len(p) + 1 for p in packed[::2]], dtype=np.int64)
            ends = np.cumsum(sizes)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(packed)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.full(len(texts), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), tokens],
                ["doc_id", "part", "part_start", "n_tokens", "tokens"],
            )
            at += int(ends[-1])

    return arrow_map(documents.select("doc_id", "text"), run, SCHEMA)


def write_token_files(documents: DataFrame, files: tuple[str, str, str], end_id: int) -> DataFrame:
    """Write the token files in ascending doc_id order (null ids first, equal ids by the text's hash) and return them as read back.

    Texts are dealt out by ranges of doc_id, so each file holds a range; a null
    text counts as empty and has the end id alone. Repeated rows are written as
    often as they occur, and dealt out by a number of their own, so that a doc_id
    with very many of them is no hot range. Other columns are ignored; a very long
    text is one row; an empty table gives files without rows.
    """
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = documents.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    options = {"parquet__block__size": ROW_GROUP_BYTES, "parquet__page__row__count__limit": PAGE_ROWS, "parquet__enable__dictionary": "true"}
    return staged(tokenize(ordered, files, end_id), "tokens", **options)


def part_starts(files: DataFrame) -> DataFrame:
    """part and base, the ids in all parts before it; one row per writer, from the small columns alone."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            offsets = np.asarray(tokens.offsets)
            values = np.asarray(tokens.values).astype("<u4", copy=False)
            checks = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(checks, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    # Two numbers for each writing task are broadcast: 16 MB for a million tasks.
    rows = arrow_map(files.select("doc_id", "part", "part_start", "tokens"), run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(part_starts(files)), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
