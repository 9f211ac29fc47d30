"""Harmonic packing of token sequences.

A piece of length n is in class j = capacity // n, so that j pieces of a class
always fit one sequence; every sequence takes j pieces of one class. Classes are
filled independently: a piece's place follows from its number within its class,
which each worker counts for itself and a small table of counts makes global.

Documents may be cut. The rest of a document after its full sequences is cut at
the next class's limit, capacity // (j + 1), while it would waste more than
`waste` of its share of a sequence. What is left at the end of each class, less
than one sequence each, is packed together by first-fit decreasing; its size
depends on the capacity alone, not on the input.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, byte_slices, staged
from quire.llm.plain_ids import word_encoder

PIECES = "doc_id long, part int, cls int, number long, start long, length int, doc_tokens long, ids array<int>"


def cut(total: int, capacity: int, waste: float = 0.02, least: int = 32) -> list[int]:
    """Lengths of a document's pieces; none but a document's last is shorter than `least`."""
    pieces = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        j = capacity // rest
        if rest < 2 * least or capacity // j - rest <= waste * (capacity // j):
            pieces.append(rest)
            break
        piece = min(capacity // (j + 1), rest - least)
        pieces.append(piece)
        rest -= piece
    return pieces


def cut_documents(documents: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Rows of PIECES: every document's ids, ended by `end_id`, in pieces numbered by class within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        part, numbers = TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], dtype="<i4")
        for batch, texts in byte_slices(batches, "text"):
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            values: list[np.ndarray] = []
            rows: list[tuple] = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = encoder.ids(text)
                values += [ids, end]
                total, start = len(ids) + 1, 0
                for length in cut(total, capacity):
                    cls = capacity // length
                    rows.append((doc_id, cls, numbers[cls], start, length, total))
                    numbers[cls] += 1
                    start += length
            doc, cls, number, start, length, total = zip(*rows, strict=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(values)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(cls, pa.int32()), pa.array(number, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(total, pa.int64()), lists],
                ["doc_id", "part", "cls", "number", "start", "length", "doc_tokens", "ids"],
            )

    return arrow_map(documents.select("doc_id", "text"), run, PIECES)


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """A bin for each length, by first-fit decreasing."""
    room: list[int] = []
    bins = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        bins[k] = next((b for b, free in enumerate(room) if free >= lengths[k]), len(room))
        if bins[k] == len(room):
            room.append(capacity)
        room[bins[k]] -= lengths[k]
    return bins


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with part, cls, number and length."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", "cls", (F.sum("n").over(Window.partitionBy("cls").orderBy("part")) - F.col("n")).alias("before"))
    # At most 2 * sqrt(capacity) classes, whatever the input.
    bases, full = {}, 0
    for cls, n in sorted(counts.groupBy("cls").agg(F.sum("n")).collect()):
        bases[cls] = (full, n // cls * cls)
        full += n // cls
    table = spark.createDataFrame([(c, b, t) for c, (b, t) in bases.items()] or [(0, 0, 0)], "cls int, base long, tail_from long")
    numbered = pieces.withColumn("piece", F.col("number")).join(before, ["part", "cls"]).join(F.broadcast(table), "cls").withColumn("number", F.col("before") + F.col("number"))
    # Fewer than j pieces of each class j: their number depends on the capacity alone.
    tail = numbered.filter(F.col("number") >= F.col("tail_from")).select("cls", "number", "length").collect()
    tail = sorted((t.cls, t.number, t.length) for t in tail)
    bins = first_fit([t[2] for t in tail], capacity)
    tails = spark.createDataFrame([(c, n, full + b) for (c, n, _), b in zip(tail, bins, strict=True)] or [(0, 0, 0)], "cls int, number long, tail_id long")
    placed = numbered.join(F.broadcast(tails), ["cls", "number"], "left").withColumn("sequence_id", F.coalesce("tail_id", F.col("base") + F.floor(F.col("number") / F.col("cls"))))
    order = Window.partitionBy("sequence_id").orderBy("cls", "number")
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long")).drop("before", "base", "tail_from", "tail_id")


def checked(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32, read from their ids, in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(7)
            offsets, values = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4", copy=False)
            checks = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(checks, pa.int64())], [*batch.schema.names[:7], "ids_crc32"])

    return arrow_map(pieces, run, PIECES.replace("ids array<int>", "ids_crc32 long"))


def pack(documents: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(layout, pieces): where each piece stands, and the stored pieces with their ids.

    layout has doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and the key of a piece: part, cls, piece; pieces has the ids by part, cls and
    number (the same as piece).
    A null or empty text is one piece with the end id. Repeated rows are packed
    as often as they occur; rows without a doc_id are packed too. A very long text
    is cut like any other. Other columns are ignored. No documents give no rows.
    """
    pieces = staged(cut_documents(documents, vocabulary, end_id, capacity), "pieces")
    layout = place(staged(checked(pieces), "layout"), capacity)
    columns = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "cls", "piece"]
    return layout.select(*columns), pieces


def sequences(layout: DataFrame, pieces: DataFrame, capacity: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (always `capacity` of them) and used, the ids before the padding."""
    stored = pieces.select("part", "cls", F.col("number").alias("piece"), "ids")
    rows = layout.join(stored, ["part", "cls", "piece"])
    # A sequence has at most `capacity` ids, so its pieces fit one row.
    ordered = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"), F.sum("length").alias("used"))
    ids = F.concat(F.flatten(F.transform("pieces", lambda p: p["ids"])), F.array_repeat(F.lit(pad_id), (F.lit(capacity) - F.col("used")).cast("int")))
    return ordered.select("sequence_id", ids.alias("ids"), "used")
