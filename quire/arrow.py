"""Arrow batches of bounded size in Python tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.session import ship

#: Rows and bytes that Spark hands to a Python worker at once. Texts differ in
#: length by orders of magnitude, so the byte bound is the one that matters.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches within a worker's memory whatever the texts' lengths.

    Spark reads these settings when a plan runs, so they stay set in the session;
    lower ones of the caller's stay as they are.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{key}", None) or "") or 0)
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 3 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of rows whose texts together take about `limit` characters, with those texts (null: empty)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).to_pylist()
        start = size = 0
        texts: list = []
        for i, value in enumerate(values):
            value = value or ""
            if texts and size + len(value) > limit:
                yield batch.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(value)
            size += len(value)
        if texts:
            yield batch.slice(start), texts


#: Rows that leave a task at once.
ROWS_AT_ONCE = 4000


def row_batches(rows: Iterable[tuple], names: Sequence[str], kinds: Sequence[pa.DataType], most: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Record batches of `most` rows, so that a task holds no more of them as Python objects."""
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], list(names))
