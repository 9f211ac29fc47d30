"""Structure-aware parent and child chunks from blocks.

Input: one row per block with document_id, title, file_name, file_type,
source_path, block_order, block_type, text, parent_path (array), page_number,
slide_number, sheet_name, json_path, source_ref. A document's groups, segments
and chunks stay within its own rows: the only shuffle is by document_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.arrow import arrow_map
from quire.config import Chunking
from quire.functions.ids import json_parent_path, stable_id
from quire.functions.text import strip, token_count, tokens, windows_of
from quire.session import ship

EMPTY = "array<string>"


def heading_path() -> Column:
    own = F.coalesce(F.col("parent_path"), F.array().cast(EMPTY))
    return F.when(F.col("block_type") == "heading", F.concat(own, F.array("text"))).otherwise(own)


def with_structure(blocks: DataFrame) -> DataFrame:
    """Adds group_key, group_path and structure: headings first, then page, slide, sheet, JSON path, CSV rows, the document."""
    path = heading_path()
    json_path = json_parent_path(F.col("json_path"))

    def case(key: Column, titles: Column, kind: str) -> Column:
        return F.struct(key.alias("key"), titles.alias("path"), F.lit(kind).alias("kind"))

    def titled(prefix: str, name: str, column: str, kind: str) -> Column:
        text = F.col(column).cast("string")
        return F.when(F.col(column).isNotNull(), case(F.concat(F.lit(prefix), text), F.array(F.concat(F.lit(name), text)), kind))

    own = F.array(F.col("title"))
    found = F.coalesce(
        F.when(F.size(path) > 0, case(F.concat(F.lit("heading:"), F.array_join(path, " > ")), path, "heading_path")),
        titled("page:", "Page ", "page_number", "page"),
        titled("slide:", "Slide ", "slide_number", "slide"),
        titled("sheet:", "", "sheet_name", "sheet"),
        F.when(F.col("json_path").isNotNull(), case(F.concat(F.lit("json:"), F.array_join(json_path, " > ")), json_path, "json_path")),
        F.when(F.col("file_type") == "csv", case(F.lit("csv:rows"), own, "csv_rows")),
        case(F.lit("document:root"), own, "document_root"),
    )
    return blocks.withColumn("_s", found).select("*", F.col("_s.key").alias("group_key"), F.col("_s.path").alias("group_path"), F.col("_s.kind").alias("structure")).drop("_s")


def islands(rows: DataFrame, partition: list[str], order: list[str], key: str, name: str = "island") -> DataFrame:
    """Numbers the runs of equal keys in order, from 0; a null key equals a null key."""
    w = Window.partitionBy(*partition).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = F.when(first | ~F.col(key).eqNullSafe(F.lag(key).over(w)), 1).otherwise(0)
    flagged = rows.withColumn("_changed", changed)
    return flagged.withColumn(name, (F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_changed")


def pack_ranges(sizes: list[int], target: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Greedy packing of sizes in order: (first, last) of each bin, from 0.

    A bin closes before the segment that would take it over `target`. The next
    one begins with the trailing segments of at most `overlap` together, unless
    the new segment would not fit with them. A segment over `target` stands alone.
    """
    done: list[tuple[int, int]] = []
    first = used = 0
    for i, size in enumerate(sizes):
        if i > first and used + size > target:
            done.append((first, i - 1))
            first, used = i, 0
            while first > done[-1][0] and used + sizes[first - 1] <= overlap:
                first -= 1
                used += sizes[first]
            if used + size > target:
                first, used = i, 0
        used += size
    return [*done, (first, len(sizes) - 1)] if len(sizes) else []


def with_ranges(rows: DataFrame, sizes: str, target: int, overlap: int = 0) -> DataFrame:
    """Adds ranges, pack_ranges of a column of sizes. Each bin depends on the one before: a fold, so not a window function."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def ranges(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([[{"first": a, "last": b} for a, b in pack_ranges(list(x), target, overlap)] for x in series])

    # Called non-deterministic so that the optimizer does not run it again for a filter before the explode.
    return rows.withColumn("ranges", ranges.asNondeterministic()(sizes))


def split(rows: DataFrame, hard_max: int, target: int, overlap: int, counter: Callable[[Column], Column] = token_count) -> DataFrame:
    """A row for each segment: texts of up to `hard_max` tokens whole, others in windows; adds tokens, segment_index, segment_count."""
    rows = rows.withColumn("_words", tokens(F.col("text")))
    pieces = F.when(F.size("_words") <= hard_max, F.array("text")).otherwise(windows_of(F.col("_words"), target, overlap))
    rows = rows.withColumn("_pieces", pieces).withColumn("_n", F.size("_words")).drop("_words")
    out = rows.select(*[c for c in rows.columns if c not in ("text", "_pieces")], F.size("_pieces").alias("segment_count"), F.posexplode("_pieces").alias("segment_index", "text"))
    return out.withColumn("tokens", F.greatest(F.lit(1), counted("_n", "segment_index", "segment_count", target, overlap, counter, "text"))).drop("_n")


def counted(n: str, index: str, count: str, target: int, overlap: int, counter: Callable[[Column], Column], text: str) -> Column:
    """The tokens of a text that is a window, or the whole, of `n` words: known without a further look if words are what is counted."""
    if counter is not token_count:
        return counter(F.col(text))
    step = max(1, target - min(overlap, target - 1))
    return F.when(F.col(count) == 1, F.col(n)).otherwise(F.least(F.lit(target), F.col(n) - F.col(index) * step))


SEGMENT = "block_order:int,ref:string,fingerprint_ref:string,block_type:string,text:string,tokens:int,segment_index:int,segment_count:int"
FOLDED = f"document_id string, title string, parent_index int, group_key string, group_path array<string>, structure string, segs array<struct<{SEGMENT}>>, bins array<array<struct<{SEGMENT}>>>, first_child int"


def fold(batches: Iterator[pa.RecordBatch], config: Chunking, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """FOLDED rows, one per parent chunk with its children, from segments sorted by document and place.

    What is held is the parent chunk at hand, so a document of any length passes
    through. A parent closes where the document or the group's key changes, or before
    the segment that would take it over its target; its children are packed then.
    """
    document, key = None, None
    segs: list[tuple] = []
    kids: list[tuple] = []
    used = parents = children = 0
    head: tuple = ()

    def closed() -> dict:
        nonlocal parents, children, used, segs, kids
        ranges = pack_ranges([k[5] for k in kids], config.child_target, config.child_overlap)
        named = lambda x: dict(zip(NAMES, x, strict=True))
        row = dict(zip(("document_id", "title", "group_key", "group_path", "structure"), head, strict=True))
        row |= {"parent_index": parents, "segs": [named(x) for x in segs], "bins": [[named(x) for x in kids[a : b + 1]] for a, b in ranges], "first_child": children}
        parents, children, used, segs, kids = parents + 1, children + len(ranges), 0, [], []
        return row

    for batch in batches:
        rows = []
        for doc, title, group, path, structure, block, ref, mark, kind, index, count, text, tokens_, kid, kid_count, kid_text, kid_tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kid == 0:
                if segs and (doc != document or group != key or used + tokens_ > config.parent_target):
                    rows.append(closed())
                if doc != document:
                    parents = children = 0
                if not segs:
                    document, key, head = doc, group, (doc, title, group, path, structure)
                segs.append((block, ref, mark, kind, text, tokens_, index, count))
                used += tokens_
            kids.append((block, ref, mark, kind, kid_text, kid_tokens, kid, kid_count))
        yield pa.RecordBatch.from_pylist(rows, schema)
    if segs:
        yield pa.RecordBatch.from_pylist([closed()], schema)


NAMES = [x.split(":")[0] for x in SEGMENT.split(",")]
PLACE = ["document_id", "title", "group_key", "group_path", "structure", "block_order", "ref", "fingerprint_ref", "block_type", "segment_index", "segment_count"]


def folded(blocks: DataFrame, config: Chunking, counter: Callable[[Column], Column], grouper: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """FOLDED rows of blocks: texts are cut and counted where they are, then one shuffle brings a document's segments together."""
    own = grouper(blocks).select(
        "document_id", "title", "group_key", "group_path", "structure", "block_order", "block_type", "text",
        F.col("source_ref").alias("ref"), F.coalesce(F.nullif("source_ref", F.lit("")), F.col("json_path"), F.lit("no-source")).alias("fingerprint_ref"),
    )
    segments = split(own, config.parent_hard_max, config.parent_target, 0, counter)
    # Where words are counted, `tokens` is a segment's number of words (1 without any): short ones are not split again.
    size = F.col("tokens") if counter is token_count else F.size(tokens(F.col("text")))
    kids = segments.withColumn("_kids", F.when(size <= config.child_target, F.array("text")).otherwise(windows_of(tokens(F.col("text")), config.child_target, config.child_overlap)))
    rows = kids.select(*PLACE, "text", "tokens", F.size("_kids").alias("kid_count"), F.posexplode("_kids").alias("kid", "kid_text"))
    kid_tokens = counted("tokens", "kid", "kid_count", config.child_target, config.child_overlap, counter, "kid_text")
    # A segment's own text goes with its first part alone.
    rows = rows.select(*PLACE, F.when(F.col("kid") == 0, F.col("text")).alias("text"), F.col("tokens").cast("int").alias("tokens"), "kid", "kid_count", "kid_text", F.greatest(F.lit(1), kid_tokens).cast("int").alias("kid_tokens"))
    order = ["document_id", "block_order", "segment_index", "kid"]
    schema = to_arrow_schema(T.StructType.fromDDL(FOLDED))
    return arrow_map(rows.repartition("document_id").sortWithinPartitions(*order), lambda batches: fold(batches, config, schema), FOLDED)


def chunk_text(title: Column, path: Column, segments: Column, prefix: bool) -> Column:
    body = F.array_join(F.filter(F.transform(segments, lambda s: strip(s["text"])), lambda t: t != ""), "\n\n")
    if not prefix:
        return body
    head = F.concat(F.lit("Document: "), title, F.when(F.size(path) > 0, F.concat(F.lit("\nSection: "), F.array_join(path, " > "))).otherwise(F.lit("")))
    return F.when(body == "", head).otherwise(F.concat(head, F.lit("\n\n"), body))


def fingerprint(segments: Column) -> Column:
    parts = F.transform(segments, lambda s: F.concat_ws(":", s["block_order"].cast("string"), s["fingerprint_ref"], s["segment_index"].cast("string"), s["segment_count"].cast("string")))
    return F.array_join(parts, "|")


def chunk(
    blocks: DataFrame, config: Chunking | None = None, counter: Callable[[Column], Column] = token_count, grouper: Callable[[DataFrame], DataFrame] = with_structure,
    work: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(parents, children). Indexes count from 0 within a document; ids depend on content and place alone.

    `counter` gives a text's tokens (long texts are cut by words whatever it counts); `grouper` adds group_key, group_path and structure.
    With `work`, a new folder's path, what both are made of is written there first, so that it is worked out once.
    """
    config = config or Chunking()
    rows = folded(blocks, config, counter, grouper)
    if work is not None:
        rows.write.parquet(work)
        rows = blocks.sparkSession.read.schema(rows.schema).parquet(work)
    return parents_of(rows, config, counter), children_of(rows, config, counter)


def with_parent_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", stable_id(F.col("document_id"), F.lit("parent"), F.col("parent_index"), F.col("group_key"), fingerprint(F.col("segs"))))


def parents_of(rows: DataFrame, config: Chunking, counter: Callable[[Column], Column] = token_count) -> DataFrame:
    """Parent chunks of FOLDED rows."""
    full = with_parent_id(rows).withColumn("text", chunk_text(F.col("title"), F.col("group_path"), F.col("segs"), config.prefix))
    return full.select("id", "document_id", "parent_index", "text", F.greatest(F.lit(1), counter(F.col("text"))).alias("token_count"), refs("segs"), F.col("group_path").alias("parent_path"), *metadata("parent"))


def children_of(rows: DataFrame, config: Chunking, counter: Callable[[Column], Column] = token_count) -> DataFrame:
    """Child chunks of FOLDED rows."""
    own = with_parent_id(rows).select("document_id", "title", F.col("id").alias("parent_chunk_id"), "group_key", "group_path", "structure", "first_child", F.posexplode("bins").alias("n", "segs"))
    full = own.withColumn("child_index", F.col("first_child") + F.col("n")).withColumn("text", chunk_text(F.col("title"), F.col("group_path"), F.col("segs"), config.prefix))
    return full.select(
        stable_id(F.col("document_id"), F.lit("child"), F.col("child_index"), F.col("parent_chunk_id"), fingerprint(F.col("segs"))).alias("id"),
        "document_id", "parent_chunk_id", "child_index", "text", F.greatest(F.lit(1), counter(F.col("text"))).alias("token_count"),
        refs("segs"), F.col("group_path").alias("parent_path"), *metadata("child")[:-1],
    )


def refs(column: str) -> Column:
    return F.array_distinct(F.filter(F.transform(column, lambda s: s["ref"]), lambda r: r.isNotNull() & (r != ""))).alias("source_refs")


def metadata(level: str) -> list[Column]:
    return [
        F.lit(level).alias("search_level"),
        F.col("group_key").alias("structure_key"),
        F.col("structure"),
        F.array_distinct(F.transform("segs", lambda s: s["block_order"])).alias("block_orders"),
        F.array_distinct(F.transform("segs", lambda s: s["block_type"])).alias("block_types"),
    ]


def orphans(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Children whose parent is not there; a sound set of chunks has none."""
    return children.join(parents.select(F.col("id").alias("parent_chunk_id")), "parent_chunk_id", "left_anti")
