"""Blocks of plain text, one pass over a document's lines in the task that has it."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.markdown import block_rows, markdown_blocks, split_lines

__all__ = ["markdown_blocks", "markdown_title", "text_blocks"]
LIST_ITEM = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+")


def paragraphs(text: str) -> Iterator[tuple]:
    """(kind, text, first line, last line, marker, indent): list items by line, other lines up to a blank one or an item."""
    rows: list[str] = []
    lines = split_lines(text)
    for k, line in enumerate([*lines, ""], 1):
        bare, item = line.strip(), LIST_ITEM.match(line)
        if rows and (not bare or item):
            yield "paragraph", " ".join(rows), k - len(rows), k - 1, None, None
            rows = []
        if item and (own := line[item.end() :].strip()):
            yield "list_item", own, k, k, item[2], len(item[1])
        elif bare and not item:
            rows.append(bare)


def text_blocks(documents: DataFrame) -> DataFrame:
    """Paragraphs (lines up to a blank line or list item, joined by spaces) and list items of (document_id, text), with line ranges. A null text has none."""

    def rows_of(own: str, text: str) -> Iterator[tuple]:
        return ((own, k, kind, t, None, [], a, b, mark, indent, None) for k, (kind, t, a, b, mark, indent) in enumerate(paragraphs(text)))

    return block_rows(documents, rows_of)


def markdown_title(blocks: DataFrame) -> DataFrame:
    """document_id and title: the first heading of level 1."""
    return blocks.filter((F.col("block_type") == "heading") & (F.col("level") == 1)).groupBy("document_id").agg(F.min_by("text", "block_order").alias("title"))
