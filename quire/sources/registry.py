"""Parsers by file type, and one pass over all files that gives each to its own.

A parser takes a file's bytes and yields parts: dictionaries with fields of PART.
A part of kind `row` is a row of a table (unit, unit_no, row_no, cells), which
becomes a block with its table's header in Spark; one of kind `title` names the file;
all others are blocks. Whatever a parser raises is that one file's failure.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.config import FILE_TYPES
from quire.session import ship
from quire.sources import markdown, pdf, plain, structured

PART = (
    "document_id string, block_order long, block_type string, text string, level int, parent_path array<string>, page_number int, slide_number int, json_path string, line_start int, line_end int, "
    "unit string, unit_no int, row_no int, cells array<string>, error string"
)
FIELDS = [x.split()[0] for x in PART.split(", ")]
Parser = Callable[[bytes], Iterable[dict]]


def text_of(content: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252 where it has all bytes, else Latin-1."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


def text_parts(content: bytes) -> Iterator[dict]:
    for kind, text, start, end, _, _ in plain.paragraphs(text_of(content)):
        yield {"block_type": kind, "text": text, "line_start": start, "line_end": end}


def markdown_parts(content: bytes) -> Iterator[dict]:
    """Blocks, and front matter as a part of its own kind: its JSON, and the line that ends it."""
    text = text_of(content)
    lines = markdown.split_lines(text)
    end = markdown.front_end(lines)
    if end is not None:
        yield {"block_type": "front_matter", "text": json.dumps(markdown.front_values(lines[1:end]), ensure_ascii=False), "line_end": end + 1}
    title = None
    for _, kind, own, level, path, start, last, _, _, _ in markdown.blocks_of(text):
        title = title or (own if kind == "heading" and level == 1 else None)
        yield {"block_type": kind, "text": own, "level": level, "parent_path": path, "line_start": start, "line_end": last}
    if title:
        yield {"block_type": "title", "text": title}


def row_parts(rows: list[tuple]) -> Iterator[dict]:
    for unit, number, row, cells in rows:
        yield {"block_type": "row", "unit": unit, "unit_no": number, "row_no": row, "cells": cells}


def named_parts(rows: list[tuple]) -> Iterator[dict]:
    for _, kind, text, level, slide, page, path in rows:
        yield {"block_type": kind, "text": text, "level": level, "slide_number": slide, "page_number": page, "json_path": path}


def office(parts: Callable[[bytes], list[tuple]], rows: bool = False) -> Parser:
    """A parser of office files: what `parts` finds, and the title among the file's properties."""

    def parse(content: bytes) -> Iterator[dict]:
        found = parts(content)
        yield from (row_parts if rows else named_parts)(found)
        title = structured.office_title(content) or (None if rows else next((p[2] for p in found if p[1] == "heading" and p[3] == 1), None))
        if title:
            yield {"block_type": "title", "text": title}

    return parse


def pdf_parts(content: bytes) -> Iterator[dict]:
    return named_parts(pdf.pdf_parts(content, with_title=True))


@dataclass
class Registry:
    """File types by extension, and a parser for each type."""

    types: dict[str, str] = field(default_factory=dict)
    parsers: dict[str, Parser] = field(default_factory=dict)

    def register(self, file_type: str, extensions: Iterable[str], parser: Parser) -> Registry:
        """Take a parser for a type and its extensions, in place of what they had."""
        for e in extensions:
            self.types[e.lower() if e.startswith(".") else f".{e.lower()}"] = file_type
        self.parsers[file_type] = parser
        return self

    def parser_of(self, file_type: str) -> Parser:
        try:
            return self.parsers[file_type]
        except KeyError:
            raise structured.ParseFailed("NO_PARSER") from None

    def extensions(self) -> list[str]:
        return sorted(self.types)


def default_registry() -> Registry:
    """The parsers of the formats that the library reads."""
    return Registry(
        dict(FILE_TYPES),
        {
            "txt": text_parts,
            "md": markdown_parts,
            "csv": lambda content: row_parts(structured.csv_rows(text_of(content))),
            "json": lambda content: named_parts(structured.json_parts(text_of(content))),
            "docx": office(structured.docx_parts),
            "pptx": office(structured.pptx_parts),
            "xlsx": office(structured.xlsx_rows, rows=True),
            "pdf": pdf_parts,
        },
    )


def parts_of(parser: Parser, document_id: str, content: bytes) -> list[dict]:
    """A file's parts, its blocks numbered in order, or one part with an error."""
    try:
        found, order = [], -1
        for p in parser(content):
            order += p["block_type"] not in ("title", "front_matter")
            found.append({"block_order": order, **p, "document_id": document_id})
        return found
    except Exception as e:  # whatever a parser raises is this one file's failure
        code = e.code if isinstance(e, structured.ParseFailed) else type(e).__name__
        return [{"document_id": document_id, "error": code}]


#: Parts that leave a task at once.
PARTS_AT_ONCE = 2000


def parse_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """PART rows of files (document_id, file_type, content): one pass, in which each file goes to its type's parser."""
    registry = registry or default_registry()
    ship(files.sparkSession)
    schema = to_arrow_schema(T.StructType.fromDDL(PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file's bytes and parts at a time
                own, kind, content = (c[k].as_py() for c in batch.columns)
                try:
                    parser = registry.parser_of(kind)
                except structured.ParseFailed as e:
                    parts = [{"document_id": own, "error": e.code}]
                else:
                    parts = parts_of(parser, own, content or b"")
                for a in range(0, len(parts), PARTS_AT_ONCE):
                    yield pa.RecordBatch.from_pylist(parts[a : a + PARTS_AT_ONCE], schema)

    return files.select("document_id", "file_type", "content").mapInArrow(run, PART)


def blocks_of_parts(parts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Blocks with these columns (name: type) from parts: tables' rows with their headers, all others as they are."""

    def aligned(rows: DataFrame, **given: str) -> DataFrame:
        have, empty = set(rows.columns), F.array().cast("array<string>")
        pick = lambda c, t: F.col(given[c]) if c in given else F.col(c) if c in have else F.lit(None)
        return rows.select(*[(F.coalesce(pick(c, t).cast(t), empty) if c == "parent_path" else pick(c, t).cast(t)).alias(c) for c, t in columns.items()])

    sound = parts.filter("error IS NULL")
    plain_blocks = aligned(sound.filter(~F.col("block_type").isin("row", "title", "front_matter")))
    rows = sound.filter("block_type = 'row'").select("document_id", "unit", "unit_no", "row_no", "cells", "error")
    numbered = structured.sheet_blocks(rows).withColumn("block_order", F.col("unit_no") * 1_000_000 + F.col("row_no"))
    # A CSV file is one table without a name: no heading, and its rows have line numbers.
    named = F.col("unit") != structured.CSV_UNIT
    sheets = aligned(numbered.filter(named), sheet_name="unit", row_start="row_no", row_end="row_no")
    lines = aligned(numbered.filter(~named & (F.col("block_type") != "heading")), line_start="row_no", line_end="row_no")
    return plain_blocks.unionByName(sheets).unionByName(lines)


def titles_of_parts(parts: DataFrame) -> DataFrame:
    """document_id and own_title of the files that name themselves: the last such part counts."""
    named = parts.filter((F.col("block_type") == "title") & F.col("error").isNull())
    return named.groupBy("document_id").agg(F.max_by("text", "block_order").alias("own_title"))
