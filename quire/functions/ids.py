"""Identifiers and source references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """24 hex digits of the SHA-256 of the parts, null as empty, parted by U+001F."""
    joined = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 24)


def document_id(source_path: Column, file_name: Column, title: Column, file_type: Column) -> Column:
    return stable_id(F.lit("document"), source_path, file_name, title, file_type)


def range_ref(prefix: str, start: Column, end: Column) -> Column:
    both = F.when(end.isNull() | (start == end), start.cast("string")).when(start.isNull(), F.concat(F.lit("?-"), end.cast("string"))).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
    return F.when(start.isNotNull() | end.isNotNull(), F.concat(F.lit(f"{prefix}:"), both))


def source_ref(page: Column, slide: Column, sheet: Column, line_start: Column, line_end: Column, row_start: Column, row_end: Column) -> Column:
    """A place such as page:3;lines:5-7; null if nothing of it is known."""
    parts = [
        F.when(page.isNotNull(), F.concat(F.lit("page:"), page.cast("string"))),
        F.when(slide.isNotNull(), F.concat(F.lit("slide:"), slide.cast("string"))),
        F.when(sheet.isNotNull(), F.concat(F.lit("sheet:"), sheet)),
        range_ref("lines", line_start, line_end),
        range_ref("rows", row_start, row_end),
    ]
    return F.nullif(F.concat_ws(";", *parts), F.lit(""))


def json_parent_path(path: Column) -> Column:
    """$ and at most two steps below it."""
    steps = F.regexp_extract_all(path, F.lit(r"(\[\d+\]|\.[^.\[]+)"), 1)
    return F.concat(F.array(F.lit("$")), F.transform(F.slice(steps, 1, 2), lambda s: F.regexp_replace(s, r"^\.", "")))
