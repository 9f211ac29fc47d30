"""Blocks of CSV, JSON and office files.

What Spark has no reader for that keeps positions goes through one Arrow batch
function per format, a file a row; its helpers only unpack one file.
"""

from __future__ import annotations

import csv
import datetime
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.tabular import dedupe_headers, key_value_row, row_is_empty
from quire.functions.text import strip
from quire.session import ship

ROWS = "document_id string, unit string, unit_no int, row_no int, cells array<string>, error string"
PARTS = "document_id string, block_order int, block_type string, text string, level int, slide_number int, page_number int, json_path string, error string"


class ParseFailed(ValueError):
    """A file that cannot be read, by a code of its own."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def unpacked(files: DataFrame, column: str, unpack: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """unpack(value of the column) of each file as rows; an exception is a row with its code or name as the error."""
    ship(files.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for document_id, value in zip(batch["document_id"], batch[column], strict=True):
                try:
                    rows += [(document_id, *row, None) for row in unpack(value)]
                except Exception as e:  # whatever a parser raises is this one file's failure
                    rows.append((document_id, *[None] * (len(names) - 2), getattr(e, "code", type(e).__name__) if isinstance(e, ParseFailed) else type(e).__name__))
            yield pd.DataFrame(rows, columns=names)

    return files.select("document_id", column).mapInPandas(run, schema)


#: The unit of a CSV file's rows; a sheet cannot have such a name.
CSV_UNIT = "rows:csv"


def csv_rows(text: str | None) -> list[tuple]:
    return [(CSV_UNIT, 0, k, [c.strip() for c in row]) for k, row in enumerate(csv.reader(io.StringIO(text or "")), start=1)]


def row_blocks(rows: DataFrame) -> DataFrame:
    """Rows of tables (document_id, unit, unit_no, row_no, cells) as key-value blocks.

    The first row that is not empty is its unit's header, made distinct. A unit
    with a header alone is one block that lists its columns.
    """
    full = rows.filter("error IS NULL").filter(~row_is_empty(F.col("cells")))
    header_rows = full.groupBy("document_id", "unit", "unit_no").agg(F.min_by("cells", "row_no").alias("head"), F.min("row_no").alias("header_line"), F.max("row_no").alias("last_line"))
    headers = header_rows.withColumn("columns", dedupe_headers(F.col("head"))).drop("head")
    body = full.join(headers, ["document_id", "unit", "unit_no"]).filter("row_no > header_line")
    blocks = body.select("document_id", "unit", "unit_no", "row_no", key_value_row(F.col("columns"), F.col("cells")).alias("text"), "columns", "header_line")
    alone = headers.filter("last_line = header_line").select("document_id", "unit", "unit_no", F.col("header_line").alias("row_no"), F.concat(F.lit("Columns: "), F.array_join("columns", " | ")).alias("text"), "columns", "header_line")
    return blocks.filter("text <> ''").union(alone).withColumn("block_type", F.lit("table"))


def csv_blocks(documents: DataFrame) -> DataFrame:
    """Documents (document_id, text) of CSV as blocks; row_no is the row's number in the file, quoted line breaks not counted."""
    return row_blocks(unpacked(documents, "text", csv_rows, ROWS))


def json_parts(text: str | None) -> list[tuple]:
    """(path, value) of the innermost containers of scalars, and of scalars beside containers."""
    found: list[tuple] = []

    def walk(value: object, path: str) -> None:
        items = [(f".{key(k)}", v) for k, v in value.items()] if isinstance(value, dict) else [(f"[{k}]", v) for k, v in enumerate(value)] if isinstance(value, list) else []
        if any(isinstance(v, dict | list) for _, v in items):
            for step, v in items:
                walk(v, path + step)
        else:
            shown = json.dumps(value, ensure_ascii=False, sort_keys=True)
            found.append((len(found), "json", shown if isinstance(value, dict | list) else f"{path}: {shown}", None, None, None, path))

    def key(name: str) -> str:
        return name if name.isidentifier() else json.dumps(name, ensure_ascii=False)

    walk(json.loads(text or ""), "$")
    return found


def json_blocks(documents: DataFrame) -> DataFrame:
    """Documents (document_id, text) of JSON as blocks with json_path; a text that is no JSON gives a row with error."""
    return unpacked(documents, "text", json_parts, PARTS)


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def texts(node: ElementTree.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if local(x.tag) == name)


def table_text(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    cells = [[c.replace("|", "\\|").replace("\n", " ").strip() for c in r] + [""] * (width - len(r)) for r in rows if any(r)]
    if not cells:
        return ""
    head = [c or f"column_{k + 1}" for k, c in enumerate(cells[0])]
    return "\n".join(f"| {' | '.join(r)} |" for r in [head, ["---"] * width, *cells[1:]])


def related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The files that a part of an office file refers to, by the ids it uses."""
    folder, name = part.rsplit("/", 1)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    places = {}
    for x in ElementTree.fromstring(z.read(rels)):
        target = x.attrib.get("Target", "")
        places[x.attrib.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
    return places


def numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    """The files whose names fit the pattern, by the number in them."""
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: int(re.fullmatch(pattern, n)[1]))


def reference(node: ElementTree.Element) -> str:
    """The id in a node's r:id."""
    return next((v for k, v in node.attrib.items() if local(k) == "id" and "}" in k), "")


def office_title(content: bytes) -> str | None:
    """The title among a file's properties; null for a file that cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if "docProps/core.xml" not in z.namelist():
                return None
            return next((x.text.strip() for x in ElementTree.fromstring(z.read("docProps/core.xml")).iter() if local(x.tag) == "title" and x.text and x.text.strip()), None)
    except Exception:  # the parser of its text says why
        return None


def docx_parts(content: bytes) -> list[tuple]:
    """Headings, list items, paragraphs and tables in the order of the body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if local(x.tag) == "body")
    found: list[tuple] = []
    for node in body:
        if local(node.tag) == "p":
            style = next((v for x in node.iter() if local(x.tag) == "pStyle" for k, v in x.attrib.items() if local(k) == "val"), "").lower().replace(" ", "")
            text, heading = texts(node).strip(), re.fullmatch("heading([1-6])", style)
            kind = "heading" if heading else "list_item" if "list" in style or style.startswith("bullet") else "paragraph"
            if text:
                found.append((len(found), kind, text, int(heading[1]) if heading else None, None, None, None))
        elif local(node.tag) == "tbl":
            rows = [[texts(c).strip() for c in r if local(c.tag) == "tc"] for r in node if local(r.tag) == "tr"]
            if text := table_text(rows):
                found.append((len(found), "table", text, None, None, None, None))
    return found


def pptx_parts(content: bytes) -> list[tuple]:
    """Slide titles as headings, paragraphs, indented ones as list items, tables; with slide numbers in the order of the presentation."""
    found: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = numbered(z, r"ppt/slides/slide(\d+)\.xml")
        if "ppt/presentation.xml" in z.namelist():
            places = related(z, "ppt/presentation.xml")
            shown = [places.get(reference(x)) for x in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if local(x.tag) == "sldId"]
            slides = [n for n in shown if n in z.namelist()] or slides
        for number, name in enumerate(slides, start=1):
            tree = ElementTree.fromstring(z.read(name))
            for shape in (x for x in tree.iter() if local(x.tag) in ("sp", "graphicFrame")):
                if rows := [[texts(c).strip() for c in r if local(c.tag) == "tc"] for r in shape.iter() if local(r.tag) == "tr"]:
                    found.append((len(found), "table", table_text(rows), None, number, None, None))
                    continue
                is_title = any(local(x.tag) == "ph" and x.attrib.get("type") in ("title", "ctrTitle") for x in shape.iter())
                for p in (x for x in shape.iter() if local(x.tag) == "p"):
                    depth = next((int(x.attrib.get("lvl", 0)) for x in p if local(x.tag) == "pPr"), 0)
                    if text := texts(p).strip():
                        found.append((len(found), "heading" if is_title else "list_item" if depth else "paragraph", text, 1 if is_title else None, number, None, None))
    return found


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


# Numbers of the built-in formats of dates and times.
DATE_FORMATS = frozenset([*range(14, 23), 45, 46, 47])


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    tree = ElementTree.fromstring(z.read("xl/styles.xml"))
    dated = set(DATE_FORMATS)
    for x in tree.iter():
        if local(x.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.attrib.get("formatCode", "")).split(";")[0].lower()
            if re.search("[dmyhs]", code) and "general" not in code:
                dated.add(int(x.attrib["numFmtId"]))
    styles = next((x for x in tree if local(x.tag) == "cellXfs"), [])
    return {k for k, x in enumerate(styles) if int(x.attrib.get("numFmtId", 0)) in dated}


def date_text(serial: str, since_1904: bool) -> str:
    """A day's number as an ISO time, to the second; a part of a day alone as a time."""
    try:
        days = float(serial)
        if not since_1904 and 0 <= days < 1:
            return (datetime.datetime(1900, 1, 1) + datetime.timedelta(seconds=round(days * 86_400))).time().isoformat()
        start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30 if days >= 61 else 31)
        return (start + datetime.timedelta(seconds=round(days * 86_400))).isoformat()
    except (ValueError, OverflowError):
        return serial


def xlsx_rows(content: bytes) -> list[tuple]:
    """Rows of each sheet with its name, in the order of the workbook; cached values alone, dates in ISO form."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(x.tag) == "si"]
        workbook, places, dated = ElementTree.fromstring(z.read("xl/workbook.xml")), related(z, "xl/workbook.xml"), date_styles(z)
        since_1904 = any(local(x.tag) == "workbookPr" and x.attrib.get("date1904") in ("1", "true") for x in workbook.iter())
        by_number = numbered(z, r"xl/worksheets/sheet(\d+)\.xml")
        sheets = [(x.attrib["name"], places.get(reference(x))) for x in workbook.iter() if local(x.tag) == "sheet"]
        if not any(file for _, file in sheets):  # no references at all
            sheets = [(name, file) for (name, _), file in zip(sheets, by_number, strict=False)]
        out = []
        for number, (name, file) in enumerate(s for s in sheets if s[1] in by_number):
            for row in (x for x in ElementTree.fromstring(z.read(file)).iter() if local(x.tag) == "row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(x for x in row if local(x.tag) == "c"):
                    kind, value = c.attrib.get("t"), texts(c, "v")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = texts(c)
                    elif kind == "b":
                        value = {"1": "true", "0": "false"}.get(value, value)
                    elif kind in (None, "n") and value and int(c.attrib.get("s", 0)) in dated:
                        value = date_text(value, since_1904)
                    cells[column_number(c.attrib["r"]) if "r" in c.attrib else k] = value.strip()
                values = [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
                out.append((name, number, int(row.attrib.get("r", len(out) + 1)), values))
    return out


def title_parts(content: bytes) -> list[tuple]:
    """The title of an office file as a part; none if it has none."""
    title = office_title(content)
    return [(0, "title", title, None, None, None, None)] if title else []


def xlsx_blocks(files: DataFrame) -> DataFrame:
    """Files (document_id, content) as blocks of their sheets."""
    return sheet_blocks(unpacked(files, "content", xlsx_rows, ROWS))


def sheet_blocks(unpacked_rows: DataFrame) -> DataFrame:
    """Rows of sheets: a heading block per sheet, then its rows as key-value blocks."""
    rows = row_blocks(unpacked_rows)
    heads = rows.groupBy("document_id", "unit", "unit_no").agg(F.min("header_line").alias("header_line"))
    sheets = heads.select("document_id", "unit", "unit_no", F.lit(0).alias("row_no"), F.col("unit").alias("text"), F.array().cast("array<string>").alias("columns"), "header_line", F.lit("heading").alias("block_type"))
    return rows.unionByName(sheets)


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page_number, text) of whatever PDF reader as paragraph blocks, parted by blank lines."""
    parts = F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n"), strip), lambda p: p != "")).alias("n", "text")
    return pages.select("document_id", "page_number", parts).withColumn("block_type", F.lit("paragraph"))
