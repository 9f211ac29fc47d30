"""Markdown's block structure (CommonMark, with pipe tables) and front matter, one fold over a document's lines.

The state of the fold is the stack of open containers (block quotes and list
items) and the open leaf (a paragraph, fenced code or a table). A document is
read in the task that has it: its lines are never shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.arrow import arrow_map, byte_slices, row_batches

LINE_BREAK = re.compile("\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
ITEM = re.compile(r"([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r"""\[(?:[^\[\]\\]|\\.)+\]:[ \t]*(?:<[^<>]*>|[^\s<]\S*)(?:[ \t]+(?:"[^"]*"|'[^']*'|\([^()]*\)))?[ \t]*$""")
MARKED = re.compile(r"^(\s*)(-|\*|\+|\d+[.)])\s+")


def split_lines(text: str) -> list[str]:
    """The lines of a text, whatever the line break; a break at the end makes no further line."""
    parts = LINE_BREAK.split(text)
    return parts[:-1] if parts[-1] == "" else parts


def indent_of(line: str, start: int = 0) -> int:
    """Columns of white space before the text of a line that begins at column `start`; a tab goes to the next fourth column."""
    column = start
    for c in line:
        if c == " ":
            column += 1
        elif c == "\t":
            column += 4 - column % 4
        else:
            break
    return column - start


def without_indent(line: str, columns: int, start: int = 0) -> str:
    """A line without so many columns of white space; what is left of a tab stays as spaces."""
    column, at = start, 0
    while at < len(line) and column < start + columns and line[at] in " \t":
        column += 1 if line[at] == " " else 4 - column % 4
        at += 1
    return " " * (column - start - columns) + line[at:]


def cells(row: str) -> int:
    """The cells of a table's row."""
    bare = re.sub(r"\\.", "", row.strip())
    return bare.count("|") + 1 - bare.startswith("|") - (bare.endswith("|") and len(bare) > 1)


class Blocks:
    """The fold: `line` takes a document's lines one by one, `close` ends it; `found` has the blocks in order."""

    def __init__(self) -> None:
        self.found: list[dict] = []
        self.containers: list[dict] = []
        self.leaf: dict | None = None
        self.headings: dict[int, str] = {}

    # what is found

    def add(self, kind: str, text: str, start: int, end: int, level: int | None = None, language: str | None = None) -> dict:
        above = [self.headings[k] for k in sorted(self.headings) if level is None or k < level]
        block = {"kind": kind, "text": text, "level": level, "path": above, "start": start, "end": end, "language": language}
        self.found.append(block)
        return block

    def heading(self, level: int, text: str, start: int, end: int) -> None:
        if text:
            self.add("heading", text, start, end, level)
            self.headings = {k: v for k, v in self.headings.items() if k < level} | {level: text}
            self.to_item(text, None)

    def to_item(self, text: str, lines: tuple[int, int] | None) -> None:
        """What stands right below a list item is part of its text; the first paragraph in it, however deep, gives its lines."""
        items = [c["block"] for c in self.containers if c["kind"] == "item"]
        if self.containers and self.containers[-1]["kind"] == "item":
            block = items[-1]
            block["text"] = f"{block['text']} {text}".strip()
        for block in items:
            if lines is not None and not block["placed"]:
                block["start"], block["end"], block["placed"] = *lines, True

    def close_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf["kind"] == "paragraph":
            rows = leaf["rows"]
            while rows and DEFINITION.match(rows[0]):  # a link's definition is no text
                rows = rows[1:]
                leaf["start"] += 1
            text = " ".join(r.strip() for r in rows).strip()
            if text:
                if not any(c["kind"] == "item" for c in self.containers):
                    self.add("paragraph", text, leaf["start"], leaf["end"])
                self.to_item(text, (leaf["start"], leaf["end"]))
        elif leaf["kind"] == "code":
            text = "\n".join(leaf["rows"]).strip()
            if text:
                self.add("code", text, leaf["start"], leaf["end"], language=leaf["language"])
        elif leaf["kind"] == "table":
            self.add("table", "\n".join(leaf["rows"]), leaf["start"], leaf["end"])

    def close_containers(self, down_to: int) -> None:
        if len(self.containers) > down_to:
            self.close_leaf()
            del self.containers[down_to:]

    # a line

    def line(self, number: int, text: str) -> None:
        rest, open_containers = text, 0
        for c in self.containers:
            if c["kind"] == "quote":
                if indent_of(rest) > 3 or not rest.lstrip(" \t").startswith(">"):
                    break
                rest = rest.lstrip(" \t")[1:]
                rest = rest[1:] if rest[:1] == " " else without_indent(rest, 1)
            elif not rest.strip():
                if c["empty"] and number > c["block"]["line"]:
                    break  # an item may begin with one blank line
            elif indent_of(rest) >= c["indent"]:
                rest = without_indent(rest, c["indent"])
            else:
                break
            open_containers += 1
        inside = open_containers == len(self.containers)
        if self.leaf and self.leaf["kind"] == "code" and inside:
            return self.code_line(number, rest)
        lazy = self.leaf is not None and self.leaf["kind"] == "paragraph"
        while True:  # containers that begin here
            bare, indent = rest.strip(" \t"), indent_of(rest)
            if indent > 3 or not bare or (lazy and inside and UNDERLINE.match(bare) and open_containers == len(self.containers)):
                break
            if bare.startswith(">"):
                self.close_leaf()
                self.close_containers(open_containers)
                self.containers.append({"kind": "quote"})
                rest = rest.lstrip(" \t")[1:]
                rest = rest[1:] if rest[:1] == " " else without_indent(rest, 1)
            elif not RULE.match(bare) and (found := ITEM.match(bare)):
                mark, content = found[1], bare[found.end() :]
                if lazy and open_containers == len(self.containers) and not (content.strip() and mark in ("-", "+", "*", "1.", "1)")) and not (self.containers and self.containers[-1]["kind"] == "item"):
                    break  # neither an empty item nor one that does not count from 1 interrupts a paragraph
                if lazy and open_containers == len(self.containers) and not content.strip():
                    break
                self.close_leaf()
                self.close_containers(open_containers)
                gap = indent_of(content, indent + len(mark))
                gap = 1 if gap > 4 or not content.strip() else gap
                block = self.add("list_item", "", number, number) | {"line": number, "placed": False}
                self.found[-1] = block
                self.containers.append({"kind": "item", "indent": indent + len(mark) + gap, "empty": not content.strip(), "block": block})
                rest = without_indent(content, gap, indent + len(mark))
            else:
                break
            open_containers, inside, lazy = len(self.containers), True, False
        bare, indent = rest.strip(" \t"), indent_of(rest)
        for c in self.containers[:open_containers]:
            if c["kind"] == "item" and bare:
                c["empty"] = False
        if not bare:
            self.close_containers(open_containers)
            return self.close_leaf()
        if lazy and (indent > 3 or not self.begins(bare)):
            if inside and indent < 4 and UNDERLINE.match(bare) and self.leaf["rows"]:
                return self.underlined(number, bare)
            if inside and indent < 4 and self.table_begins(number, bare):
                return None
            self.leaf["rows"].append(bare)
            self.leaf["end"] = number
            return None
        self.close_containers(open_containers)
        if self.leaf and self.leaf["kind"] == "table" and indent < 4 and not self.begins(bare):
            self.leaf["rows"].append(rest.strip())
            self.leaf["end"] = number
            return None
        self.close_leaf()
        if indent > 3 or RULE.match(bare):
            return None  # indented code and rules are no blocks here
        if found := HEADING.match(bare):
            self.heading(len(found[1]), (found[2] or "").strip().rstrip("#").strip() if set(found[2] or "") <= {"#", " "} else found[2].strip(), number, number)
        elif found := FENCE.match(bare):
            mark = found[1] or found[3]
            self.leaf = {"kind": "code", "rows": [], "start": number, "end": number, "mark": mark, "indent": indent, "language": (found[2] if found[1] else found[4]).strip() or None}
        else:
            self.leaf = {"kind": "paragraph", "rows": [bare], "start": number, "end": number}
        return None

    @staticmethod
    def begins(bare: str) -> bool:
        """Whether a line begins a leaf that interrupts a paragraph or a table."""
        return bool(HEADING.match(bare) or FENCE.match(bare) or (RULE.match(bare) and not UNDERLINE.match(bare)) or bare.startswith(">"))

    def code_line(self, number: int, rest: str) -> None:
        leaf, bare = self.leaf, rest.strip(" \t")
        leaf["end"] = number
        if indent_of(rest) < 4 and len(bare) >= len(leaf["mark"]) and set(bare) == {leaf["mark"][0]}:
            self.close_leaf()
        else:
            leaf["rows"].append(without_indent(rest, min(leaf["indent"], indent_of(rest))))

    def underlined(self, number: int, bare: str) -> None:
        leaf, self.leaf = self.leaf, None
        self.heading(1 if bare[0] == "=" else 2, " ".join(leaf["rows"]).strip(), leaf["start"], number)

    def table_begins(self, number: int, bare: str) -> bool:
        """Whether the line is the second of a table, whose first is the paragraph's last line."""
        head = self.leaf["rows"][-1]
        if "|" not in head and "|" not in bare or not DELIMITERS.match(bare) or cells(head) != cells(bare):
            return False
        self.leaf["rows"].pop()
        self.leaf["end"] -= 1
        if self.leaf["rows"]:
            self.close_leaf()
        self.leaf = {"kind": "table", "rows": [head, bare], "start": number - 1, "end": number}
        return True

    def close(self) -> list[dict]:
        self.close_containers(0)
        self.close_leaf()
        return [b for b in self.found if b["text"]]


# front matter


def front_end(lines: list[str]) -> int | None:
    """The place of the line that ends front matter; none without any."""
    if not lines or lines[0].strip() != "---":
        return None
    return next((k for k, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), None)


FLAGS = {"null": None, "~": None, "": None, "true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}


def scalar(text: str) -> object:
    """A plain or quoted value: null, a flag, a number, or text."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if text.lower() in FLAGS and text in (text.lower(), text.upper(), text.capitalize()):
        return FLAGS[text.lower()]
    if re.fullmatch(r"[-+]?(?:0|[1-9]\d*)", text):
        return int(text)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]\d+)?", text):
        return float(text)
    return text


def flow(text: str) -> object:
    """A value that may be a list in brackets or a map in braces."""
    text = text.strip()
    if text[:1] + text[-1:] not in ("[]", "{}"):
        return scalar(text)
    parts, depth, quote, own = [], 0, "", ""
    for c in text[1:-1]:
        quote = "" if c == quote else c if not quote and c in "\"'" and not own.strip() else quote
        depth += 0 if quote else (c in "[{") - (c in "]}")
        if c == "," and not depth and not quote:
            parts.append(own)
            own = ""
        else:
            own += c
    parts = [p for p in [*parts, own] if p.strip()]
    if text[0] == "[":
        return [flow(p) for p in parts]
    return {str(scalar(k)): flow(v) for k, _, v in (p.partition(":") for p in parts)}


KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:"'\[{][^:#]*?)\s*:(?:\s+(.*))?$""")


def nested(rows: list[tuple[int, str]]) -> object:
    """Maps, lists and values from (indent, text) rows, by a stack of indents; deeper rows belong to the row above them."""
    if not rows:
        return None
    base = rows[0][0]
    if rows[0][1].startswith("- ") or rows[0][1] == "-":
        out: list = []
        for own in groups(rows, lambda r: r[0] == base and (r[1].startswith("- ") or r[1] == "-")):
            first = own[0][1][1:]
            inner = first.lstrip()
            shift = base + 1 + len(first) - len(inner)
            is_map = bool(KEY.match(inner)) and inner[:1] not in "[{"
            out.append(nested([(shift, inner), *own[1:]]) if inner and (is_map or inner.startswith("- ")) else flow(inner) if inner else nested(own[1:]))
        return out
    if KEY.match(rows[0][1]):
        found: dict = {}
        for own in groups(rows, lambda r: r[0] == base and bool(KEY.match(r[1]))):
            match = KEY.match(own[0][1])
            value = (match[2] or "").strip()
            if re.fullmatch(r"[|>][-+]?", value):
                low = min((i for i, t in own[1:] if t), default=0)
                kept = [" " * (i - low) + t for i, t in own[1:]]
                text = "\n".join(kept) if value[0] == "|" else " ".join(t for _, t in own[1:])
                found[str(scalar(match[1]))] = text if value.endswith("-") or not text else text + "\n"
            else:
                more = " ".join(t for _, t in own[1:])
                found[str(scalar(match[1]))] = flow(f"{value} {more}") if value else nested(own[1:])
        return found
    return flow(" ".join(t for _, t in rows))


def groups(rows: list[tuple[int, str]], starts) -> Iterator[list[tuple[int, str]]]:
    own: list[tuple[int, str]] = []
    for r in rows:
        if starts(r) and own:
            yield own
            own = []
        own.append(r)
    yield own


def front_values(lines: list[str]) -> dict:
    """Front matter as JSON values: maps and lists by indent or in brackets, texts, numbers and flags; comments go. What is no map is the value of `value`."""
    rows, block = [], None
    for line in lines:
        bare, indent = line.strip(), len(line) - len(line.lstrip())
        if block is not None and (not bare or indent > block):
            rows.append((indent, bare))
            continue
        block = None
        if not bare or bare.startswith("#"):
            continue
        if not re.search(r"""["']""", bare):
            bare = re.sub(r"\s+#.*$", "", bare)
        rows.append((indent, bare))
        if re.search(r":\s+[|>][-+]?$", bare):
            block = indent
    while rows and not rows[-1][1]:
        rows.pop()
    found = nested(rows)
    return found if isinstance(found, dict) else {} if found is None else {"value": found}


# documents

SCHEMA = "document_id string, block_order int, block_type string, text string, level int, parent_path array<string>, line_start int, line_end int, marker string, indent int, language string"


def blocks_of(text: str) -> list[tuple]:
    lines = split_lines(text)
    end, fold = front_end(lines), Blocks()
    for k, line in enumerate(lines):
        fold.line(k + 1, "" if end is not None and k <= end else line)
    rows = []
    for k, b in enumerate(fold.close()):
        mark = MARKED.match(lines[b["start"] - 1]) if b["kind"] == "list_item" else None
        rows.append((k, b["kind"], b["text"], b["level"], b["path"], b["start"], b["end"], mark and mark[2], len(mark[1]) if mark else 0 if b["kind"] == "list_item" else None, b["language"]))
    return rows


def block_rows(documents: DataFrame, rows_of: Callable[[str, str], Iterable[tuple]]) -> DataFrame:
    """SCHEMA rows of (document_id, text), a document after the other: a task holds some texts and some thousand rows at a time."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text", 1 << 20):
            yield from row_batches((row for own, text in zip(batch.column(0).to_pylist(), texts, strict=True) for row in rows_of(own, text)), names, kinds)

    return arrow_map(documents.select("document_id", "text"), run, SCHEMA)


def markdown_blocks(documents: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items, fenced code and tables of (document_id, text); each has the open headings above it as parent_path.

    Block quotes are looked into. An item's text is what stands right below it:
    nested items are items of their own, and code, tables and headings in it blocks
    as well. Indented code and rules give no block. A null text has none.
    """
    return block_rows(documents, lambda own, text: ((own, *b) for b in blocks_of(text)))


def front_matter(documents: DataFrame) -> DataFrame:
    """document_id, front_matter (a VARIANT) and the line that ends it, for documents (document_id, text) that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text", 1 << 20):
            rows = []
            for own, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                lines = split_lines(text)
                end = front_end(lines)
                if end is not None:
                    rows.append((own, json.dumps(front_values(lines[1:end]), ensure_ascii=False), end + 1))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], ["document_id", "json", "line_end"])

    found = arrow_map(documents.select("document_id", "text"), run, "document_id string, json string, line_end int")
    return found.select("document_id", F.parse_json("json").alias("front_matter"), "line_end")


def field(front: Column, path: str, kind: str = "string") -> Column:
    """A value of front matter by its path ($.a.b[0]); null if it is not there or of another kind."""
    return F.try_variant_get(front, path, kind)
