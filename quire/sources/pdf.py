"""The text layer of PDF files: a small reader for one file, run in batches by Spark.

Objects are found by their marks, in streams of objects too, so a damaged table of
references does not matter. Streams may be plain or deflated. Text comes from the
show operators in the order of the page's content; a move to another line makes a
line break. Fonts with a ToUnicode map are decoded by it, all others as
Windows-1252. Scanned pages have no text layer and give none.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources import pdf_streams
from quire.sources.structured import PARTS, ParseFailed, unpacked

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>()\[\]{}%]*|[^\s/<>()\[\]{}%]+", re.DOTALL)
# Escapes in PDF strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Pdf:
    """Objects of one file: their text, and their stream where they have one."""

    def __init__(self, content: bytes):
        if not content.lstrip()[:5] == b"%PDF-":
            raise ParseFailed("PDF_OPEN_FAILED")
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        self.generations: dict[int, int] = {}
        self.trailer = b" ".join(re.findall(rb"trailer\s*(<<.*?>>)\s*startxref", content, re.DOTALL))
        for m in _OBJECT.finditer(content):
            end = content.find(b"endobj", m.end())
            body = content[m.end() : end if end >= 0 else len(content)]
            self.generations[int(m[1])] = int(m[2])
            at = body.find(b"stream")
            if at >= 0 and body[:at].rstrip().endswith(b">>"):
                head = body[:at]
                data = self.stream_data(content, m.end() + at + 6, head)
                self.objects[int(m[1])] = (head, data)
                if re.search(rb"/Type\s*/XRef", head):
                    self.trailer += head
            else:
                self.objects[int(m[1])] = (body, None)
        self.key = self.opened() if b"/Encrypt" in self.trailer else None
        for head, data in list(self.objects.values()):
            if data is not None and re.search(rb"/Type\s*/ObjStm", head):
                self.unpack(head, data)
        if not any(re.search(rb"/Type\s*/Page\b", head) for head, _ in self.objects.values()):
            raise ParseFailed("PDF_OPEN_FAILED")

    @staticmethod
    def stream_data(content: bytes, at: int, head: bytes) -> bytes:
        at += 2 if content[at : at + 2] == b"\r\n" else 1
        size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
        end = at + int(size[1]) if size else -1
        if end < 0 or content[end : end + 12].lstrip()[:9] != b"endstream":
            end = content.find(b"endstream", at)
        return content[at:end]

    def decoded(self, number: int) -> bytes:
        head, data = self.objects.get(number, (b"", None))
        return self.inflated(head, data or b"")

    @staticmethod
    def inflated(head: bytes, data: bytes) -> bytes:
        try:
            return pdf_streams.decoded(head, data)
        except pdf_streams.StreamError:
            raise ParseFailed("PDF_TEXT_EXTRACTION_FAILED") from None

    def opened(self) -> bytes:
        """The key of a file that opens with an empty password; its streams are decrypted. Others fail, as do those with AES."""
        at = re.search(rb"/Encrypt\s+(\d+)\s+\d+\s+R", self.trailer)
        number = int(at[1]) if at else None
        head = self.objects.get(number, (b"", None))[0] if at else self.value(self.trailer, b"Encrypt")
        whole = lambda name, default: int(m[1]) if (m := re.search(rb"/" + name + rb"\s+(-?\d+)", head)) else default
        text = lambda source, name: string_bytes(v) if (v := self.value(source, name).strip())[:1] in (b"(", b"<") else b""
        ids = re.search(rb"/ID\s*\[\s*(<[0-9A-Fa-f\s]*>|\((?:\\.|[^\\()])*\))", self.trailer, re.DOTALL)
        standard = re.search(rb"/Filter\s*/Standard\b", head)
        key = pdf_streams.empty_password_key(whole(b"V", 0), whole(b"R", 0), whole(b"Length", 40), text(head, b"O"), text(head, b"U"), whole(b"P", 0), string_bytes(ids[1]) if ids else b"") if standard else None
        if key is None:
            raise ParseFailed("PDF_ENCRYPTED")
        for n, (own, data) in self.objects.items():
            if data is not None and n != number and not re.search(rb"/Type\s*/XRef", own):
                self.objects[n] = own, self.plain(key, n, data)
        return key

    def plain(self, key: bytes, number: int, data: bytes) -> bytes:
        return pdf_streams.rc4(pdf_streams.object_key(key, number, self.generations.get(number, 0)), data)

    def unpack(self, head: bytes, data: bytes) -> None:
        """The objects that a stream of objects holds."""
        text = self.inflated(head, data)
        first = int(re.search(rb"/First\s+(\d+)", head)[1])
        numbers = list(map(int, text[:first].split()))
        places = list(zip(numbers[::2], numbers[1::2], strict=False))
        for k, (number, at) in enumerate(places):
            end = places[k + 1][1] if k + 1 < len(places) else len(text)
            self.objects.setdefault(number, (text[first + at : first + end], None))

    def value(self, head: bytes, name: bytes) -> bytes:
        """What stands for a name in a dictionary: an array, a dictionary, or up to the next name; a reference to such a thing is followed."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*", head)
        if not m:
            return b""
        rest = head[m.end() :]
        ref = _REF.match(rest)
        if ref:
            body, stream = self.objects.get(int(ref[1]), (b"", None))
            return rest[: ref.end()] if stream is not None else body
        depth, out = 0, []
        for t in _TOKEN.finditer(rest):
            if depth == 0 and out and (t[0][:1] == b"/" or t[0] == b">>"):
                break
            depth += (t[0] in (b"<<", b"[")) - (t[0] in (b">>", b"]"))
            out.append(rest[t.start() : t.end()])
            if depth == 0 and t[0] in (b">>", b"]"):
                break
        return b" ".join(out)

    def pages(self) -> list[int]:
        """Page objects in the order of the page tree; by number where there is no tree."""
        roots = [n for n, (head, _) in self.objects.items() if re.search(rb"/Type\s*/Pages\b", head) and not re.search(rb"/Parent\b", head)]
        found: list[int] = []
        seen: set[int] = set()
        waiting = roots[::-1]
        while waiting:
            n = waiting.pop()
            if n in seen:
                continue
            seen.add(n)
            head = self.objects.get(n, (b"", None))[0]
            if re.search(rb"/Type\s*/Page\b", head):
                found.append(n)
            else:
                waiting += [int(r) for r in _REF.findall(self.value(head, b"Kids"))][::-1]
        return found or sorted(n for n, (head, _) in self.objects.items() if re.search(rb"/Type\s*/Page\b", head))

    def inherited(self, number: int, name: bytes) -> bytes:
        for _ in range(50):
            head = self.objects.get(number, (b"", None))[0]
            own = self.value(head, name)
            parent = re.search(rb"/Parent\s+(\d+)", head)
            if own or not parent:
                return own
            number = int(parent[1])
        return b""

    def fonts(self, page: int) -> dict[bytes, dict[bytes, str]]:
        """For each font of a page that has a ToUnicode map, that map."""
        table = self.value(self.inherited(page, b"Resources"), b"Font")
        maps = {}
        for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", table):
            to = re.search(rb"/ToUnicode\s+(\d+)", self.objects.get(int(ref), (b"", None))[0])
            if to:
                maps[name] = unicode_map(self.decoded(int(to[1])))
        return maps

    def page_text(self, page: int) -> str:
        head = self.objects[page][0]
        found = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
        refs = [int(r) for r in _REF.findall(found[1])] if found else []
        arrays = [int(r) for n in refs if self.objects.get(n, (b"", None))[1] is None for r in _REF.findall(self.objects.get(n, (b"", None))[0])]
        content = b"\n".join(self.decoded(n) for n in [*[n for n in refs if self.objects.get(n, (b"", None))[1] is not None], *arrays])
        return shown_text(content, self.fonts(page))

    def title(self) -> str | None:
        info = re.search(rb"/Info\s+(\d+)", self.trailer)
        head = self.objects.get(int(info[1]), (b"", None))[0] if info else b""
        raw = self.value(head, b"Title").strip()
        if raw[:1] not in (b"(", b"<"):
            return None
        data = string_bytes(raw)
        return string_text(self.plain(self.key, int(info[1]), data) if self.key else data, None).strip() or None


def unicode_map(data: bytes) -> dict[bytes, str]:
    """Codes and their text from a ToUnicode stream."""
    found: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            found[bytes.fromhex(code.decode())] = text(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
        for low, high, to, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
            width, first, last = len(low) // 2, int(low, 16), int(high, 16)
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", each)
            for k in range(min(last - first + 1, 1 << 16)):
                code = (first + k).to_bytes(width, "big")
                if to:
                    base = text(to)
                    found[code] = base[:-1] + chr(ord(base[-1]) + k) if base else ""
                elif k < len(listed):
                    found[code] = text(listed[k])
    return found


def string_bytes(token: bytes) -> bytes:
    """The bytes of a literal or hexadecimal string."""
    if token[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def escape(m: re.Match) -> bytes:
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escape, token[1:-1], flags=re.DOTALL)


def string_text(data: bytes, codes: dict[bytes, str] | None) -> str:
    if codes:
        width = max(map(len, codes))
        return "".join(codes.get(data[i : i + width], "") for i in range(0, len(data), width))
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    return data.decode("cp1252", "replace")


def shown_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """The text that a page's content shows."""
    out: list[str] = []
    stack: list[bytes] = []
    codes: dict[bytes, str] | None = None
    row = 0.0
    in_array: list[bytes] | None = None

    def number(token: bytes) -> float:
        try:
            return float(token)
        except ValueError:
            return 0.0

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for m in _TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            in_array = []
        elif t == b"]":
            stack.append(b"[")
        elif in_array is not None and (t[:1] in (b"(", b"<") or re.fullmatch(rb"[-+.\d]+", t)):
            in_array.append(t)
        elif t[:1] in (b"(", b"/", b"<") or re.fullmatch(rb"[-+.\d]+", t):
            stack.append(t)
        else:
            if t == b"Tf" and len(stack) >= 2:
                codes = fonts.get(stack[-2][1:])
            elif t in (b"Td", b"TD") and len(stack) >= 2:
                if number(stack[-1]):
                    line()
                elif out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
            elif t == b"Tm" and len(stack) >= 6:
                if number(stack[-1]) != row:
                    line()
                row = number(stack[-1])
            elif t in (b"T*", b"ET"):
                line()
            elif t in (b"Tj", b"'", b'"') and stack and stack[-1][:1] in (b"(", b"<"):
                if t != b"Tj":
                    line()
                out.append(string_text(string_bytes(stack[-1]), codes))
            elif t == b"TJ" and in_array is not None:
                for part in in_array:
                    if part[:1] in (b"(", b"<"):
                        out.append(string_text(string_bytes(part), codes))
                    elif number(part) < -200 and out and not out[-1].endswith((" ", "\n")):
                        out.append(" ")  # a wide move back stands for a space
            stack, in_array = [], None
    return "".join(out)


def paragraphs(text: str) -> list[str]:
    """Lines up to a blank one, joined by spaces."""
    return [" ".join(line.strip() for line in part.split("\n") if line.strip()) for part in re.split(r"\n\s*\n", text) if part.strip()]


def pdf_parts(content: bytes, with_title: bool = False) -> list[tuple]:
    """Paragraphs with their page numbers; first the title as a part of its own kind if asked for."""
    pdf = Pdf(content)
    found = [(-1, "title", pdf.title(), None, None, None, None)] if with_title and pdf.title() else []
    order = 0
    for number, page in enumerate(pdf.pages(), start=1):
        for p in paragraphs(pdf.page_text(page)):
            found.append((order, "paragraph", p, None, None, number, None))
            order += 1
    return found


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Files (document_id, content) as paragraph blocks with page numbers; a file that cannot be read gives a row with error."""
    return unpacked(files, "content", partial(pdf_parts), PARTS)


def pdf_titles(files: DataFrame) -> DataFrame:
    """document_id and title of the files that have one among their properties."""
    rows = unpacked(files, "content", partial(pdf_parts, with_title=True), PARTS)
    return rows.filter(F.col("block_type") == "title").select("document_id", F.col("text").alias("title"))
