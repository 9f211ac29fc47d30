"""Sources, chunking, validation, retrieval, store and streams on small inputs."""

import io
import random
import time
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.arrow import BATCH_ROWS, ROWS_AT_ONCE
from quire.config import Chunking, Retrieval, candidate_limit, page
from quire.operators import chunking, retrieval, validate
from quire.operators.embeddings import HashingProvider, embed_column
from quire.operators.normalize import normalize_blocks
from quire.functions import text as T
from quire.operators import admin
from quire.plans import answer, evaluation, records
from quire.plans.ingest import aligned, ingest, probe, reindex, run_next_job, submit
from quire.sources import files, markdown, pdf, plain, structured
from quire.store import Change, Store
from quire.streaming import jobs


def documents(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "document_id string, text string")


def test_text_blocks(spark):
    rows = plain.text_blocks(documents(spark, "First paragraph line one\ncontinues here.\n\n- item one\n2. item two\n\nFinal paragraph.\n", " \n\t\n")).orderBy("block_order").collect()
    assert [(r.block_type, r.text, r.line_start, r.line_end, r.marker) for r in rows] == [
        ("paragraph", "First paragraph line one continues here.", 1, 2, None),
        ("list_item", "item one", 4, 4, "-"),
        ("list_item", "item two", 5, 5, "2."),
        ("paragraph", "Final paragraph.", 7, 7, None),
    ]


def test_markdown_blocks(spark):
    text = "---\nversion: \"3.4.1\"\n---\n# Title\n\nIntro line\nmore\n\n## Part\n\n- a\n  rest\n- b\n\n```py\nx = 1\n\ny\n```\n\n| n | s |\n| - | - |\n| a | 1 |\n\n# Next\nend\n"
    docs = documents(spark, text)
    rows = plain.markdown_blocks(docs).orderBy("block_order").collect()
    assert [(r.block_type, r.text, r.parent_path) for r in rows] == [
        ("heading", "Title", []),
        ("paragraph", "Intro line more", ["Title"]),
        ("heading", "Part", ["Title"]),
        ("list_item", "a rest", ["Title", "Part"]),
        ("list_item", "b", ["Title", "Part"]),
        ("code", "x = 1\n\ny", ["Title", "Part"]),
        ("table", "| n | s |\n| - | - |\n| a | 1 |", ["Title", "Part"]),
        ("heading", "Next", []),
        ("paragraph", "end", ["Next"]),
    ]
    assert rows[0].line_start == 4 and rows[5].language == "py"
    assert plain.markdown_title(plain.markdown_blocks(docs)).first().title == "Title"
    front = markdown.front_matter(docs).select(markdown.field(F.col("front_matter"), "$.version").alias("v"), "line_end").first()
    assert (front.v, front.line_end) == ("3.4.1", 3)


@pytest.mark.parametrize("blocks", [plain.text_blocks, markdown.markdown_blocks])
def test_blocks_leave_a_task_in_small_batches(spark, blocks, monkeypatch):
    """However many documents Spark hands over at once, a task makes the rows of a few thousand blocks at a time."""
    caught = {}
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: caught.update(run=run))
    blocks(documents(spark, "a"))
    batch = pa.RecordBatch.from_pydict({"document_id": [str(k) for k in range(9000)], "text": ["a line\n\nanother"] * 9000})
    sizes = [b.num_rows for b in caught["run"](iter([batch]))]
    assert sum(sizes) == 18000 and max(sizes) <= ROWS_AT_ONCE
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS


def test_csv_and_json(spark):
    rows = structured.csv_blocks(documents(spark, "name,score\nAda,98\n\nLinus,95\n", "a,b\n")).orderBy("document_id", "row_no").collect()
    assert [(r.row_no, r.text) for r in rows] == [(2, "name: Ada | score: 98"), (4, "name: Linus | score: 95"), (1, "Columns: a | b")]
    found = structured.json_blocks(documents(spark, '{"team": "s", "members": [{"name": "Ada"}, {"name": "Li"}], "a b": [1]}', "{bad")).orderBy("document_id", "block_order").collect()
    assert [(r.json_path, r.text) for r in found if not r.error] == [("$.team", '$.team: "s"'), ("$.members[0]", '{"name": "Ada"}'), ("$.members[1]", '{"name": "Li"}'), ('$."a b"', "[1]")]
    assert [r.error for r in found if r.error] == ["JSONDecodeError"]


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = office(**{
    "[Content_Types].xml": "<t/>",
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Handbook</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
})
XLSX = office(**{
    "[Content_Types].xml": "<t/>",
    "xl/workbook.xml": '<workbook><sheets><sheet name="Metrics"/></sheets></workbook>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>value</t></si><si><t>latency</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>120</v></c></row></sheetData></worksheet>',
})
PPTX = office(**{
    "[Content_Types].xml": "<t/>",
    "ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Deck</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>Body</a:t></a:r></a:p><a:p><a:pPr lvl="1"/><a:r><a:t>Item</a:t></a:r></a:p></p:sp></p:sld>',
})


def test_office_files(spark):
    rows = spark.createDataFrame([("d", bytearray(DOCX)), ("x", bytearray(b"PK not a zip"))], "document_id string, content binary")
    found = structured.unpacked(rows, "content", structured.docx_parts, structured.PARTS).collect()
    assert [(r.block_type, r.text) for r in found if not r.error] == [("heading", "Handbook"), ("paragraph", "Text"), ("table", "| a | b |\n| --- | --- |")]
    assert [r.error for r in found if r.error] == ["BadZipFile"]
    assert [(p[1], p[2], p[4]) for p in structured.pptx_parts(PPTX)] == [("heading", "Deck", 1), ("paragraph", "Body", 1), ("list_item", "Item", 1)]
    sheet = structured.xlsx_blocks(spark.createDataFrame([("x", bytearray(XLSX))], "document_id string, content binary")).orderBy("row_no").collect()
    assert [(r.block_type, r.text) for r in sheet] == [("heading", "Metrics"), ("table", "name: latency | value: 120")]


def test_sheets_in_the_order_of_the_workbook(spark):
    rel = lambda i, t: f'<Relationship Id="{i}" Target="{t}"/>'
    sheet = lambda body: f"<worksheet><sheetData>{body}</sheetData></worksheet>"
    cell = lambda ref, v, s="": f'<c r="{ref}"{s}><v>{v}</v></c>'
    book = office(**{
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Second file" r:id="b"/><sheet name="First file" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f"<Relationships>{rel('a', 'worksheets/sheet1.xml')}{rel('b', '/xl/worksheets/sheet3.xml')}</Relationships>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm&quot;x&quot;"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet(f'<row r="1">{cell("A1", 1)}</row>'),
        "xl/worksheets/sheet3.xml": sheet(f'<row r="2">{cell("A2", 45292, chr(32) + "s=" + chr(34) + "1" + chr(34))}{cell("B2", 45292.5, chr(32) + "s=" + chr(34) + "2" + chr(34))}{cell("C2", 7, chr(32) + "s=" + chr(34) + "3" + chr(34))}{cell("D2", 0.25, chr(32) + "s=" + chr(34) + "1" + chr(34))}</row>'),
    })
    assert structured.xlsx_rows(book) == [("Second file", 0, 2, ["2024-01-01T00:00:00", "2024-01-01T12:00:00", "7", "06:00:00"]), ("First file", 1, 1, ["1"])]


def test_slides_in_the_order_of_the_presentation():
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp></p:sld>'
    deck = office(**{
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="1" r:id="x"/><p:sldId id="2" r:id="y"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="x" Target="slides/slide7.xml"/><Relationship Id="y" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide2.xml": slide("later"), "ppt/slides/slide7.xml": slide("first"), "docProps/core.xml": '<c xmlns:dc="dc"><dc:title> Deck </dc:title></c>',
    })
    assert [(p[2], p[4]) for p in structured.pptx_parts(deck)] == [("first", 1), ("later", 2)]
    assert structured.office_title(deck) == "Deck" and structured.office_title(b"no zip") is None


def pdf_file(*pages, compressed=True, extra=b"", trailer=b""):
    """A PDF with a page for each content, under a tree of two levels."""
    import zlib

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count %d >>" % len(pages)]
    first = 5
    objects.append(b"<< /Type /Pages /Parent 2 0 R /Kids [" + b" ".join(b"%d 0 R" % (first + 2 * k) for k in range(len(pages))) + b"] /Resources << /Font << /F1 4 0 R >> >> >>")
    objects.append(b"<< /Type /Font /Subtype /Type1 " + extra + b">>")
    for k, content in enumerate(pages):
        data = zlib.compress(content) if compressed else content
        objects.append(b"<< /Type /Page /Parent 3 0 R /Contents %d 0 R >>" % (first + 2 * k + 1))
        objects.append(b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if compressed else b"") + data + b"\nendstream")
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in enumerate(objects, start=1))
    return body + b"trailer\n<< /Root 1 0 R " + trailer + b">>\nstartxref\n0\n%%EOF"


def test_pdf(spark):
    one = b"BT /F1 12 Tf 72 700 Td (First line \\(a\\)) Tj 0 -14 Td [(sec) 20 (ond) -300 (line)] TJ T* T* ET BT 1 0 0 1 72 600 Tm <416e6f74686572> Tj ET"
    two = b"BT /F1 12 Tf (caf\\351) Tj 50 0 Td (here) Tj ET"
    for compressed in (True, False):
        parts = pdf.pdf_parts(pdf_file(one, two, compressed=compressed))
        assert [(p[1], p[2], p[5]) for p in parts] == [("paragraph", "First line (a) second line Another", 1), ("paragraph", "caf\u00e9 here", 2)]
    codes = b"1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange"
    font = pdf_file(b"BT /F1 9 Tf <000100020003> Tj ET", extra=b"/ToUnicode 9 0 R ").replace(b"trailer", b"9 0 obj\n<< /Length %d >>\nstream\n" % len(codes) + codes + b"\nendstream\nendobj\ntrailer")
    assert pdf.pdf_parts(font)[0][2] == "Hij"
    titled = pdf_file(two, trailer=b"/Info 20 0 R ").replace(b"trailer", b"20 0 obj\n<< /Title (A report) /Author (x) >>\nendobj\ntrailer")
    rows = spark.createDataFrame([("a", bytearray(titled)), ("b", bytearray(b"not a pdf")), ("c", bytearray(pdf_file(two, trailer=b"/Encrypt 9 0 R ")))], "document_id string, content binary")
    found = {(r.document_id, r.text, r.page_number, r.error) for r in pdf.pdf_blocks(rows).collect()}
    assert found == {("a", "caf\u00e9 here", 1, None), ("b", None, None, "PDF_OPEN_FAILED"), ("c", None, None, "PDF_ENCRYPTED")}
    assert [(r.document_id, r.title) for r in pdf.pdf_titles(rows).collect()] == [("a", "A report")]


def test_texts_of_any_length_take_linear_time(spark):
    """10,000 words with thousands of hits: once an expression was computed for each element, which took minutes."""
    import time

    rows = spark.createDataFrame([(" ".join(["alpha beta x gamma the"] * 2000),)], "t string")
    query = 'alpha gamma "alpha beta"'
    columns = [retrieval.cover_density(F.col("t"), query), retrieval.text_matches(F.col("t"), query), retrieval.phrase_overlap(query, F.col("t")), F.size(T.missing_terms(T.match_form(F.col("t")), F.array(F.lit("alphas"), F.lit("gone"))))]
    rows.select(*columns).first()
    began = time.perf_counter()
    got = rows.select(*columns).first()
    assert time.perf_counter() - began < 5
    assert got[0] == pytest.approx(0.1 * (2000 / 2 + 1999 / 2), rel=0.5) and tuple(got)[1:] == (True, 1.0, 1)


def test_cover_density_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gammas", "gamma", "x", "the", "y1"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", retrieval.cover_density(F.col("t"), "alpha beta gamma").alias("s")).collect()
    for r in rows:
        words = [retrieval.stem_of(w) for w in r.t.split()]
        total, seen = 0.0, set()
        for end in range(len(words)):
            starts = [max((k for k in range(end + 1) if words[k] == w), default=-1) for w in ("alpha", "beta", "gamma")]
            begin = min(starts)
            if words[end] in ("alpha", "beta", "gamma") and begin >= 0 and begin not in seen:
                seen.add(begin)
                total += 0.1 / (1 + end - begin - 2)
        assert r.s == pytest.approx(total)


def test_zip_entries_are_those_of_its_directory(spark):
    """A zip whose contents mention other folders is what its directory says."""
    book = office(**{"[Content_Types].xml": "word/ ppt/", "xl/workbook.xml": "word/document.xml"})
    rows = spark.createDataFrame([(bytearray(book),), (bytearray(office(**{"a.txt": "word/"})),), (bytearray(DOCX),), (bytearray(PPTX),)], "content binary")
    assert [r[0] for r in rows.select(validate.content_type(F.col("content"), F.lit(".zip"))).collect()] == ["xlsx", "zip", "docx", "pptx"]
    vectors = spark.createDataFrame([([1.0, float("inf")],), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in vectors.select(validate.sound_vector(F.col("v"))).collect()] == [False, True]


def test_metadata_and_formats(spark):
    row = spark.createDataFrame([({" a ": " x ", "b": " ", "": "y", "c": None, "a": "z"},)], "m map<string,string>")
    assert row.select(T.clean_metadata(F.col("m"))).first()[0] in ({"a": "x"}, {"a": "z"})
    numbers = spark.range(1).select(T.percent_text(F.lit(0.5)), T.percent_text(F.lit(0.1234)), T.compact_number(F.lit(950)), T.compact_number(F.lit(1200)), T.compact_number(F.lit(5_000_000_000)), T.compact_fields(F.create_map(F.lit("page"), F.lit("3"), F.lit("line"), F.lit("1")))).first()
    assert tuple(numbers) == ("50%", "12.3%", "950", "1.2K", "5B", "line=1, page=3")


def test_file_checks(spark):
    rows = [("/f/a.pdf", b"plain text"), ("/f/b.json", b"{broken"), ("/f/c.txt", b""), ("/f/d.exe", b"x"), ("/f/e.txt", b"fine"), ("/f/f.docx", DOCX), ("/f/g.txt", b"a\x00b"), ("/f/h.json", b"[1]")]
    df = spark.createDataFrame([(p, None, len(c), bytearray(c)) for p, c in rows], files.SCHEMA)
    found = {r.path[3:]: r.error.code if r.error else None for r in validate.check_files(df).collect()}
    assert found == {"a.pdf": "FILE_CONTENT_TYPE_MISMATCH", "b.json": "FILE_CONTENT_TYPE_MISMATCH", "c.txt": "EMPTY_FILE", "d.exe": "UNSUPPORTED_FILE_TYPE", "e.txt": None, "f.docx": None, "g.txt": "FILE_CONTENT_TYPE_MISMATCH", "h.json": None}


def test_encodings(spark):
    rows = spark.createDataFrame([(bytearray(x),) for x in ("﻿é".encode(), "é".encode("cp1252"), b"\x81")], "content binary")
    found = rows.select(files.decoded(F.col("content")).alias("d")).select("d.*").collect()
    assert [(r.text, r.encoding) for r in found] == [("é", "utf-8-sig"), ("é", "cp1252"), ("\x81", "latin-1")]


def test_pack_ranges():
    assert chunking.pack_ranges([4, 5, 3, 9, 2, 2, 7], 10) == [(0, 1), (2, 2), (3, 3), (4, 5), (6, 6)]
    assert chunking.pack_ranges([3, 3, 3, 3, 3], 9, 4) == [(0, 2), (2, 4)]
    assert chunking.pack_ranges([20, 1], 10, 5) == [(0, 0), (1, 1)]
    assert chunking.pack_ranges([], 10) == []


def blocks_of(spark, *texts):
    named = documents(spark, *texts).select("document_id", F.lit("T").alias("title"), F.lit("t.txt").alias("file_name"), F.lit("txt").alias("file_type"), F.lit(None).cast("string").alias("source_path"))
    return normalize_blocks(aligned(plain.text_blocks(documents(spark, *texts)))).join(named, "document_id")


def test_chunks(spark):
    text = " ".join(f"word{k}" for k in range(30))
    config = Chunking(parent_target=40, parent_hard_max=60, child_target=10, child_overlap=2, prefix=False)
    parents, children = chunking.chunk(blocks_of(spark, text, "short text"), config)
    own = children.filter("document_id = '0'").orderBy("child_index").collect()
    assert len(own) == 4 and own[1].text.startswith("word8 word9 word10") and all(c.source_refs == ["lines:1"] for c in own)
    assert parents.count() == 2 and chunking.orphans(parents, children).count() == 0
    again, _ = chunking.chunk(blocks_of(spark, text, "short text"), config)
    assert {p.id for p in parents.collect()} == {p.id for p in again.collect()}
    prefixed = chunking.chunk(blocks_of(spark, "short text"))[0].first()
    assert prefixed.text == "Document: T\nSection: T\n\nshort text" and prefixed.token_count == 6


def test_chunks_are_worked_out_once(spark, tmp_path):
    """Counts that are known from words equal counted ones, and what parents and children are made of is written once."""
    rng = random.Random(8)
    docs = documents(spark, *["\n\n".join(" ".join(rng.choice(["ab", "c", "\u3000", "d-e"]) for _ in range(rng.choice([0, 1, 5, 40, 90, 200]))) for _ in range(9)) for _ in range(12)])
    named = docs.select("document_id", *[F.lit(x).alias(n) for n, x in (("title", "t"), ("file_name", "f"), ("file_type", "txt"))], F.lit(None).cast("string").alias("source_path"))
    blocks = normalize_blocks(aligned(plain.text_blocks(docs))).join(named, "document_id")
    config = Chunking(parent_target=40, parent_hard_max=60, child_target=15, child_overlap=6)
    once = chunking.chunk(blocks, config, work=f"file://{tmp_path}/chunks")
    twice = chunking.chunk(blocks, config, counter=lambda c: T.token_count(c))
    for a, b in zip(once, twice, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 30
        assert "MapInArrow" not in a._jdf.queryExecution().toString() and "MapInArrow" in b._jdf.queryExecution().toString()


def test_chunks_take_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    chunking.chunk(blocks_of(spark, "a text"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS


def test_block_rules(spark):
    rows = spark.createDataFrame([("paragraph", " ", None), ("heading", "a", None), ("paragraph", "a", 1), ("page_break", None, None), ("odd", "a", None)], "t string, x string, l int")
    codes = [r.e.code if r.e else None for r in rows.select(validate.block_error(F.col("t"), F.col("x"), F.col("l")).alias("e")).collect()]
    assert codes == ["EMPTY_BLOCK_TEXT", "INVALID_HEADING_LEVEL", "UNEXPECTED_HEADING_LEVEL", None, "INVALID_BLOCK_TYPE"]
    sets = spark.createDataFrame([("a", "1", 1), ("b", "1", 0), ("b", "1", 1), ("c", "1", 0), ("c", "2", 1)], "d string, i string, o int")
    assert {r.d: r.code for r in validate.block_sets(sets, "d", "i", "o").collect()} == {"a": "INVALID_BLOCK_ORDER", "b": "DUPLICATE_BLOCK_ID", "c": None}
    names = spark.createDataFrame([("a.txt", 1), ("a.txt", 2), ("b", 3)], "n string, k int")
    assert [r.unique_name for r in validate.collision_free(names, "n", "k").orderBy("k").collect()] == ["a.txt", "a-2.txt", "b"]


def test_guards():
    with pytest.raises(ValueError):
        Chunking(parent_target=10, parent_hard_max=5)
    with pytest.raises(ValueError):
        page(501, 0)
    assert (candidate_limit(1), candidate_limit(10), candidate_limit(50)) == (50, 80, 200)


def test_cover_density_and_matching(spark):
    row = spark.createDataFrame([("alpha beta x alpha licensed licenses",)], "t string")
    score = lambda q: row.select(retrieval.cover_density(F.col("t"), q)).first()[0]
    assert score("alpha") == pytest.approx(0.2) and score("absent") == 0 and score("alpha absent") == 0
    assert score("alpha beta") == pytest.approx(0.1 + 0.1 / 2)
    match = lambda q: row.select(retrieval.text_matches(F.col("t"), q)).first()[0]
    assert match("license") is False or match("licensed")
    assert match('"alpha beta"') and not match('"beta alpha"') and match("gone or beta") and not match("alpha -beta") and not match("the")


def test_retrieve_prefers_lexical_hits(spark):
    rows = [(1, "1", "a.txt", "txt", "general words", "", [1.0, 0.0]), (2, "2", "b.txt", "txt", "asset aliases normalized", "", [0.94, 0.34]), (3, "3", "c.md", "md", "asset", "", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "child_id long, document_id string, file_name string, file_type string, child_text string, parent_text string, embedding array<double>")
    best = retrieval.retrieve(chunks, "asset aliases normalized", [1.0, 0.0], Retrieval(top_k=2)).orderBy("rank").collect()
    assert [r.child_id for r in best] == [2, 1]
    assert best[0].score == pytest.approx(0.62 * best[0].vector_score + 0.30 * 0.8 + 0.08)
    only = retrieval.retrieve(chunks, "nothing", [1.0, 0.0], Retrieval(top_k=3, filters={"file_type": "md", "odd": "x"})).collect()
    assert [r.child_id for r in only] == [3]
    with pytest.raises(ValueError):
        retrieval.retrieve(chunks, " ", [1.0, 0.0])


def test_answer_and_citations(spark):
    hits = spark.createDataFrame([(1, 0.5, "a.txt", ["lines:1"], ["S"], "parent text")], "rank int, score double, file_name string, source_refs array<string>, parent_path array<string>, parent_text string")
    asked = []
    got = answer.answer("q?", hits, lambda m: asked.append(m) or " yes ")
    assert got["answer"] == "yes" and got["citations"][0]["file_name"] == "a.txt"
    assert "[1] score=0.5000 file=a.txt source=lines:1 path=S\nparent text" in asked[0][1]["content"]
    assert answer.answer("q?", hits.limit(0), lambda m: "no")["answer"] == answer.NOTHING
    assert list(answer.answer_events("q?", hits, lambda m: iter(["a", "", "b"]))) == [("retrieval", "1"), ("delta", "a"), ("delta", "b"), ("complete", "ab")]


def test_evaluation(spark):
    cases = evaluation.cases(spark, [("c1", "q", [], ["Human dispatchers"], ["A.txt"], []), ("c2", "q", [], ["gone"], [], [])])
    hits = spark.createDataFrame([(c, 1, "a.txt", ["r"], ["p"], "child", "human dispatcher") for c in ("c1", "c2")], "case_id string, rank int, file_name string, source_refs array<string>, parent_path array<string>, child_text string, parent_text string")
    found = {r.case_id: (r.status, r.source_rank, r.missing_context_terms) for r in evaluation.results(cases, hits).collect()}
    assert found == {"c1": ("passed", 1, []), "c2": ("failed", None, ["gone"])}
    total = evaluation.summary(evaluation.results(cases, hits), F.col("status") == "passed", F.col("retrieval_passed")).first()
    assert (total.total_cases, total.passed_cases, total.source_hit_rate, total.answer_term_pass_rate) == (2, 1, 0.5, None)
    assert [r.id for r in evaluation.selected(cases, ["c2", "x", "c2"]).orderBy("position").collect()] == ["c2", "c2"]


def test_ingest_store_stream(spark, tmp_path):
    folder, root = tmp_path / "in", f"file://{tmp_path}/store"
    folder.mkdir()
    (folder / "a.txt").write_text("One paragraph.\n\n- item\n")
    (folder / "b.md").write_text("# H\n\ntext\n")
    (folder / "c.json").write_text("{bad")
    (folder / "~$d.txt").write_text("lock")
    store, provider = Store(spark, root), HashingProvider(16)
    found = files.discover(spark, [str(folder)])
    assert ingest(found, store, provider) == {"failures": 1, "documents": 2, "children": 2}
    assert {len(r.embedding) for r in store.read("child_chunks").collect()} == {16}
    assert ingest(found, store, provider)["children"] == 2
    with pytest.raises(ValueError):
        ingest(found, store, HashingProvider(8))
    one = store.read("documents").first().id
    assert store.delete_document(one) and not store.delete_document(one) and store.read("child_chunks").filter(F.col("document_id") == one).count() == 0
    store.clear()
    assert store.read("documents").count() == 0 and store.read("index_metadata").count() == 3
    query = jobs.ingest_stream(spark, str(folder), store, provider, f"{tmp_path}/check")
    query.awaitTermination(120)
    assert store.read("documents").count() == 2


def test_store_commits(spark, tmp_path):
    """Appends rewrite nothing, two tables change at once, a number that is taken is passed over, compaction keeps the rows."""
    store = Store(spark, f"file://{tmp_path}/s")
    setting = lambda k, v: spark.createDataFrame([(k, v)], "key string, value string")
    for k in range(3):
        store.append("index_metadata", setting(f"k{k}", str(k)))
    before = sorted(p.name for p in (tmp_path / "s" / "index_metadata").iterdir())
    store.upsert("index_metadata", setting("k1", "new"), ["key"])
    assert set(before) <= {p.name for p in (tmp_path / "s" / "index_metadata").iterdir()}
    rows = lambda: {r.key: r.value for r in store.read("index_metadata").collect()}
    assert rows() == {"k0": "0", "k1": "new", "k2": "2"}
    change, meanwhile = Change(), Store(spark, store.root)
    change.rows("index_metadata", store.saved("index_metadata", setting("k3", "3")))
    meanwhile.append("index_metadata", setting("k4", "4"))
    store.commit(change)
    assert rows() == {"k0": "0", "k1": "new", "k2": "2", "k3": "3", "k4": "4"}
    store.delete("index_metadata", "key", setting("k0", ""))
    store.compact("index_metadata")
    assert len(store.state().actions("index_metadata")) == 1 and set(rows()) == {"k1", "k2", "k3", "k4"}
    store.append("index_metadata", setting("k0", "again"))
    assert rows()["k0"] == "again"
    assert "rag_traces" in store.missing_tables()
    with pytest.raises(ValueError):
        store.reset()
    store.reset(sure=True)
    assert rows() == {} and store.missing_tables() == []


def test_records(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/r")
    trace = records.record_trace(store, "q", "a", [(1, "d", 0.5)], 1.2345, 2.0)
    assert trace["total_ms"] == 3.234 or trace["total_ms"] == 3.235
    assert store.read("rag_traces").first().query == "q" and records.delete_traces(store) == 1 and records.delete_traces(store) == 0
    empty, chat = records.create_session(store), records.create_session(store, " ")
    records.add_message(store, chat, "assistant", "")
    records.add_message(store, chat, "user", "x" * 100)
    records.add_message(store, chat, "user", "later")
    found = {r.id: (r.title, r.message_count) for r in records.sessions(store).collect()}
    assert found == {empty: ("New chat", 0), chat: ("x" * 80, 3)}
    assert records.delete_session(store, chat) and not records.delete_session(store, chat) and store.read("chat_messages").count() == 0
    with pytest.raises(records.RecordError):
        records.add_message(store, chat, "user", "gone")
    records.record_run(store, {"total_cases": 2, "passed_cases": 1, "cases": ["c"]}, 5, False)
    assert '"cases"' in store.read("evaluation_runs").first().response_json
    with pytest.raises(records.RecordError, match="cannot become"):
        records.emit(store, "unknown", "job", "running")


def test_jobs_probe_and_reindex(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# Guide\n\nSome text.\n")
    (folder / "b.pdf").write_bytes(pdf_file(b"BT /F1 9 Tf (Page text) Tj ET"))
    (folder / "c.xlsx").write_bytes(XLSX)
    (folder / "d.docx").write_bytes(DOCX.replace(b"PK", b"PX", 1))
    store, provider = Store(spark, f"file://{tmp_path}/store"), HashingProvider(8)
    done = submit(store, provider, [str(folder)], worker=False)
    job = records.jobs(store).filter(F.col("job_id") == done).first()
    assert job.status == "completed" and job.started_at >= job.created_at and job.error is None
    assert [(r.stage, r.status) for r in records.events(store, done).collect()] == [("job", "queued"), ("job", "running"), ("parse", "started"), ("parse", "completed"), ("chunk", "started"), ("chunk", "completed"), ("index", "started"), ("index", "completed"), ("job", "completed")]
    assert records.events(store, done, ["chunk"]).count() == 2
    documents = {r.file_name: r for r in store.read("documents").collect()}
    assert {n: r.title for n, r in documents.items()} == {"a.md": "Guide", "b.pdf": "b", "c.xlsx": "c"}
    assert '"parser":"pdf"' in documents["b.pdf"].metadata and '"block_count":"1"' in documents["b.pdf"].metadata
    waiting = submit(store, provider, [str(tmp_path / "nowhere")], worker=True)
    assert records.job_status(store, waiting)[0] == "queued" and run_next_job(store, provider) == waiting and run_next_job(store, provider) is None
    assert records.job_status(store, waiting)[0] == "failed"
    (folder / "a.md").write_text("# Other\n\nNew text.\n")
    assert reindex(store, provider, documents["a.md"].id)["documents"] == 3
    assert "New text." in store.read("child_chunks").filter(F.col("document_id") == documents["a.md"].id).first().text
    found = files.discover(spark, [str(folder)])
    assert {r.file_name: r.code for r in probe(found, "validate", provider).collect()} == {"a.md": None, "b.pdf": None, "c.xlsx": None, "d.docx": "FILE_CONTENT_TYPE_MISMATCH"}
    assert probe(found, "parse", provider).count() == 5 and probe(found, "chunk", provider).count() == 4
    assert all(r.dimensions == 8 and abs(r.l2_norm - 1) < 1e-5 for r in probe(found, "embed", provider).collect())
    counts = probe(found, "index", provider, store).first()
    assert counts.index_documents == 3 and counts.candidate_parents == counts.index_parent_chunks == counts.candidate_children == counts.index_child_chunks == 4


def test_running_stages_count_the_time_since_they_started(spark):
    rows = [("a", "completed", 5.0, "2024-01-01 00:00:00"), ("b", "started", None, "2024-01-01 00:00:01")]
    events = spark.createDataFrame(rows, "stage string, status string, ms double, at string").withColumn("at", F.col("at").cast("timestamp"))
    found = admin.stage_snapshot(events, "stage", F.col("status"), "ms", "at", started="started", as_of=F.lit("2024-01-01 00:00:03").cast("timestamp"))
    assert {r.stage: r.total_ms for r in found.collect()} == {"a": 5.0, "b": 2000.0}


def test_embedding_rejects_blank(spark):
    with pytest.raises(Exception, match="blank"):
        embed_column(documents(spark, "a", " "), HashingProvider(4)).collect()


def test_rate_limits(spark):
    rows = [(1, k, k * 10_000_000) for k in range(10)] + [(2, 100, 0)]
    requests = spark.createDataFrame(rows, "client long, event_id long, at long")
    found = {r.event_id: r.admitted for r in jobs.admitted(requests, limit=2, seconds=60).collect()}
    assert [found[k] for k in range(10)] == [True, True, False, False, False, False, False, True, True, False] and found[100]
    assert jobs.admit([], [1, 2, 3], 0, 60)[1] == [True, True, True]


def test_streams_of_state(spark, tmp_path):
    source = f"file://{tmp_path}/events"
    rows = [(1, "j1", k, "queued" if k == 0 else "running" if k < 3 else "completed", k * 10_000_000) for k in range(4)] + [(2, "j2", 0, "queued", 0)]
    frame = spark.createDataFrame(rows, "client long, job_id string, seq long, status string, at long").withColumn("event_id", F.col("seq"))
    frame.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    states = jobs.job_state_stream(stream).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    states.awaitTermination(120)
    assert {r.job_id: (r.status, r.n_events) for r in spark.table("states").collect()} == {"j1": ("completed", 4), "j2": ("queued", 1)}


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    """Requests in any order, over several batches; idle clients leave no state."""
    rng = random.Random(7)
    rows = sorted((rng.randint(0, 300_000_000), c) for c in range(6) for _ in range(30 if c else 60))
    rows = [(c, k, at) for k, (at, c) in enumerate(rows)]
    schema = "client long, event_id long, at long"
    source = f"file://{tmp_path}/requests"
    end = 900_000_000
    for k in range(0, len(rows), 50):  # shuffled within what may be late
        part = rows[k : k + 50]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    for k in range(2):
        spark.createDataFrame([(99, 10_000 + k, end + k * 200_000_000)], schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    limited = jobs.admitted_stream(stream, limit=3, seconds=60, late="120 seconds").writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    limited.awaitTermination(240)
    wanted = {(r.client, r.event_id): r.admitted for r in jobs.admitted(spark.createDataFrame(rows, schema), limit=3, seconds=60).collect()}
    found = {(r.client, r.event_id): r.admitted for r in spark.table("limited").collect() if r.client != 99}
    assert found == wanted and 20 < sum(wanted.values()) < len(wanted)
    for name in ("waiting", "kept"):
        left = spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", "true").load(f"file://{tmp_path}/check")
        assert {r.key.client for r in left.select("key").collect()} <= {99}


def test_upsert_keeps_and_replaces(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    row = lambda i, title, at: spark.createDataFrame([(i, title, "f", "txt", "p", "{}")], "id string, title string, file_name string, file_type string, source_path string, metadata string").withColumn("created_at", F.lit(at).cast("timestamp")).withColumn("updated_at", F.lit(at).cast("timestamp"))
    store.upsert("documents", row("a", "one", "2024-01-01"), ["id"])
    store.upsert("documents", row("a", "two", "2024-02-02"), ["id"], keep={"created_at": "created_at"})
    store.upsert("documents", row("b", "three", "2024-03-03"), ["id"])
    found = {r.id: (r.title, str(r.created_at)[:10]) for r in store.read("documents").collect()}
    assert found == {"a": ("two", "2024-01-01"), "b": ("three", "2024-03-03")}
