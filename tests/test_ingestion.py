"""Parsers by type in one pass, failures kept to their files, discovery, pages by key."""

import io
import json
import os
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import admin
from quire.operators.embeddings import HashingProvider
from quire.plans.ingest import ingest
from quire.sources.files import discover
from quire.sources.registry import default_registry, parse_files
from quire.store import Store


def test_a_bad_file_is_a_failure_of_its_own(spark, tmp_path):
    """A corrupt stream, an encrypted member and JSON too deep to read, beside good files."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "good.md").write_text("---\nowner: {name: Ada}\n---\n# Good\n\n- one\n  - two\n")
    (folder / "good.txt").write_bytes("caf\xe9\n\n- item\n".encode("cp1252"))
    (folder / "deep.json").write_text("[" * 985 + "]" * 985)
    with zipfile.ZipFile(folder / "corrupt.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", "<w>" + "text " * 5000 + "</w>")
    raw = bytearray((folder / "corrupt.docx").read_bytes())
    at = raw.index(b"word/document.xml") + 20
    raw[at : at + 10] = b"\xff" * 10
    (folder / "corrupt.docx").write_bytes(bytes(raw))
    with zipfile.ZipFile(folder / "locked.xlsx", "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("xl/workbook.xml", "<w/>")
    raw = bytearray((folder / "locked.xlsx").read_bytes())
    for mark, flags in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        at = 0
        while (at := raw.find(mark, at)) >= 0:
            raw[at + flags] |= 1
            at += 4
    (folder / "locked.xlsx").write_bytes(bytes(raw))
    store = Store(spark, f"file://{tmp_path}/s")
    began = time.time()
    done = ingest(discover(spark, [str(folder)]), store, HashingProvider(8))
    assert done["failures"] == 3 and done["documents"] == 2
    assert time.time() - began < 120
    failures = spark.read.parquet(*[f"{tmp_path}/s/_work/{n}" for n in os.listdir(tmp_path / "s" / "_work") if n.startswith("failures")]).collect()
    assert {(r.path.rsplit("/", 1)[1], r.code, r.message) for r in failures} == {("corrupt.docx", "PARSE_FAILED", zlib.error.__name__), ("deep.json", "PARSE_FAILED", "RecursionError"), ("locked.xlsx", "PARSE_FAILED", "RuntimeError")}
    documents = {r.file_name: r for r in store.read("documents").collect()}
    assert json.loads(documents["good.md"].metadata)["front_matter"] == {"owner": {"name": "Ada"}} and documents["good.md"].title == "Good"
    assert any("café" in r.text for r in store.read("child_chunks").collect())


def test_a_callers_parser(spark, tmp_path):
    """A type of its own, beside those that there are, and in place of one."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("WARN one\nERROR two\n")
    (folder / "b.txt").write_text("shout\n")

    def log_parts(content):
        for line in content.decode().splitlines():
            kind, _, text = line.partition(" ")
            yield {"block_type": "paragraph", "text": f"{kind.lower()}: {text}", "parent_path": [kind]}

    registry = default_registry().register("log", ["LOG"], log_parts).register("txt", [".txt"], lambda content: [{"block_type": "paragraph", "text": content.decode().strip().upper()}])
    assert ".log" in registry.extensions() and ".log" not in default_registry().extensions()
    store = Store(spark, f"file://{tmp_path}/s")
    done = ingest(discover(spark, [str(folder)], keep_unsupported=True), store, HashingProvider(8), registry=registry)
    assert done["failures"] == 0 and done["documents"] == 2
    assert {r.file_name: r.file_type for r in store.read("documents").collect()} == {"a.log": "log", "b.txt": "txt"}
    texts = " ".join(r.text for r in store.read("child_chunks").collect())
    assert "error: two" in texts and "SHOUT" in texts and "Section: ERROR" in texts


def test_one_pass_over_all_types(spark):
    files = spark.createDataFrame([("1", "csv", b"a,b\n1,2\n"), ("2", "json", b'{"x": {"y": 1}}'), ("3", "none", b"?"), ("4", "txt", None)], "document_id string, file_type string, content binary")
    parts = parse_files(files)
    assert parts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.document_id, r.block_type, r.cells, r.json_path, r.error) for r in parts.filter("document_id < '3'").collect()) == [("1", "row", ["1", "2"], None, None), ("1", "row", ["a", "b"], None, None), ("2", "json", None, "$.x", None)]
    assert [(r.document_id, r.error) for r in parts.filter("document_id >= '3'").collect()] == [("3", "NO_PARSER")]


def test_each_file_is_found_once(spark, tmp_path):
    for name in ("a/one.txt", "a/b/two.md", "a/b/[odd] {x}.txt", "c/~$lock.txt", "c/three.csv", "c/skip.exe"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    names = lambda rows: sorted(r.path.rsplit("/", 1)[1] for r in rows.select("path").collect())
    every = [f"{tmp_path}/a", f"{tmp_path}/a/b", f"{tmp_path}/a/one.txt", f"{tmp_path}/*", f"{tmp_path}/c/*.csv", f"{tmp_path}/a"]
    found = discover(spark, every, recursive=True)
    assert [x.replace("%20", " ").replace("%7B", "{").replace("%7D", "}").replace("%5B", "[").replace("%5D", "]") for x in names(found)] == ["[odd] {x}.txt", "one.txt", "three.csv", "two.md"]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert names(discover(spark, [f"{tmp_path}/a", f"{tmp_path}/a/one.txt", f"{tmp_path}/a/b/two.md"])) == ["one.txt", "two.md"]
    assert names(discover(spark, [f"{tmp_path}/c"], keep_unsupported=True)) == ["skip.exe", "three.csv"]


@pytest.fixture
def events(spark):
    rows = [(k, None if k % 9 == 8 else k % 5, f"v{k}") for k in range(60)]
    return spark.createDataFrame(rows, "id int, ts int, v string"), rows


@pytest.mark.parametrize("descends", [True, False])
def test_pages_by_key_join_up(events, descends):
    frame, rows = events
    wanted = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if descends else r[1]) if r[1] is not None else 0, r[0]))
    found, last = [], None
    while page := admin.page_after(frame, [("ts", descends), ("id", False)], last, limit=7).collect():
        found += [tuple(r) for r in page]
        last = (page[-1].ts, page[-1].id)
    assert found == wanted


def test_a_page_reads_no_earlier_row_groups(spark, tmp_path):
    """The bound reaches the scan, whose statistics leave out what lies before the page."""
    path = str(tmp_path / "t")
    spark.range(0, 400_000, numPartitions=1).select(F.col("id"), (F.col("id") * 7).alias("v")).write.option("parquet.block.size", 256 << 10).parquet(path)
    page = admin.page_after(spark.read.parquet(path), [("id", False)], (390_000,), limit=10)
    assert "GreaterThanOrEqual(id,390000)" in page._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in page.collect()] == list(range(390_001, 390_011))
    plan = page._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves() if "AdaptiveSparkPlan" not in plan.nodeName() else plan.executedPlan().collectLeaves()
    read = leaves.head().metrics().get("numOutputRows").get().value()
    assert read < 200_000
