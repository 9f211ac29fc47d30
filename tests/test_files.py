"""JSON artifacts, uploads, migrations, settings and injected parts of ingestion."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from quire import config
from quire.operators.chunking import chunk, with_structure
from quire.operators.embeddings import HashingProvider, embed_column
from quire.plans import answer, migrations
from quire.plans.ingest import aligned
from quire.sources import artifacts, uploads
from quire.store import Store


def test_artifacts_round_trip(spark, tmp_path):
    whole = [
        {"title": "A", "file_name": "a.md", "file_type": "md", "source_path": "/a.md", "blocks": [{"block_type": "paragraph", "text": "x", "order": 1, "source_location": {"line_start": 3}}, {"block_type": "heading", "text": "H", "order": 0, "level": 1}]},
        {"title": "B", "file_name": "b.txt", "file_type": "txt", "blocks": []},
    ]
    (tmp_path / "w.json").write_text(json.dumps(whole, indent=1))
    documents, blocks = artifacts.read_parsed(spark, [f"{tmp_path}/w.json"], whole=True)
    assert [(r.block_order, r.block_type, r.text, r.line_start, r.parent_path) for r in blocks.orderBy("block_order").collect()] == [(0, "heading", "H", None, []), (1, "paragraph", "x", 3, [])]
    artifacts.write_parsed(documents, blocks, f"{tmp_path}/out")
    again, blocks_again = artifacts.read_parsed(spark, [f"{tmp_path}/out"])
    key = lambda rows: sorted(map(str, rows.select(sorted(rows.columns)).collect()))
    assert key(again) == key(documents) and key(blocks_again) == key(blocks) and again.count() == 2
    (tmp_path / "bad.json").write_text("{no json")
    (tmp_path / "other.json").write_text('{"a": 1}')
    for name in ("bad", "other"):
        with pytest.raises(Exception, match="Malformed|MALFORMED|without title"):
            artifacts.read_parsed(spark, [f"{tmp_path}/{name}.json"], whole=True)[0].collect()


def test_chunk_artifacts_reach_the_index(spark, tmp_path):
    row = {"document_id": "d", "title": "T", "file_name": "t.txt", "file_type": "txt", "source_path": "/t.txt", "block_order": 0, "block_type": "paragraph", "text": "one two"}
    blocks = spark.createDataFrame([row])
    whole = aligned(blocks).join(blocks.select("document_id", "title", "file_name", "file_type", "source_path"), "document_id")
    parents, children = chunk(whole)
    documents = whole.select(F.col("document_id").alias("id"), "title", "file_name", "file_type", "source_path", F.lit("{}").alias("metadata"))
    artifacts.write_chunked(documents, parents, children, f"{tmp_path}/chunks")
    d, p, c = artifacts.read_chunked(spark, [f"{tmp_path}/chunks"])
    assert [r.id for r in p.collect()] == [r.id for r in parents.collect()]
    assert [(r.id, r.text, r.block_orders) for r in c.collect()] == [(r.id, r.text, r.block_orders) for r in children.collect()]
    store = Store(spark, f"file://{tmp_path}/s")
    now = F.current_timestamp()
    store.index_documents(d.withColumn("created_at", now).withColumn("updated_at", now), p, embed_column(c.drop("embedding"), HashingProvider(8)))
    assert store.stats() == {"documents": 1, "parent_chunks": 1, "child_chunks": 1}
    assert store.health() == {"ok": True, "initialised": True, "missing_tables": store.missing_tables(), "error": None}


def test_uploads(spark, tmp_path):
    root = f"file://{tmp_path}/up"
    rows = uploads.receive(spark, [("a b.txt", io.BytesIO(b"one")), ("a b.txt", io.BytesIO(b"two"))], root)
    assert sorted((r.path.split("/")[-1], bytes(r.content)) for r in rows.collect()) == [("a_b-2.txt", b"two"), ("a_b.txt", b"one")]
    before = set(os.listdir(tmp_path / "up"))
    faults = {
        "NO_UPLOAD_FILES": [],
        "TOO_MANY_UPLOAD_FILES": [("a.txt", io.BytesIO(b"x"))] * 3,
        "UNSUPPORTED_UPLOAD_FILE_TYPE": [("a.exe", io.BytesIO(b"x"))],
        "UPLOAD_FILE_TOO_LARGE": [("a.txt", io.BytesIO(b"x" * 11))],
    }
    for code, given in faults.items():
        with pytest.raises(uploads.UploadError) as e:
            uploads.receive(spark, given, root, most_files=2, most_bytes=10)
        assert e.value.code == code
    with pytest.raises(uploads.UploadError):  # no PDF inside
        uploads.receive(spark, [("a.pdf", io.BytesIO(b"plain text"))], root)
    assert set(os.listdir(tmp_path / "up")) == before


def test_source_of_a_document(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One two three.\n")
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [("d", "a.txt", f"file://{tmp_path}/a.txt"), ("lost", "b.txt", f"file://{tmp_path}/b.txt"), ("none", "c.txt", None)]
    columns = "title string, file_type string, metadata string, created_at timestamp, updated_at timestamp".split(", ")
    documents = spark.createDataFrame(rows, "id string, file_name string, source_path string")
    store.append("documents", documents.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns]))
    row = uploads.open_source(store, "d").first()
    assert (row.file_name, row.media_type, bytes(row.content)) == ("a.txt", "text/plain", b"One two three.\n")
    for name, code in (("lost", "SOURCE_FILE_NOT_FOUND"), ("none", "SOURCE_PATH_MISSING"), ("other", "DOCUMENT_NOT_FOUND")):
        with pytest.raises(LookupError, match=code):
            uploads.open_source(store, name)


def test_injected_counter_and_grouper(spark):
    row = {"document_id": "d", "title": "T", "file_name": "t.txt", "file_type": "txt", "source_path": "/t.txt", "block_type": "paragraph"}
    blocks = spark.createDataFrame([{**row, "block_order": k, "page_number": k + 1, "text": t} for k, t in enumerate(("one two", "three"))])
    whole = aligned(blocks).join(blocks.select("document_id", "block_order", "title", "file_name", "file_type", "source_path"), ["document_id", "block_order"])
    one_group = lambda b: with_structure(b).withColumn("group_key", F.lit("all")).withColumn("group_path", F.array().cast("array<string>"))
    assert chunk(whole)[0].count() == 2
    parents, children = chunk(whole, counter=F.length, grouper=one_group)
    assert [(r.structure_key, r.token_count == len(r.text)) for r in parents.union(parents.limit(0)).collect()] == [("all", True)]
    assert all(r.token_count == len(r.text) and r.structure_key == "all" for r in children.collect())


def test_migrations(spark, tmp_path):
    folder, store = tmp_path / "m", Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(LookupError):
        migrations.apply(store, str(folder))
    folder.mkdir()
    (folder / "002_second.sql").write_text("CREATE OR REPLACE TEMPORARY VIEW m2 AS SELECT * FROM m1;\n")
    (folder / "001_first.sql").write_text("-- a view\nCREATE OR REPLACE TEMPORARY VIEW m1 AS\n  SELECT 1 AS x;\nSELECT 2")
    assert migrations.apply(store, str(folder)) == ["001", "002"] and spark.table("m2").first().x == 1
    assert migrations.apply(store, str(folder)) == []
    (folder / "003_third.sql").write_text("SELECT 3")
    assert [r.version for r in migrations.pending(migrations.present(store, str(folder)), store.read("schema_migrations")).collect()] == ["003"]
    (folder / "001_first.sql").write_text("SELECT 9")
    with pytest.raises(ValueError, match="001_first"):
        migrations.apply(store, str(folder))
    assert store.read("schema_migrations").count() == 2


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nexport QUIRE_T1 = 'a b'\nQUIRE_T2=7\nQUIRE_T3=\nnothing\n")
    (tmp_path / "sub").mkdir()
    for name in ("QUIRE_T1", "QUIRE_T3"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("QUIRE_T2", "5")
    assert config.load_env(str(tmp_path / "sub")) == (tmp_path / ".env").resolve()
    assert os.environ["QUIRE_T1"] == "a b" and config.env_int("QUIRE_T2", 1) == 5 and config.env_int("QUIRE_T3", 9) == 9
    for bad, least in (("x", None), ("0", 1)):
        monkeypatch.setenv("QUIRE_T2", bad)
        with pytest.raises(ValueError):
            config.env_int("QUIRE_T2", 1, least)
    for name in ("QUIRE_T1", "QUIRE_T3"):
        os.environ.pop(name, None)


def test_contents_of_responses():
    class Response:
        message = {"content": " a "}

    assert answer.content_of({"message": {"content": " a "}}) == "a" and answer.delta_of(Response()) == " a "
    assert answer.content_of({}) == "" and answer.delta_of(None) == "" and answer.delta_of({"message": {"content": None}}) == ""
