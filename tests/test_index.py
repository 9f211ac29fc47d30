"""Stored indexes against scans: the same rows and scores, and less that is read."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.config import Retrieval
from quire.index import SearchStore
from quire.log import Change
from quire.operators import retrieval as R
from quire.operators import text_index
from quire.operators.text_index import TextIndex, bucket_of
from quire.operators.vector_index import VectorIndex, directions
from quire.store import Store

WORDS = ["licensed", "licenses", "public", "general", "the", "commons", "creative", "works", "work", "parties", "party", "it", "mit", "running", "x1"]
QUERIES = ["licensed", "general public", '"general public"', 'licensed "general public" or "creative commons" -mit', "party work public", "nothing here", "-mit", "the", '"creative commons licensed"', "run or mit"]


def some_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + rng.choice(["", ".", " The End", "\n"])


def scanned(frame, query):
    rows = frame.filter(R.text_matches(F.col("text"), query))
    return {r.unit: round(r.s, 9) for r in rows.select("unit", R.cover_density(F.col("text"), query).alias("s")).collect()}


def put(index, rows, replace=True):
    frame = index.store.spark.createDataFrame(rows, "unit string, owner string, text string")
    change = Change()
    index.put(change, frame, frame.select(F.col("unit").alias("target"), "owner", F.array("unit").alias("units")), replace)
    index.store.commit(change)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return [(f"u{k}", f"o{k % 90}", some_text(rng, rng.choice([0, 1, 5, 30, 200]))) for k in range(150)] + [("none", "o1", None), ("long", "o2", some_text(rng, 5000))]


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_scan(spark, texts, query, tmp_path_factory):
    index = made(spark, texts, tmp_path_factory)
    found = {r.target: round(r.lexical_score, 9) for r in index.search(query).rows.collect()}
    wanted = scanned(spark.createDataFrame(texts, "unit string, owner string, text string"), query)
    assert found == wanted
    for n in (1, 5):
        some = {r.target: round(r.lexical_score, 9) for r in index.search(query, n).rows.collect()}
        best = sorted(wanted.values(), reverse=True)[:n]
        assert sorted(some.values(), reverse=True)[:n] == best and some.items() <= wanted.items()
        assert not best or {t for t, s in wanted.items() if s >= best[-1]} <= set(some) or len(wanted) < n


def test_postings_leave_a_task_in_small_batches(spark, monkeypatch):
    """However many texts Spark hands over at once, a task makes the postings of a bounded number of words at a time."""
    rng = random.Random(5)
    stems = [None if k % 50 == 0 else [rng.choice(["", "a", "bc", "d", None]) for _ in range(rng.randint(0, 60))] for k in range(900)]
    kinds = {"unit": pa.string(), "range": pa.int32(), "stems": pa.list_(pa.string())}
    batch = pa.RecordBatch.from_pydict({"unit": [f"u{k}" for k in range(900)], "range": [k % 7 for k in range(900)], "stems": stems}, pa.schema(kinds.items()))
    monkeypatch.setattr(text_index, "WORDS_AT_ONCE", 500)
    parts = list(text_index.by_term(iter([batch])))
    got = sorted((u, t, n, p) for b in parts for t, n, u, p in zip(*(c.to_pylist() for c in b.columns), strict=True))
    assert got == sorted((f"u{k}", t, k % 7, [i for i, w in enumerate(own or ()) if w == t]) for k, own in enumerate(stems) for t in {w for w in own or () if w})
    assert max(b.num_rows for b in parts) <= 500 and len(parts) > 20


def test_units_are_numbered_within_their_range_over_batches(monkeypatch):
    """A task's blocks have each unit under its own number, whatever Spark hands over at once, and a bounded number of words."""
    rng = random.Random(6)
    texts = [(f"u{k}", k // 40, None if k % 50 == 0 else [rng.choice(["", "a", "bc", None, f"w{k % 9}"]) for _ in range(rng.randint(0, 30))]) for k in range(300)]
    schema = pa.schema([("unit", pa.string()), ("range", pa.int32()), ("stems", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, t, strict=True)) for t in texts[a : a + 23]], schema) for a in range(0, 300, 23)]
    monkeypatch.setattr(text_index, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(text_index, "BLOCKED_AT_ONCE", 400)
    rows = [r for b in text_index.posted(iter([*batches, batches[0].slice(0, 0)])) for r in b.to_pylist()]
    names = {(r["range"], r["number"]): r["unit"] for r in rows if r["unit"] is not None}
    assert sorted(names) == [(k // 40, k % 40) for k in range(300)] and [r["words"] for r in rows if r["unit"]] == [len(t[2] or ()) for t in texts]
    heads = [r for r in rows if r["unit"] is None]
    assert all(r["units"] == len(r["entries"]) and r["most"] == max(len(e["positions"]) for e in r["entries"]) for r in heads)
    got = sorted((names[r["range"], e["number"]], r["term"], e["positions"]) for r in heads for e in r["entries"])
    assert got == sorted((u, t, [i for i, w in enumerate(own or ()) if w == t]) for u, _, own in texts for t in {w for w in own or () if w})


def test_a_merge_makes_one_block_of_a_term_and_range(spark, tmp_path, monkeypatch):
    """Of blocks from several commits, without units that were replaced, in a task for each bucket; also when ranges are taken a few at a time."""
    rng = random.Random(7)
    index = TextIndex(Store(spark, f"file://{tmp_path}/s"), buckets=4, range_bits=3)
    now = {}
    for turn in range(2):
        for part in range(2):
            new = {f"u{k}": (f"o{k % 11}", some_text(rng, 25)) for k in range(20 * part, 20 * part + 30)}
            now |= new
            put(index, [(u, *v) for u, v in new.items()], replace=False)
        monkeypatch.setattr(text_index, "NUMBERED_AT_ONCE", (5_000_000, 20)[turn])
        state = index.store.state()
        index.compact()
        blocks = index._blocks(index.store.state(), None)
        heads = [tuple(r) for r in blocks.select("term", "range").collect()]
        assert len(heads) == len(set(heads)) < index._blocks(state, None).count() / 1.5
        found = [(r.term, r.unit, r.positions) for r in index._entries(index.store.state(), blocks).collect()]
        stemmed = spark.createDataFrame([(u, v[1]) for u, v in now.items()], "unit string, text string").select("unit", R.stems(F.col("text")).alias("s")).collect()
        assert sorted(found) == sorted((t, r.unit, [i for i, w in enumerate(r.s) if w == t]) for r in stemmed for t in set(r.s) - {""})
        assert len(index.store.state().actions("postings")) == 1
    assert len({re.search("part-[0-9]+", f)[0] for f in blocks.inputFiles()}) >= 4


def test_an_index_takes_disk_in_proportion_to_its_texts(spark, tmp_path):
    """What putting and merging texts writes, shuffles included, against the texts' bytes."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(6000)]
    rows = [(f"{k}", f"{k}", " ".join(vocabulary[int(len(vocabulary) * rng.random() ** 3)] for _ in range(200))) for k in range(4000)]
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = shuffled()
    index = TextIndex(Store(spark, f"file://{tmp_path}/s"), buckets=4, range_bits=2)
    put(index, rows[:1000])
    put(index, rows[1000:])
    index.compact()
    files = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert files + shuffled() - before < 2.5 * sum(len(r[2]) for r in rows)


_made = {}


def made(spark, texts, folders) -> TextIndex:
    if "index" not in _made:
        _made["index"] = TextIndex(Store(spark, f"file://{folders.mktemp('index')}"), buckets=8, range_bits=6)
        put(_made["index"], texts[:70])
        put(_made["index"], texts[70:], replace=False)
    return _made["index"]


def test_only_files_of_the_terms_buckets_are_read(spark, texts, tmp_path_factory):
    index = made(spark, texts, tmp_path_factory)
    files = index._blocks(index.store.state(), ["licens", "public"]).inputFiles()
    assert files and {int(re.search("bucket=([0-9]+)/", f)[1]) for f in files} == {bucket_of(t, 8) for t in ("licens", "public")}
    every = index._blocks(index.store.state(), None).inputFiles()
    assert len({re.search("bucket=([0-9]+)/", f)[1] for f in every}) > 4


def test_changes_reach_searches(spark, tmp_path):
    """Replaced, dropped and added texts, before and after the postings are merged."""
    rng = random.Random(2)
    index = TextIndex(Store(spark, f"file://{tmp_path}/s"), buckets=4, range_bits=3)
    now = {f"u{k}": (f"o{k % 9}", some_text(rng, 30)) for k in range(40)}
    put(index, [(u, *v) for u, v in now.items()])
    for step in range(3):
        if step == 0:  # all units of an owner are replaced by fewer
            new = {f"u{k}": ("o3", some_text(rng, 12)) for k in (3, 12)}
            now = {u: v for u, v in now.items() if v[0] != "o3"} | new
            put(index, [(u, *v) for u, v in new.items()])
        elif step == 1:
            change = Change()
            index.remove(change, spark.createDataFrame([("o5",)], "owner string"))
            index.store.commit(change)
            now = {u: v for u, v in now.items() if v[0] != "o5"}
        else:
            index.compact()
        frame = spark.createDataFrame([(u, *v) for u, v in now.items()], "unit string, owner string, text string")
        for query in ("licensed", '"general public"', "party -mit"):
            assert {r.target: round(r.lexical_score, 9) for r in index.search(query).rows.collect()} == scanned(frame, query)
    assert len(index.store.state().actions("postings")) == 1 and index._blocks(index.store.state(), None).agg(F.sum("units")).first()[0] > 0


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path):
    """A few texts have a word often, all others once."""
    index = TextIndex(Store(spark, f"file://{tmp_path}/s"), buckets=4, range_bits=8)
    rows = [(f"u{k}", f"o{k}", "licensed " * (20 if k % 100 == 7 else 1) + f"word{k}") for k in range(900)]
    put(index, rows)
    found = index.search("licensed", 5)
    assert found.read <= 20 < 200 < found.blocks
    assert {r.target for r in found.rows.collect() if r.lexical_score > 1} == {f"u{k}" for k in range(900) if k % 100 == 7}
    assert index.search("licensed").read == found.blocks


# vectors


def clustered(rng, n, dims=16, centres=12):
    means = rng.normal(size=(centres, dims)) * 4
    return [[float(x) for x in np.float32(means[k % centres] + rng.normal(size=dims) * 0.3)] for k in range(n)]


@pytest.mark.parametrize("n", [1, 10, 5000])
def test_nearest_vectors_equal_scan(spark, tmp_path, n):
    rng = np.random.default_rng(3)
    store = Store(spark, f"file://{tmp_path}/s")
    index = VectorIndex(store, centres=12)
    vectors = [(f"v{k:04d}", f"o{k % 50}", f"f{k % 3}", "txt", v) for k, v in enumerate(clustered(rng, 900))]
    vectors += [("zero", "o1", "f1", "txt", [0.0] * 16), ("null", "o1", "f1", "txt", None), ("twin", "o2", "f1", "md", vectors[5][4])]
    schema = "id string, owner string, file_name string, file_type string, embedding array<float>"
    for part in (vectors[:500], vectors[500:]):
        change = Change()
        index.put(change, spark.createDataFrame(part, schema), replace=False)
        store.commit(change)
    query = vectors[5][4]

    def check(rows, filters):
        found = index.search(query, n, filters)
        frame = R.filtered(spark.createDataFrame(rows, schema).withColumn("document_id", F.col("owner")), filters)
        wanted = {r.id: r.s for r in frame.select("id", R.cosine(F.col("embedding"), query).alias("s")).collect()}
        order = lambda d: sorted(d.items(), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:n]
        assert order({r.id: r.vector_score for r in found.rows.collect()}) == order(wanted)
        return found

    found = check(vectors, {})
    assert n > 100 or found.read < found.cells / 3
    check(vectors, {"file_name": "f2", "document_id": "o5", "file_type": ""})
    change = Change()
    index.remove(change, spark.createDataFrame([("o2",)], "owner string"))
    store.commit(change)
    left = [v for v in vectors if v[1] != "o2"]
    check(left, {})
    index.compact()
    check(left, {})
    assert len(store.state().actions("vector_cells")) == 1


def test_bounds_hold_for_every_cell():
    """No vector of a cell is more similar to a query than the cell's centre and radius allow."""
    rng = np.random.default_rng(4)
    unit = directions(rng.normal(size=(300, 8)))
    centre = unit.mean(axis=0)
    radius = np.linalg.norm(unit - centre, axis=1).max()
    for query in directions(rng.normal(size=(50, 8))):
        bound = 1 - max(0.0, np.linalg.norm(query - centre) - radius) ** 2 / 2
        assert (unit @ query).max() <= bound + 1e-9


# both


def test_retrieval_from_indexes_equals_scan(spark, tmp_path):
    rng, numbers = random.Random(5), np.random.default_rng(5)
    store = SearchStore(spark, f"file://{tmp_path}/s", buckets=4, range_bits=4, centres=6)

    def documents(names):
        docs = [(n, n, f"{n} {rng.choice(WORDS)}.txt", "txt" if len(n) % 2 else "md", "p", "{}") for n in names]
        parents = [(f"{n}-p{i}", n, i, some_text(rng, 40)) for n in names for i in range(2)]
        children = [(f"{p[0]}-c{i}", p[1], p[0], i, some_text(rng, 12), [float(x) for x in np.float32(numbers.normal(size=8))]) for p in parents for i in range(3)]
        frame = lambda rows, ddl, table: spark.createDataFrame(rows, ddl).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in store.schema(table).fields if f.name not in ddl.replace(",", "").split()])
        return (
            frame(docs, "id string, title string, file_name string, file_type string, source_path string, metadata string", "documents"),
            frame(parents, "id string, document_id string, parent_index int, text string", "parent_chunks"),
            frame(children, "id string, document_id string, parent_chunk_id string, child_index int, text string, embedding array<float>", "child_chunks"),
        )

    store.index_documents(*documents([f"d{k}" for k in range(9)]))
    store.index_documents(*documents(["d3", "other"]))
    assert store.delete_document("d4")
    names = store.read("documents").select(F.col("id").alias("document_id"), "file_name", "file_type")
    parents = store.read("parent_chunks").select(F.col("id").alias("parent_chunk_id"), F.col("text").alias("parent_text"))
    chunks = store.read("child_chunks").select(F.col("id").alias("child_id"), "document_id", "parent_chunk_id", F.col("text").alias("child_text"), "embedding").join(parents, "parent_chunk_id").join(names, "document_id")
    vector = [1.0, -0.5, 0.25, 0, 0, 0.1, 0, 2.0]
    columns = ("rank", "child_id", "vector_score", "lexical_score", "vector_rank", "lexical_rank", "score")
    for query, filters in (("licensed public", {}), ("zzz", {}), ('"general public" or d3', {}), ("party", {"file_type": "md"}), ("work", {"document_id": "d3"})):
        options = Retrieval(top_k=4, filters=filters)
        found, wanted = (sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows.select(*columns).collect()]) for rows in (store.retrieve(query, vector, options), R.retrieve(chunks, query, vector, options)))
        assert found == wanted and len(found) == 4
    store.clear()
    assert store.retrieve("licensed", vector).count() == 0


def test_an_evaluation_runs_cases(spark, tmp_path):
    """Ingested files, retrieval from the indexes, answers by a generator, the run's record."""
    from quire.operators.embeddings import HashingProvider
    from quire.plans import evaluation, records
    from quire.plans.ingest import ingest
    from quire.sources.files import discover

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "works.md").write_text("# Works\n\nAll works are licensed to the public.\n")
    (folder / "party.md").write_text("# Parties\n\nA party is held on Friday.\n")
    store, provider = SearchStore(spark, f"file://{tmp_path}/s", buckets=4, range_bits=4, centres=4), HashingProvider(32)
    ingest(discover(spark, [str(folder)]), store, provider)
    cases = evaluation.cases(spark, [("a", "Which works are licensed?", ["public"], ["licensed"], ["works.md"], []), ("b", "When is the party?", ["Friday"], ["Friday"], ["works.md", "nowhere.md"], []), ("c", "party", ["never said"], [], ["PARTY.md"], [])])
    rows, summary = evaluation.run(store, cases, provider, top_k=1, generate=lambda messages: messages[-1]["content"])
    found = {r.case_id: (r.retrieval_passed, r.answer_passed, r.source_rank, r.status) for r in rows.collect()}
    assert found == {"a": (True, True, 1, "passed"), "b": (False, True, None, "failed"), "c": (True, False, 1, "failed")}
    assert (summary["total_cases"], summary["passed_cases"], summary["source_hit_rate"], summary["answer_term_pass_rate"]) == (3, 1, 0.6667, 0.6667) and summary["mean_answer_ms"] > 0 and summary["mean_total_ms"] >= summary["mean_retrieval_ms"] > 0
    rows, summary = evaluation.run(store, cases, provider, ids=["b", "a", "b", "none"], top_k=2)
    assert [r.case_id for r in rows.collect()] == ["b", "a", "b"] and summary["mean_answer_ms"] is None and summary["answer_term_pass_rate"] is None
    records.record_run(store, summary, 2, False)
    assert store.read("evaluation_runs").first().total_cases == 3
