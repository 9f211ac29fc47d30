"""Commits beside each other: claims, snapshots of the log, compaction beside writers."""

import threading

import pytest
from pyspark.sql import functions as F

from quire import log, store as stores
from quire.log import Change, ConflictError, Log, Snapshot, after
from quire.plans import records
from quire.store import Store


def together(*works):
    """Run functions in threads; what they raised."""
    raised = []

    def guarded(work):
        try:
            work()
        except Exception as e:
            raised.append(e)

    threads = [threading.Thread(target=guarded, args=(w,)) for w in works]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    return raised


def test_two_workers_claim_each_job_once(spark, tmp_path):
    first = Store(spark, f"file://{tmp_path}/s")
    wanted = {records.create_job(first, [f"p{k}"]) for k in range(20)}
    claimed = [], []

    def worker(k):
        own = Store(spark, first.root)
        while (job := records.claim(own)) is not None:
            claimed[k].append(job)

    assert together(lambda: worker(0), lambda: worker(1)) == []
    assert sorted(claimed[0] + claimed[1]) == sorted(wanted) and all(claimed)
    found = records.jobs(first).collect()
    assert {(r.status, r.n_events) for r in found} == {("running", 2)} and len(found) == 20
    with pytest.raises(records.RecordError, match="cannot become"):
        records.emit(first, claimed[0][0], "job", "running")


def test_events_of_two_writers_have_numbers_of_their_own(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    job = records.create_job(store, ["p"])
    assert together(*[lambda k=k: [records.emit(Store(spark, store.root), job, f"s{k}", "started") for _ in range(4)] for k in range(2)]) == []
    assert [r.seq for r in records.events(store, job).collect()] == list(range(9))


def test_a_commit_from_an_old_version_fails_if_its_key_was_touched(spark, tmp_path):
    own = Log(spark, f"file://{tmp_path}/_log")

    def change(key, read):
        out = Change(read=read)
        out.rows("t", f"path-{key}")
        out.touch("t", key)
        return out

    start = own.commit(change("a", 0))
    own.commit(change("b", start))
    own.commit(change("c", start))
    with pytest.raises(ConflictError):
        own.commit(change("b", start))
    assert own.commit(change("b", own.state().version)) == 4
    assert [a["path"] for a in own.state().actions("t")] == ["path-a", "path-b", "path-c", "path-b"]


def test_reading_costs_a_snapshot_and_few_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "KEEP_SECONDS", -1)
    own = Log(spark, f"file://{tmp_path}/_log")
    for k in range(400):
        change = Change()
        change.rows("t", f"p{k}") if k % 7 else change.base("t", f"b{k}", k)
        own.commit(change)
    late = Log(spark, own.folder)
    assert late.state() == own.state() and late.state().version == 400
    assert late.reads <= log.SNAPSHOT and len(late.names()) <= 3 * log.SNAPSHOT + 2
    reads = late.reads
    assert late.state().version == 400 and late.reads == reads
    assert [a["path"] for a in late.state().actions("t")] == ["b399", *()] or late.state().actions("t")[0]["kind"] == "base"


def test_of_two_bases_the_one_that_stands_for_more_counts():
    rows, base = (lambda p: {"table": "t", "kind": "rows", "path": p}), (lambda p, upto: {"table": "t", "kind": "base", "path": p, "upto": upto})
    state = Snapshot(0, {})
    for version, action in enumerate([rows("a"), rows("b"), rows("c"), base("ab", 2), base("a", 1), rows("d"), base(None, None), base("abcd", 6), rows("e")], 1):
        state = after(state, version, [action])
    assert [a["path"] for a in state.actions("t")] == [None, "e"]  # the rows that were cleared stay away, whenever their compaction ends


@pytest.fixture
def settings(spark):
    return lambda **values: spark.createDataFrame(list(values.items()), "key string, value string")


def test_compaction_beside_writers_loses_and_doubles_nothing(spark, tmp_path, settings, monkeypatch):
    """A commit between the reading and the writing of a compaction comes after it."""
    store, other = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    store.append("index_metadata", settings(a="1", c="1"))
    saved = store.saved

    def late(table, rows, kind="rows"):
        if kind == "base":
            other.append("index_metadata", settings(b="2"))
            other.upsert("index_metadata", settings(c="new"), ["key"])
        return saved(table, rows, kind)

    monkeypatch.setattr(store, "saved", late)
    store.compact("index_metadata")
    assert sorted(tuple(r) for r in store.read("index_metadata").collect()) == [("a", "1"), ("b", "2"), ("c", "new")]
    store.clear(("index_metadata",))
    assert store.read("index_metadata").count() == 0


def test_compaction_starts_by_itself_beside_writers(spark, tmp_path, settings, monkeypatch):
    monkeypatch.setattr(stores, "COMPACT", 6)
    root = f"file://{tmp_path}/s"

    def writer(k):
        own = Store(spark, root)
        for i in range(9):
            own.upsert("index_metadata", settings(**{f"k{k}-{i % 5}": str(i), f"own{k}": str(i)}), ["key"])

    assert together(lambda: writer(0), lambda: writer(1)) == []
    store = Store(spark, root)
    assert len(store.state().actions("index_metadata")) < 14
    last = {i % 5: str(i) for i in range(9)}
    wanted = {(f"k{k}-{j}", v) for k in range(2) for j, v in last.items()} | {(f"own{k}", "8") for k in range(2)}
    assert sorted(tuple(r) for r in store.read("index_metadata").collect()) == sorted(wanted)


def test_a_state_can_be_read_later(spark, tmp_path, settings):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append("index_metadata", settings(a="1"))
    before = store.state()
    store.upsert("index_metadata", settings(a="2"), ["key"])
    assert store.read("index_metadata", before).first().value == "1" and store.read("index_metadata").first().value == "2"


def test_sessions_are_found_or_made(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = records.ensure_session(store, None, "Title")
    assert records.ensure_session(store, one) == one and store.read("chat_sessions").filter(F.col("id") == one).first().title == "Title"
    with pytest.raises(records.RecordError):
        records.ensure_session(store, "none")


def test_tables_are_made_once(spark, tmp_path, settings):
    first, other = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    first.append("index_metadata", settings(a="1"))
    made = []
    assert together(lambda: made.append(first.initialise()), lambda: made.append(other.initialise())) == []
    assert sorted(map(len, made)) == [0, len(first.schemas) - 1] and first.missing_tables() == []
    assert first.read("index_metadata").first().value == "1" and first.initialise() == []
    other.append("rag_traces", records.row_of(other, "rag_traces", id="x"))
    assert first.read("rag_traces").count() == 1


def test_overview(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    empty = records.overview(store).first()
    assert (empty.document_count, empty.vector_count, empty.readiness, empty.queries.total, empty.ingestion_jobs.queued) == (0, 0, None, 0, 0)
    chunk = lambda i, v: records.row_of(store, "child_chunks", id=i, document_id="d", embedding=v)
    store.append("child_chunks", chunk("a", [1.0]).union(chunk("b", None)))
    records.record_trace(store, "q", "a", [], 1.0, 2.0)
    records.create_job(store, ["p"])
    records.create_job(store, ["p"])
    records.claim(store)
    row = records.overview(store).first()
    assert (row.child_chunk_count, row.vector_count, row.readiness) == (2, 1, 50)
    assert row.queries.asDict() == {"today": 1, "this_month": 1, "this_year": 1, "total": 1}
    assert row.ingestion_jobs.asDict() == {"queued": 1, "running": 1, "completed": 0, "failed": 0, "total": 2}
