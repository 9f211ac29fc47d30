"""Records of answers, conversations, evaluations and jobs.

Each record is one small append to its table. What changes later (a session's
title, a job's status) is a row put in place of the old one, or derived from
appended events.
"""

from __future__ import annotations

import json
import random
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.log import Snapshot
from quire.operators.admin import index_stats, queued, readiness, since_buckets, status_pivot
from quire.schemas import TABLES
from quire.store import Change, Store

NEW_CHAT = "New chat"
#: Statuses of a job, and those that may follow each.
TRANSITIONS = {None: ("queued",), "queued": ("running", "failed"), "running": ("completed", "failed"), "completed": (), "failed": ()}


class RecordError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def row_of(store: Store, table: str, **values: object) -> DataFrame:
    """One row of a table; columns that are not given are null."""
    columns = store.read_schema(table)
    return store.spark.createDataFrame([tuple(values.get(c) for c in columns)], TABLES[table])


# answers


def record_trace(store: Store, query: str, answer: str, citations: list[tuple[int, str, float]], retrieval_ms: float, answer_ms: float, llm_model: str | None = None, top_k: int = 5) -> dict:
    """Keep one answer with its times; the row as stored. total_ms is their sum, to three digits."""
    values = {
        "id": uuid.uuid4().hex, "query": query, "answer": answer, "llm_model": llm_model, "top_k": top_k, "result_count": len(citations), "retrieval_ms": retrieval_ms,
        "answer_ms": answer_ms, "total_ms": round(retrieval_ms + answer_ms, 3), "citations": citations, "created_at": now(),
    }
    store.append("rag_traces", row_of(store, "rag_traces", **values))
    return values


def delete_traces(store: Store) -> int:
    """Drop all traces; how many there were."""
    n = store.read("rag_traces").count()
    store.clear(("rag_traces",))
    return n


# conversations


def create_session(store: Store, title: str | None = None) -> str:
    at, own = now(), uuid.uuid4().hex
    store.append("chat_sessions", row_of(store, "chat_sessions", id=own, title=(title or "").strip() or NEW_CHAT, created_at=at, updated_at=at))
    return own


def add_message(store: Store, session_id: str, role: str, content: str, trace_id: str | None = None, llm_model: str | None = None, latency_ms: float | None = None) -> str:
    """Add a message and touch its session, in one commit; the first message that is not empty, whoever says it, titles a new chat."""
    own = uuid.uuid4().hex

    def work(state: Snapshot, change: Change) -> str:
        session = store.read("chat_sessions", state).filter(F.col("id") == session_id).first()
        if session is None:
            raise RecordError("CHAT_SESSION_NOT_FOUND", "there is no such session")
        at, title = now(), content[:80] if session["title"] == NEW_CHAT and content else session["title"]
        change.touch("chat_sessions", session_id)
        store.put(change, "chat_sessions", row_of(store, "chat_sessions", id=session_id, title=title, created_at=session["created_at"], updated_at=at), "id")
        message = row_of(store, "chat_messages", id=own, session_id=session_id, role=role, content=content, trace_id=trace_id, llm_model=llm_model, latency_ms=latency_ms, created_at=at)
        change.rows("chat_messages", store.saved("chat_messages", message))
        return own

    return store.attempt(work)


def ensure_session(store: Store, session_id: str | None = None, title: str | None = None) -> str:
    """The session of that id, or a new one if none is given."""
    if session_id is None:
        return create_session(store, title)
    if store.read("chat_sessions").filter(F.col("id") == session_id).isEmpty():
        raise RecordError("CHAT_SESSION_NOT_FOUND", "there is no such session")
    return session_id


def sessions(store: Store) -> DataFrame:
    """All sessions with their number of messages, 0 for those without any; the last touched first."""
    counts = store.read("chat_messages").groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"))
    return store.read("chat_sessions").join(counts, "id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0))).orderBy(F.desc("updated_at"), "id")


def delete_session(store: Store, session_id: str) -> bool:
    """Drop a session and its messages; whether it was there. A message that is added meanwhile is dropped too, or fails."""

    def work(state: Snapshot, change: Change) -> bool:
        there = not store.read("chat_sessions", state).filter(F.col("id") == session_id).isEmpty()
        if there:
            change.touch("chat_sessions", session_id)
            for table, key in (("chat_sessions", "id"), ("chat_messages", "session_id")):
                change.drop(table, key, store.saved(table, store.spark.createDataFrame([(session_id,)], f"{key} string"), "drop"))
        return there

    return store.attempt(work)


# evaluations


def record_run(store: Store, summary: dict, top_k: int, include_answers: bool) -> str:
    """Keep the summary of an evaluation; what has no column of its own is in the JSON."""
    own = uuid.uuid4().hex
    columns = {k: summary.get(k) for k in ("total_cases", "passed_cases", "failed_cases", "source_hit_rate", "answer_term_pass_rate")}
    store.append("evaluation_runs", row_of(store, "evaluation_runs", id=own, top_k=top_k, include_answers=include_answers, response_json=json.dumps(summary, sort_keys=True, default=str), created_at=now(), **columns))
    return own


# jobs: a log of events; a job's status is that of its last event


def job_status(store: Store, job_id: str, at: Snapshot | None = None) -> tuple[str | None, int]:
    """A job's status, null if it is unknown, and the number of its events."""
    own = store.read("job_events", at).filter(F.col("job_id") == job_id)
    last = own.agg(F.max_by(F.when(F.col("stage") == "job", F.col("status")), F.when(F.col("stage") == "job", F.col("seq"))).alias("status"), F.count(F.lit(1)).alias("n")).first()
    return last["status"], last["n"]


def emit(store: Store, job_id: str, stage: str, status: str, message: str = "", duration_ms: float | None = None) -> None:
    """Append a progress event. Events of the stage `job` are the job's own transitions, and checked against the state they follow: of two writers one comes after the other, or fails."""

    def work(state: Snapshot, change: Change) -> None:
        before, n = job_status(store, job_id, state)
        if stage == "job" and status not in TRANSITIONS[before]:
            raise RecordError("INVALID_JOB_TRANSITION", f"a job that is {before or 'unknown'} cannot become {status}")
        if stage != "job" and before is None:
            raise RecordError("INGESTION_JOB_NOT_FOUND", "there is no such job")
        change.touch("job_events", job_id)
        event = row_of(store, "job_events", job_id=job_id, seq=n, stage=stage, status=status, message=message, duration_ms=duration_ms, at=now())
        change.rows("job_events", store.saved("job_events", event))

    store.attempt(work)


def claim(store: Store) -> str | None:
    """Mark the oldest queued job as running, for the caller alone; its id, or null if none is queued.

    The claim touches the job, so it fails if another worker's came first. After
    each failure one more of the oldest jobs is chosen from, so that workers part.
    """
    tried = 0

    def work(state: Snapshot, change: Change) -> str | None:
        nonlocal tried
        tried += 1
        waiting = queued(jobs(store, state), "status", "created_at", "job_id").limit(tried).collect()
        if not waiting:
            return None
        job = random.choice(waiting)
        change.touch("job_events", job["job_id"])
        event = row_of(store, "job_events", job_id=job["job_id"], seq=job["n_events"], stage="job", status="running", message="", at=now())
        change.rows("job_events", store.saved("job_events", event))
        return job["job_id"]

    return store.attempt(work)


def create_job(store: Store, paths: list[str], replace: bool = True) -> str:
    """A queued job; its message holds the paths and options."""
    if not paths:
        raise RecordError("NO_UPLOAD_FILES", "a job needs at least one file")
    own = uuid.uuid4().hex
    emit(store, own, "job", "queued", json.dumps({"paths": paths, "replace": replace}))
    return own


def jobs(store: Store, at: Snapshot | None = None) -> DataFrame:
    """A row per job: status, paths and options, when it was created, started and ended, its events and the time they took."""
    own = F.col("stage") == "job"
    when = lambda s: F.min(F.when(own & (F.col("status") == s), F.col("at")))
    return store.read("job_events", at).groupBy("job_id").agg(
        F.max_by(F.when(own, F.col("status")), F.when(own, F.col("seq"))).alias("status"),
        F.min_by("message", "seq").alias("request"),
        when("queued").alias("created_at"),
        when("running").alias("started_at"),
        F.coalesce(when("completed"), when("failed")).alias("ended_at"),
        F.max_by(F.when(own & (F.col("status") == "failed"), F.col("message")), F.when(own, F.col("seq"))).alias("error"),
        F.count(F.lit(1)).alias("n_events"),
        F.sum("duration_ms").alias("total_ms"),
    )


def events(store: Store, job_id: str, stages: list[str] | None = None) -> DataFrame:
    """A job's events in order, those of some stages alone if asked for."""
    own = store.read("job_events").filter(F.col("job_id") == job_id)
    return (own.filter(F.col("stage").isin(*stages)) if stages else own).orderBy("seq")


def overview(store: Store) -> DataFrame:
    """One row: documents, parents, children and vectors, answers in the day, month and year, and jobs by status; all as of one version."""
    at = store.state()
    children = store.read("child_chunks", at)
    parts = {
        "index": index_stats(document_count=store.read("documents", at), parent_chunk_count=store.read("parent_chunks", at), child_chunk_count=children, vector_count=children.filter(F.size("embedding") > 0)),
        "queries": since_buckets(store.read("rag_traces", at), "created_at", F.lit(now())),
        "ingestion_jobs": status_pivot(jobs(store, at), "status", ["queued", "running", "completed", "failed"]),
    }
    row = store.spark.range(1).select(*[part.select(F.struct(*part.columns)).scalar().alias(name) for name, part in parts.items()])
    return row.select("index.*", "queries", "ingestion_jobs", readiness(F.col("index.vector_count"), F.col("index.child_chunk_count")).alias("readiness"))
