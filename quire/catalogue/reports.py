"""Reports on documents, jobs, traces, conversations and evaluations; changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalogue.tables import table
from quire.operators import admin
from quire.plans import evaluation, records
from quire.session import new_folder
from quire.store import Store
from quire.streaming.jobs import admitted



def document_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items (children) and distinct suppliers' rows (parents)."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), table(spark, sf_dir, "lineitem")
    parents = lines.select("l_orderkey", "l_suppkey").distinct()
    return admin.with_counts(orders, "o_orderkey", child_count=(lines, "l_orderkey"), parent_count=(parents, "l_orderkey"))


def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_list_counts(spark, sf_dir).filter("o_orderkey = 7")


def document_chunks_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus", "l_quantity", "l_partkey", "l_suppkey")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return admin.paged(rows, [F.col(c) for c in order], limit=100, offset=50)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.index_stats(**{t: table(spark, sf_dir, t) for t in ("documents", "embeddings", "pages")})


def index_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = admin.index_stats(vectors=table(spark, sf_dir, "embeddings"), children=table(spark, sf_dir, "documents"))
    return stats.select("vectors", "children", admin.readiness(F.col("vectors"), F.col("children")).alias("ready"))


def chat_session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.session_list(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def chat_session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "conv_id").limit(1)
    return table(spark, sf_dir, "conversations").join(F.broadcast(longest.select("conv_id")), "conv_id").select("conv_id", "turn", "role", "text")


def chat_title_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.session_title(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def trace_count_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.since_buckets(table(spark, sf_dir, "events"), "ts")


def job_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.status_pivot(table(spark, sf_dir, "events"), "event_type", ["signup", "purchase", "error", "view"])


def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs, their events as the jobs' own, in a store."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(order).cast("long"))
    found = records.jobs(job_store(spark, events.select(F.col("user_id").cast("string").alias("job_id"), "seq", F.col("event_type").alias("status"), "ts")))
    return found.select(F.col("job_id").cast("long").alias("user_id"), "status", "n_events")


def job_store(spark: SparkSession, rows: DataFrame) -> Store:
    """A store with these events (job_id, seq, status, ts) of jobs."""
    store = Store(spark, new_folder(spark, "jobs"))
    store.append("job_events", rows.select("job_id", "seq", F.lit("job").alias("stage"), "status", F.lit("").alias("message"), F.lit(None).cast("double").alias("duration_ms"), F.col("ts").cast("timestamp").alias("at")))
    return store


def stage_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") > 50, "slow").otherwise("fine")
    return admin.stage_snapshot(table(spark, sf_dir, "events"), "event_type", status, "value", "ts", "event_id").withColumn("total_ms", F.round("total_ms", 2))


def operation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.operation_metrics(table(spark, sf_dir, "events").withColumn("op", F.col("user_id") % 10), "op", F.col("event_type") == "error", "value").withColumn("duration_ms", F.round("duration_ms", 2))


def recent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.paged(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), [F.desc("ts"), F.desc("event_id")], limit=100, offset=100)


def recent_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recent_page by the last row of the page before it, in place of an offset."""
    rows, order = table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), [("ts", True), ("event_id", True)]
    first = admin.page_after(rows, order, limit=100).select("ts", "event_id").collect()
    return admin.page_after(rows, order, tuple(first[-1]) if first else None, limit=100)


def document_chunks_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items that follow one of order 7, by order and line."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return admin.page_after(rows, [("l_orderkey", False), ("l_linenumber", False)], (7, 3), limit=50)


def event_array_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = admin.event_arrays(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")
    return arrays.select("user_id", F.array_join(F.transform("events", lambda e: F.concat(e["event_id"].cast("string"), F.lit(":"), e["event_type"])), ",").alias("events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "event_id", "ts", at.alias("at"))


def rate_limit_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.offered_in_window(requests(spark, sf_dir), "client", "ts", 86_400).select("client", "event_id", "offered")


def rate_limit_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(requests(spark, sf_dir), limit=3, seconds=7 * 86_400).select("client", "event_id", "admitted")


def queue_claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs, signups as queued ones: two workers claim one each, the oldest first."""
    status = F.when(F.col("event_type") == "signup", "queued").otherwise("completed")
    events = table(spark, sf_dir, "events").select(F.format_string("%012d", "event_id").alias("job_id"), F.lit(0).cast("long").alias("seq"), status.alias("status"), "ts")
    store = job_store(spark, events)
    claimed = [records.claim(store) for _ in range(2)]
    found = records.jobs(store).filter(F.col("job_id").isin(*[c for c in claimed if c]) if any(claimed) else F.lit(False))
    return found.select(F.col("job_id").cast("long").alias("event_id"), "status", "n_events")


def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a store, those of src3 replaced there by a new version that keeps when they were first seen."""
    store = Store(spark, new_folder(spark, "upsert"), {"docs": "doc_id long, source string, version int, first_seen int, n_chars long"})
    old = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).alias("version"), F.lit(1).alias("first_seen"), F.col("n_chars").cast("long").alias("n_chars"))
    store.append("docs", old)
    store.upsert("docs", old.filter("source = 'src3'").withColumns({"version": F.lit(2), "first_seen": F.lit(2), "n_chars": F.col("n_chars") + 1}), ["doc_id"], keep={"first_seen": "first_seen"})
    return store.read("docs")


def semi_join_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in a store, those of finished (F) orders deleted there, counted by supplier."""
    store = Store(spark, new_folder(spark, "delete"), {"lines": "l_orderkey long, l_suppkey long"})
    store.append("lines", table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_suppkey")]))
    store.delete("lines", "l_orderkey", table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")))
    return store.read("lines").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, safe = F.col("quality") == 1, F.col("toxic") == 0
    return evaluation.summary(table(spark, sf_dir, "labels"), good & safe, good, safe).select("total_cases", "passed_cases", "failed_cases", "retrieval_passed_cases", "source_hit_rate", "answer_term_pass_rate")


def case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return evaluation.selected(cases, ["3", "1", "none", "3"]).select(F.col("position").cast("long").alias("position"), "id", "text")


def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))


def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_title_rule(spark, sf_dir).filter(F.lower("title").contains("the"))


def file_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each (source, length)."""
    return admin.first_by(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source", "n_chars"], "doc_id")


ORACLE_SQL = {
    "document_list_counts": """
        SELECT o_orderkey, o_orderstatus, coalesce(c, 0)::BIGINT AS child_count, coalesce(p, 0)::BIGINT AS parent_count FROM orders
        LEFT JOIN (SELECT l_orderkey, count(*) AS c, count(DISTINCT l_suppkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "document_detail": """
        SELECT o_orderkey, o_orderstatus, coalesce(c, 0)::BIGINT AS child_count, coalesce(p, 0)::BIGINT AS parent_count FROM orders
        LEFT JOIN (SELECT l_orderkey, count(*) AS c, count(DISTINCT l_suppkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey = 7""",
    "document_chunks_page": "SELECT l_orderkey, l_linenumber, o_orderstatus, l_quantity, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 100 OFFSET 50",
    "index_stats": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM pages) AS pages",
    "index_readiness": "SELECT v AS vectors, c AS children, least(100, round(v * 100.0 / c))::INTEGER AS ready FROM (SELECT (SELECT count(*) FROM embeddings) AS v, (SELECT count(*) FROM documents) AS c)",
    "chat_session_list": "SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_text FROM conversations GROUP BY conv_id",
    "chat_session_messages": "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, conv_id LIMIT 1)",
    "chat_title_rule": "SELECT conv_id, coalesce(left(arg_min(text, turn) FILTER (WHERE text <> ''), 80), 'New chat') AS title FROM conversations GROUP BY conv_id",
    "trace_count_buckets": """
        SELECT count(*) FILTER (WHERE ts >= date_trunc('day', m)) AS today, count(*) FILTER (WHERE ts >= date_trunc('month', m)) AS this_month, count(*) FILTER (WHERE ts >= date_trunc('year', m)) AS this_year, count(*) AS total
        FROM events, (SELECT max(ts) AS m FROM events)""",
    "job_status_pivot": "SELECT " + ", ".join(f"count(*) FILTER (WHERE event_type = '{s}') AS {s}" for s in ("signup", "purchase", "error", "view")) + ", count(*) AS total FROM events",
    "job_latest_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events GROUP BY user_id",
    "stage_snapshot": "SELECT event_type, count(*) AS n_events, round(sum(value), 2) AS total_ms, arg_max(CASE WHEN value > 50 THEN 'slow' ELSE 'fine' END, (ts, event_id)) AS status FROM events GROUP BY event_type",
    "operation_metrics": "SELECT user_id % 10 AS op, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(value), 2) AS duration_ms FROM events GROUP BY 1",
    "recent_page": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 100",
    "recent_page_after": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 100",
    "document_chunks_after": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey > 7 OR (l_orderkey = 7 AND l_linenumber > 3) ORDER BY l_orderkey, l_linenumber LIMIT 50",
    "event_array_append": "SELECT user_id, string_agg(event_id || ':' || event_type, ',' ORDER BY ts, event_id) AS events FROM events GROUP BY user_id",
    "rate_limit_offered": "SELECT user_id AS client, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS offered FROM events",
    "rate_limit_admitted": f"""
        WITH RECURSIVE e AS (SELECT user_id AS client, list(event_id ORDER BY ts, event_id) AS ids, list(epoch_us(ts) ORDER BY ts, event_id) AS ats FROM events GROUP BY user_id),
        r AS (
            SELECT client, ids, ats, 0 AS i, []::BIGINT[] AS kept, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted FROM e
            UNION ALL
            SELECT client, ids, ats, i + 1, CASE WHEN len(kept_now) < 3 THEN list_append(kept_now, t) ELSE kept_now END, ids[i + 1], len(kept_now) < 3 FROM (
                SELECT *, list_filter(kept, lambda x: x >= t - {7 * 86_400 * 1_000_000}) AS kept_now FROM (SELECT *, ats[i + 1] AS t FROM r WHERE i < len(ids)))
        )
        SELECT client, event_id, admitted FROM r WHERE i > 0""",
    "queue_claim_next": "SELECT event_id, 'running' AS status, 2::BIGINT AS n_events FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 2",
    "upsert_replace": "SELECT doc_id, source, CASE WHEN source = 'src3' THEN 2 ELSE 1 END AS version, 1 AS first_seen, CASE WHEN source = 'src3' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents",
    "semi_join_delete": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_suppkey",
    "eval_summary": """
        SELECT count(*) AS total_cases, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS passed_cases, count(*) FILTER (WHERE NOT (quality = 1 AND toxic = 0)) AS failed_cases,
               count(*) FILTER (WHERE quality = 1) AS retrieval_passed_cases, round(count(*) FILTER (WHERE quality = 1) / count(*)::DOUBLE, 4) AS source_hit_rate,
               round(count(*) FILTER (WHERE toxic = 0) / count(*)::DOUBLE, 4) AS answer_term_pass_rate FROM labels""",
    "case_selection": "SELECT p AS position, item_id::VARCHAR AS id, text FROM benchmark JOIN (VALUES (0::BIGINT, 3), (1, 1), (3, 3)) t(p, i) ON item_id = i",
    "source_totals": "SELECT source, lang, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source, lang",
    "title_filter": "SELECT * FROM (SELECT conv_id, coalesce(left(arg_min(text, turn) FILTER (WHERE text <> ''), 80), 'New chat') AS title FROM conversations GROUP BY conv_id) WHERE contains(lower(title), 'the')",
    "file_dedupe": "SELECT min(doc_id) AS doc_id, source, n_chars FROM documents GROUP BY source, n_chars",
}
QUERIES = {f.__name__: f for f in (
    document_list_counts, document_detail, document_chunks_page, index_stats, index_readiness, chat_session_list, chat_session_messages, chat_title_rule, trace_count_buckets,
    job_status_pivot, job_latest_state, stage_snapshot, operation_metrics, recent_page, recent_page_after, document_chunks_after, event_array_append, rate_limit_offered, rate_limit_admitted, queue_claim_next, upsert_replace,
    semi_join_delete, eval_summary, case_selection, source_totals, title_filter, file_dedupe,
)}
