"""Evaluation of retrieval and answers against cases."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import Retrieval
from quire.functions.text import excerpt, match_form, missing_terms
from quire.operators.embeddings import Provider
from quire.plans.answer import answer

CASE = "id string, question string, expected_answer_terms array<string>, expected_context_terms array<string>, expected_source_files array<string>, tags array<string>"


def cases(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Evaluation cases: (id, question, answer terms, context terms, source files, tags)."""
    return spark.createDataFrame(rows, CASE)


def selected(all_cases: DataFrame, ids: list[str]) -> DataFrame:
    """Cases in the order asked for, repeats kept, unknown ids dropped; all by id if none is asked for."""
    if not ids:
        return all_cases.withColumn("position", F.lit(0))
    asked = all_cases.sparkSession.createDataFrame(list(enumerate(ids)), "position int, id string")
    return all_cases.join(F.broadcast(asked), "id")  # a request's ids


def context_text(hits: DataFrame, group: list[str]) -> DataFrame:
    """What each case's hits say, best first: file, references, path, child and parent text."""
    parts = F.array_join(F.array(F.coalesce("file_name", F.lit("")), F.array_join("source_refs", " "), F.array_join("parent_path", " > "), F.col("child_text"), F.col("parent_text")), "\n")
    ordered = F.array_sort(F.collect_list(F.struct("rank", parts.alias("t"))))
    return hits.groupBy(*group).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("context"))


def context_rows(hits: DataFrame) -> DataFrame:
    return hits.select("case_id", "rank", "score", "file_name", "source_refs", "parent_path", excerpt(F.col("parent_text")).alias("text_excerpt"))


def results(all_cases: DataFrame, hits: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """A row per case: missing terms, the rank of the first expected source, what passed.

    `hits`: case_id, rank, file_name, source_refs, parent_path, child_text,
    parent_text; `answers`: case_id, answer. Without answers nothing of them counts.
    """
    found = context_text(hits, ["case_id"])
    expected = all_cases.select(F.col("id").alias("case_id"), F.explode("expected_source_files").alias("f")).select("case_id", F.lower("f").alias("file"))
    ranks = hits.select("case_id", "rank", F.lower("file_name").alias("file")).join(expected, ["case_id", "file"]).groupBy("case_id").agg(F.min("rank").alias("source_rank"))
    rows = all_cases.withColumnRenamed("id", "case_id").join(found, "case_id", "left").join(ranks, "case_id", "left")
    rows = rows.withColumn("_form", match_form(F.coalesce("context", F.lit("")))).withColumn("missing_context_terms", missing_terms(F.col("_form"), F.col("expected_context_terms")))
    rows = rows.withColumn("retrieval_passed", (F.size("missing_context_terms") == 0) & ((F.size("expected_source_files") == 0) | F.col("source_rank").isNotNull()))
    if answers is None:
        rows = rows.withColumn("answer_passed", F.lit(None).cast("boolean")).withColumn("missing_answer_terms", F.array().cast("array<string>"))
    else:
        rows = rows.join(answers, "case_id", "left").withColumn("_form", match_form(F.coalesce("answer", F.lit(""))))
        rows = rows.withColumn("missing_answer_terms", missing_terms(F.col("_form"), F.col("expected_answer_terms")))
        rows = rows.withColumn("answer_passed", F.size("missing_answer_terms") == 0)
    return rows.withColumn("status", F.when(F.col("retrieval_passed") & F.coalesce("answer_passed", F.lit(True)), "passed").otherwise("failed")).drop("context", "_form")


def summary(rows: DataFrame, passed: Column, retrieval: Column, answer: Column | None = None, ms: str | None = None) -> DataFrame:
    """One row; source_hit_rate is the rate of passed retrievals, as its name has come to mean."""
    n = F.count(F.lit(1))
    rate = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(c), n), 4), F.lit(0.0))
    out = [
        n.alias("total_cases"),
        F.count_if(passed).alias("passed_cases"),
        F.count_if(~passed).alias("failed_cases"),
        F.count_if(retrieval).alias("retrieval_passed_cases"),
        rate(retrieval).alias("source_hit_rate"),
        (rate(answer) if answer is not None else F.lit(None).cast("double")).alias("answer_term_pass_rate"),
    ]
    if ms:
        out.append(F.coalesce(F.round(F.avg(ms), 3), F.lit(0.0)).alias("mean_ms"))
    return rows.agg(*out)


class Searchable(Protocol):
    """What an evaluation asks: a store with indexes, or a caller's own."""

    spark: SparkSession

    def retrieve(self, query: str, vector: Sequence[float], options: Retrieval | None = None) -> DataFrame: ...


HIT = "case_id string, rank int, score double, file_name string, source_refs array<string>, parent_path array<string>, child_text string, parent_text string"
TIMED = "case_id string, answer string, retrieval_ms double, answer_ms double, total_ms double"


def since(began: float) -> float:
    """Milliseconds since a time of the performance counter, to three digits."""
    return round((time.perf_counter() - began) * 1000, 3)


def run(store: Searchable, all_cases: DataFrame, provider: Provider, ids: Sequence[str] = (), top_k: int = 5, generate: Callable[[list[dict]], str] | None = None) -> tuple[DataFrame, dict]:
    """Retrieve, and with a generator answer, the selected cases one by one; (a row per case with its times, the summary).

    Cases are few and their times are part of what is asked for; each has `top_k`
    hits at most. All of them are judged together.
    """
    chosen = selected(all_cases, list(ids)).orderBy("position", "id").select("position", *all_cases.columns)
    rows = chosen.collect()
    names = [part.split()[0] for part in HIT.split(", ")]
    hits, timed = [], []
    for row in {r["id"]: r for r in rows}.values():
        began = time.perf_counter()
        found = store.retrieve(row["question"], [float(x) for x in provider.embed([row["question"]])[0]], Retrieval(top_k=top_k))
        own = [tuple(h[c] for c in names[1:]) for h in found.select(*names[1:]).collect()]
        retrieval_ms, text, answer_ms = since(began), None, None
        held = store.spark.createDataFrame([(row["id"], *h) for h in own], HIT)
        if generate is not None:
            answered = time.perf_counter()
            text, answer_ms = answer(row["question"], held, generate)["answer"], since(answered)
        hits += [(row["id"], *h) for h in own]
        timed.append((row["id"], text, retrieval_ms, answer_ms, since(began)))
    spark = store.spark
    times = spark.createDataFrame(timed, TIMED)
    judged = results(chosen.drop("position").dropDuplicates(["id"]), spark.createDataFrame(hits, HIT), times.select("case_id", "answer") if generate else None)
    judged = judged.drop("answer").join(times, "case_id").join(chosen.select(F.col("id").alias("case_id"), "position"), "case_id")
    # With a case asked for twice its row counts twice, as it would if it were run twice.
    means = {c: summary(judged.filter(F.col(c).isNotNull()), F.lit(True), F.lit(True), ms=c).first()["mean_ms"] for c in ("retrieval_ms", "answer_ms", "total_ms")}
    out = summary(judged, F.col("status") == "passed", F.col("retrieval_passed"), F.col("answer_passed") if generate else None).first().asDict()
    return judged.orderBy("position", "case_id"), out | {f"mean_{c}": means[c] if c != "answer_ms" or generate else None for c in means}
