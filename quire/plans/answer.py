"""Contexts, prompts and citations for grounded answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import sse_event

#: The answer when nothing was found; the generator is not called.
NOTHING = "No relevant context was found in the index."
SYSTEM = "Answer from the given context alone and cite sources as [rank]. Say so if the context has no answer."


def context_section(rank: Column, score: Column, file_name: Column, refs: Column, path: Column, text: Column) -> Column:
    head = F.format_string("[%d] score=%.4f file=%s source=%s path=%s", rank, score, file_name, F.array_join(refs, ", "), F.array_join(path, " > "))
    return F.concat(head, F.lit("\n"), text)


def contexts(hits: DataFrame, group: list[str]) -> DataFrame:
    """Each query's sections, best first, as one text. A query has at most top_k hits."""
    section = context_section(F.col("rank"), F.col("score"), F.col("file_name"), F.col("source_refs"), F.col("parent_path"), F.col("parent_text"))
    return hits.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("context"))


def citations(hits: DataFrame, group: list[str]) -> DataFrame:
    cite = F.struct("rank", F.round("score", 6).alias("score"), "file_name", "source_refs", "parent_path")
    return hits.groupBy(*group).agg(F.array_sort(F.collect_list(cite)).alias("citations"))


def fallback(child: Column, parent: Column) -> Column:
    """A child's list, or its parent's where it is empty or null."""
    return F.when(F.size(child) > 0, child).otherwise(parent)


def prompt(question: Column, context: Column) -> Column:
    user = F.concat(F.lit("Question: "), question, F.lit("\n\nContext:\n"), context)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def delta_of(response: object) -> str:
    """The text of one piece of a generator's response: a mapping or object with a message, itself a mapping or object with content; else empty."""
    of = lambda x, name: x.get(name) if isinstance(x, Mapping) else getattr(x, name, None)
    return str(of(of(response, "message"), "content") or "")


def content_of(response: object) -> str:
    """The text of a generator's whole response, without space around it."""
    return delta_of(response).strip()


def answer(question: str, hits: DataFrame, generate: Callable[[list[dict]], str]) -> dict:
    """Answer one question with a generator on the driver; `hits` are its at most top_k rows."""
    rows = contexts(hits.withColumn("_q", F.lit(question)), ["_q"]).select(prompt(F.col("_q"), F.col("context")).alias("messages")).collect()
    if not rows:
        return {"answer": NOTHING, "citations": []}
    text = generate([m.asDict() for m in rows[0]["messages"]]).strip()
    if not text:
        raise ValueError("the generator gave no answer")
    cited = citations(hits.withColumn("_q", F.lit(question)), ["_q"]).first()["citations"]
    return {"answer": text, "citations": [c.asDict() for c in cited]}


def answer_events(question: str, hits: DataFrame, stream: Callable[[list[dict]], Iterator[str]]) -> Iterator[tuple[str, str]]:
    """(event, data) of a streamed answer: retrieval, each delta that is not empty, complete."""
    rows = contexts(hits.withColumn("_q", F.lit(question)), ["_q"]).select(prompt(F.col("_q"), F.col("context")).alias("messages")).collect()
    yield "retrieval", str(hits.count())
    parts = []
    for delta in stream([m.asDict() for m in rows[0]["messages"]]) if rows else [NOTHING]:
        if delta:
            parts.append(delta)
            yield "delta", delta
    yield "complete", "".join(parts).strip()


def event_rows(events: DataFrame) -> DataFrame:
    """Rows (seq, event, data) as the text of a server-sent stream each."""
    return events.select("seq", sse_event(F.col("event"), F.col("data")).alias("frame"))
