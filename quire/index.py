"""A store whose searches read stored indexes in place of all texts and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import Retrieval, candidate_limit, query_text
from quire.log import Change
from quire.operators.retrieval import finished, merge, ranked_list, top
from quire.operators.text_index import TextIndex
from quire.operators.vector_index import VectorIndex
from quire.plans.answer import fallback
from quire.store import INDEX, Store

TABLES = (*INDEX, "postings", "text_targets", "vector_cells")


def unit(kind: str, column: str) -> Column:
    """A unit's name: chunks, parents and file names have ids of their own."""
    return F.concat(F.lit(f"{kind}:"), F.col(column))


class SearchStore(Store):
    """A store that keeps postings and vector cells with each commit of documents and their chunks."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, range_bits: int = 10, centres: int = 64):
        super().__init__(spark, root)
        self.text, self.vectors = TextIndex(self, buckets, range_bits), VectorIndex(self, centres)

    def index_change(self, documents: DataFrame, parents: DataFrame, children: DataFrame, replace: bool = True) -> Change:
        change = super().index_change(documents, parents, children, replace)
        written = {a["table"]: self.spark.read.schema(self.schema(a["table"])).parquet(a["path"]) for a in change.actions if a["kind"] == "rows"}
        docs, parents, children = (written[t] for t in INDEX)
        units = children.select(unit("c", "id").alias("unit"), F.col("document_id").alias("owner"), "text")
        units = units.union(parents.select(unit("p", "id"), "document_id", "text")).union(docs.select(unit("f", "id"), "id", "file_name"))
        targets = children.select(F.col("id").alias("target"), F.col("document_id").alias("owner"), F.array(unit("c", "id"), unit("p", "parent_chunk_id"), unit("f", "document_id")).alias("units"))
        self.text.put(change, units, targets, replace)
        named = docs.select(F.col("id").alias("owner"), "file_name", "file_type")
        self.vectors.put(change, children.select("id", F.col("document_id").alias("owner"), "embedding").join(named, "owner"), replace)
        return change

    def delete_change(self, document_id: str) -> Change:
        change, owners = super().delete_change(document_id), self.spark.createDataFrame([(document_id,)], "owner string")
        self.text.remove(change, owners)
        self.vectors.remove(change, owners)
        return change

    def clear(self, tables: tuple[str, ...] = INDEX) -> None:
        super().clear(TABLES if set(INDEX) <= set(tables) else tables)

    def chunks(self, ids: DataFrame) -> DataFrame:
        """child_id, document_id, file_name, file_type, child_text, parent_text, embedding, source_refs and parent_path (a child's, else its parent's) of a few chunks (a column child_id)."""
        own = self.read("child_chunks").select(F.col("id").alias("child_id"), "document_id", "parent_chunk_id", F.col("text").alias("child_text"), "embedding", "source_refs", "parent_path").join(F.broadcast(ids), "child_id")
        parents = self.read("parent_chunks").select(F.col("id").alias("parent_chunk_id"), F.col("text").alias("parent_text"), F.col("source_refs").alias("_refs"), F.col("parent_path").alias("_path"))
        documents = self.read("documents").select(F.col("id").alias("document_id"), "file_name", "file_type")
        rows = own.join(parents, "parent_chunk_id").join(documents, "document_id").drop("parent_chunk_id")
        return rows.withColumns({"source_refs": fallback(F.col("source_refs"), F.col("_refs")), "parent_path": fallback(F.col("parent_path"), F.col("_path"))}).drop("_refs", "_path")

    def retrieve(self, query: str, vector: Sequence[float], options: Retrieval | None = None) -> DataFrame:
        """`operators.retrieval.retrieve` over the stored chunks, from the indexes: the same rows and scores."""
        options = options or Retrieval()
        query, n = query_text(query), candidate_limit(options.top_k)
        by_vector = [F.desc("vector_score"), F.col("child_id")]
        nearest = self.vectors.search(vector, n, options.filters).rows.select(F.col("id").alias("child_id"), "vector_score")
        vector_hits = ranked_list(top(nearest, by_vector, n), by_vector, "vector_rank")
        wanted = {k: v for k, v in options.filters.items() if v and k in ("file_name", "file_type", "document_id")}
        # Filters choose among all matches; without any the index stops at the n best and their equals.
        matched = self.text.search(query, None if wanted else n).rows.select(F.col("target").alias("id"), "lexical_score")
        scored = self.vectors.scores(vector, matched, options.filters).withColumnRenamed("id", "child_id")
        by_text = [F.desc("lexical_score"), F.desc("vector_score"), F.col("child_id")]
        lexical_hits = ranked_list(top(scored.select("child_id", "vector_score", "lexical_score"), by_text, n), by_text, "lexical_rank")
        merged = merge(vector_hits, lexical_hits, "child_id")
        # At most twice the candidate limit, 400 rows.
        return finished(self.chunks(merged).drop("embedding"), query, options)
