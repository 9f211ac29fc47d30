"""Vector, lexical and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalogue.tables import chunks, query_vector, table
from quire.config import STOP_WORDS, Retrieval
from quire.index import SearchStore
from quire.log import Change
from quire.operators import retrieval as R
from quire.operators.text_index import TextIndex
from quire.operators.validate import sound_vector
from quire.operators.vector_index import VectorIndex
from quire.plans import answer
from quire.session import new_folder
from quire.store import Store

QUERY = "licensed"
WORDS_SQL = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+')"
STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
SINGULAR_SQL = "CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN length(w) > 3 AND w LIKE '%s' THEN regexp_replace(w, 's$', '') ELSE w END"
PLURAL_SQL = "CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN length(w) > 3 AND regexp_matches(w, '[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END"
STEM_SQL = "CASE WHEN length(p) > 5 AND p LIKE '%ing' THEN regexp_replace(p, 'ing$', '') WHEN length(p) > 4 AND p LIKE '%ed' THEN regexp_replace(p, 'ed$', '') ELSE p END"


def stems_sql(text: str) -> str:
    return f"list_transform(list_transform(list_filter({WORDS_SQL.format(text)}, lambda w: w NOT IN ({STOP_SQL})), lambda w: {PLURAL_SQL}), lambda p: {STEM_SQL})"


def meaningful_sql(text: str) -> str:
    return f"list_transform(list_filter({WORDS_SQL.format(text)}, lambda w: w NOT IN ({STOP_SQL})), lambda w: {SINGULAR_SQL})"


Q_SQL = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COS_SQL = f"list_cosine_similarity(e.embedding::DOUBLE[], {Q_SQL})"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vector(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", R.cosine(F.col("embedding"), q).alias("s"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return vectors.join(documents, F.col("vec_id") == F.col("doc_id"))


def ranked(rows: DataFrame, n: int) -> DataFrame:
    order = [F.desc("s"), F.col("vec_id")]
    return R.ranked_list(R.top(rows, order, n), order, "rank").select(F.col("rank").cast("long").alias("rank"), "vec_id", "lang", "source", F.round("s", 6).alias("score"))


def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(scored(spark, sf_dir), 10)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumnRenamed("lang", "file_type")
    return ranked(R.filtered(rows, {"file_type": "fr", "file_name": "", "other": "x"}).withColumnRenamed("file_type", "lang"), 10)


def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vector(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", R.cosine(F.col("embedding"), q).alias("s"))
    order = Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 3").select("label", "rank", "vec_id", F.round("s", 6).alias("score"))


def knn_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vector(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").filter("vec_id <> 0").select("label", "vec_id", R.cosine(F.col("embedding"), q).alias("s"))
    nearest = R.top(rows, [F.desc("s"), F.col("vec_id")], 25)
    return nearest.groupBy("label").agg(F.count(F.lit(1)).alias("votes"), F.round(F.sum("s"), 6).alias("weight"))


def vector_norm_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    first = F.array_join(F.transform(F.slice(e, 1, 8), lambda x: F.round(x.cast("double"), 4).cast("decimal(12,4)").cast("string")), ",")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).cast("long").alias("dimensions"), F.round(R.norm(e), 6).alias("l2_norm"), sound_vector(e, 64).alias("sound"), first.alias("first_values"))


def lexical_match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(R.text_matches(F.col("text"), "with licensed")).select("doc_id", "source")


def lexical_single_term_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").filter(R.text_matches(F.col("text"), QUERY))
    return documents.select("doc_id", F.round(R.cover_density(F.col("text"), QUERY), 6).alias("lexical_score"))


def lexical_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = 'licensed "general public" or "creative commons" -mit'
    documents = table(spark, sf_dir, "documents").filter(R.text_matches(F.col("text"), query))
    return documents.select("doc_id", F.round(R.cover_density(F.col("text"), "licensed public"), 6).alias("lexical_score"))


def phrase_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.round(R.phrase_overlap("Which works are licensed under the general licenses with this?", F.col("source"), F.col("text")), 6).alias("phrase_score"))


def hits(spark: SparkSession, sf_dir: str, query: str, top_k: int = 5) -> DataFrame:
    return R.retrieve(chunks(spark, sf_dir), query, query_vector(spark, sf_dir), Retrieval(top_k=top_k))


def hit_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("rank").cast("long").alias("rank"), F.col("child_id").alias("doc_id"), F.round("vector_score", 6).alias("vector_score"), F.round("lexical_score", 6).alias("lexical_score"), F.round("score", 6).alias("score"))


def hybrid_merge_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_columns(hits(spark, sf_dir, QUERY))


def hybrid_vector_only_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_columns(hits(spark, sf_dir, "zzqxunmatched"))


def unique_document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranked(scored(spark, sf_dir), 50)
    return R.unique_sources(best, F.col("source"))


def first_source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranked(scored(spark, sf_dir), 50).withColumnRenamed("source", "file_name")
    return R.first_source_rank(best, ["SRC3", "src7"]).select(F.col("source_rank").cast("long").alias("source_rank"))


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """A stored index of all documents' texts, built in two commits, merged, and with the texts of one source put in again."""
    index = TextIndex(Store(spark, new_folder(spark, "text-index")), buckets=32, range_bits=8)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit"), F.col("doc_id").cast("string").alias("owner"), "text", "source")
    odd = F.col("source").isin("src1", "src3", "src5")
    for part, merge in ((rows.filter(odd), False), (rows.filter(~odd | odd.isNull()), True), (rows.filter("source = 'src3'"), False)):
        change = Change()
        index.put(change, part.drop("source"), part.select(F.col("unit").alias("target"), "owner", F.array("unit").alias("units")))
        index.store.commit(change)
        if merge:
            index.compact()
    return index


def lexical_index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lexical_match_all_terms from the stored index."""
    found = text_index(spark, sf_dir).search("with licensed").rows.select(F.col("target").cast("long").alias("doc_id"))
    return found.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


def lexical_index_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, alternatives and excluded words from the stored index."""
    found = text_index(spark, sf_dir).search('licensed "general public" or "creative commons" -mit').rows
    return found.select(F.col("target").cast("long").alias("doc_id"))


def lexical_index_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of the best cover density, from the blocks that can hold them."""
    order = [F.desc("lexical_score"), F.col("doc_id")]
    found = text_index(spark, sf_dir).search("licensed public", 20).rows
    best = R.top(found.select(F.col("target").cast("long").alias("doc_id"), F.round("lexical_score", 6).alias("lexical_score")), order, 20)
    return R.ranked_list(best, order, "rank").select(F.col("rank").cast("long").alias("rank"), "doc_id", "lexical_score")


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_topk_cosine from stored cells, read as far as the tenth best needs."""
    store = Store(spark, new_folder(spark, "vector-index"))
    index, change = VectorIndex(store), Change()
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    vectors = table(spark, sf_dir, "embeddings").join(documents, F.col("vec_id") == F.col("doc_id"))
    index.put(change, vectors.select(F.format_string("%012d", "vec_id").alias("id"), F.col("doc_id").cast("string").alias("owner"), F.col("source").alias("file_name"), F.col("lang").alias("file_type"), "embedding"))
    store.commit(change)
    found = index.search(query_vector(spark, sf_dir), 10).rows
    return ranked(found.select(F.col("id").cast("long").alias("vec_id"), F.col("file_type").alias("lang"), F.col("file_name").alias("source"), F.col("vector_score").alias("s")), 10)


def hybrid_index_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hybrid_merge_rerank from a store's indexes: each document with a vector is a document, a parent without text and a child."""
    store = SearchStore(spark, new_folder(spark, "search"), buckets=32, range_bits=8)
    rows = chunks(spark, sf_dir).withColumn("id", F.format_string("%012d", "child_id"))
    fill = lambda frame, name: frame.select(*[F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in store.schema(name).fields])
    documents = fill(rows.select("id", "file_name", "file_type"), "documents")
    parents = fill(rows.select("id", F.col("id").alias("document_id"), F.col("parent_text").alias("text")), "parent_chunks")
    children = fill(rows.select("id", F.col("id").alias("document_id"), F.col("id").alias("parent_chunk_id"), F.col("child_text").alias("text"), "embedding"), "child_chunks")
    store.index_documents(documents, parents, children)
    found = store.retrieve(QUERY, query_vector(spark, sf_dir), Retrieval(top_k=5))
    return hit_columns(found.withColumn("child_id", F.col("child_id").cast("long")))


def context_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = ranked(scored(spark, sf_dir), 10).join(documents, F.col("vec_id") == F.col("doc_id"))
    section = answer.context_section(F.col("rank"), F.col("score"), F.col("source"), F.array("lang"), F.array("lang", "source"), F.col("text"))
    return best.select("rank", section.alias("section"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranked(scored(spark, sf_dir), 10).select(F.lit("q").alias("query"), "rank", "score", F.col("source").alias("file_name"), F.array("lang").alias("source_refs"), F.array("lang", "source").alias("parent_path"))
    cited = answer.citations(best, ["query"]).select(F.explode("citations").alias("c"))
    return cited.select("c.rank", F.col("c.file_name").alias("file_name"), F.array_join("c.source_refs", ",").alias("refs"), F.array_join("c.parent_path", " > ").alias("path"), F.col("c.score").alias("score"))


TOP_SQL = f"""
    SELECT row_number() OVER (ORDER BY s DESC, vec_id) AS rank, vec_id, lang, source, round(s, 6) AS score FROM (
        SELECT e.vec_id, d.lang, d.source, {COS_SQL} AS s FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id {{where}}
        ORDER BY s DESC, e.vec_id LIMIT {{n}})
"""
HYBRID_SQL = f"""
    WITH c AS (
        SELECT d.doc_id, d.text, d.source, {COS_SQL} AS v, {stems_sql("d.text || '  ' || d.source")} AS stems, {stems_sql("d.text")} AS own, {stems_sql("d.source")} AS named
        FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id
    ), t AS (SELECT *, 0.1 * len(list_filter(stems, lambda s: s = '{{stem}}')) AS lex, list_contains(own, '{{stem}}') OR list_contains(named, '{{stem}}') AS hit FROM c),
    vec AS (SELECT doc_id, row_number() OVER (ORDER BY v DESC, doc_id) AS vr FROM t QUALIFY vr <= 50),
    lexi AS (SELECT doc_id, row_number() OVER (ORDER BY lex DESC, v DESC, doc_id) AS lr FROM t WHERE hit QUALIFY lr <= 50),
    m AS (
        SELECT t.doc_id, v, lex, vr, lr,
               CASE WHEN len(list_filter({meaningful_sql("t.source || ' ' || t.text")}, lambda w: w = '{{token}}')) > 0 THEN 1.0 ELSE 0.0 END AS phrase,
               bool_or(lr IS NOT NULL) OVER () AS any_lex
        FROM t LEFT JOIN vec USING (doc_id) LEFT JOIN lexi USING (doc_id) WHERE vr IS NOT NULL OR lr IS NOT NULL
    ), s AS (SELECT *, CASE WHEN any_lex THEN least(round(0.62 * greatest(v, 0) + 0.30 * least(lex * 8, 1) + 0.08 * phrase, 12), 1.0) ELSE greatest(v, 0) END AS score FROM m),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, greatest(v, 0) DESC, coalesce(vr, 201), coalesce(lr, 201), doc_id) AS rank FROM s)
    SELECT rank, doc_id, round(greatest(v, 0), 6) AS vector_score, round(lex, 6) AS lexical_score, round(score, 6) AS score FROM r WHERE rank <= 5
"""
# Stop words keep their places as empty strings, so that they part a phrase.
PLACED_SQL = f"list_transform({WORDS_SQL.format('text')}, lambda w: CASE WHEN w IN ({STOP_SQL}) THEN '' ELSE list_transform([{PLURAL_SQL}], lambda p: {STEM_SQL})[1] END)"
COVER_SQL = f"""
    WITH s AS (SELECT doc_id, {PLACED_SQL} AS stems FROM documents),
    m AS (SELECT *, ' ' || array_to_string(stems, ' ') || ' ' AS whole FROM s),
    hit AS (SELECT doc_id, stems FROM m WHERE (list_contains(stems, 'licens') AND contains(whole, ' general public ')) OR (contains(whole, ' creative common ') AND NOT list_contains(stems, 'mit'))),
    word AS (SELECT doc_id, unnest(stems) AS stem, unnest(range(0, len(stems))) AS pos FROM hit),
    span AS (SELECT doc_id, pos, max(CASE WHEN stem = 'licens' THEN pos END) OVER w AS a, max(CASE WHEN stem = 'public' THEN pos END) OVER w AS b FROM word WHERE stem IN ('licens', 'public') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    cover AS (SELECT doc_id, least(a, b) AS begin, min(pos) AS last FROM span WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id, least(a, b)),
    total AS (SELECT doc_id, sum(0.1::DOUBLE / (1 + last - begin - 1)) AS score FROM cover GROUP BY doc_id)
    SELECT doc_id, round(coalesce(score, 0::DOUBLE), 6) AS lexical_score FROM hit LEFT JOIN total USING (doc_id)
"""
ORACLE_SQL = {
    "lexical_cover_density": COVER_SQL,
    "vector_topk_cosine": TOP_SQL.format(where="", n=10),
    "vector_topk_filtered": TOP_SQL.format(where="WHERE d.lang = 'fr'", n=10),
    "vector_topk_per_label": f"SELECT label, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank, vec_id, round(s, 6) AS score FROM (SELECT label, vec_id, {COS_SQL} AS s FROM embeddings e) QUALIFY rank <= 3",
    "knn_label_vote": f"SELECT label, count(*) AS votes, round(sum(s), 6) AS weight FROM (SELECT label, {COS_SQL} AS s FROM embeddings e WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 25) GROUP BY label",
    "vector_norm_preview": """SELECT vec_id, len(embedding) AS dimensions, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS l2_norm,
        len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AS sound,
        array_to_string(list_transform(embedding[1:8], lambda x: round(x::DOUBLE, 4)::DECIMAL(12, 4)::VARCHAR), ',') AS first_values FROM embeddings""",
    "lexical_match_all_terms": f"SELECT doc_id, source FROM (SELECT doc_id, source, {stems_sql('text')} AS s FROM documents) WHERE list_contains(s, 'with') AND list_contains(s, 'licens')",
    "lexical_single_term_tf": f"SELECT doc_id, round(0.1 * len(list_filter(s, lambda x: x = 'licens')), 6) AS lexical_score FROM (SELECT doc_id, {stems_sql('text')} AS s FROM documents) WHERE list_contains(s, 'licens')",
    "phrase_overlap_score": f"""SELECT doc_id, round(len(list_filter(q, lambda w: list_contains(t, w))) / len(q)::DOUBLE, 6) AS phrase_score FROM (
        SELECT doc_id, {meaningful_sql("source || ' ' || text")} AS t, {meaningful_sql("'Which works are licensed under the general licenses with this?'")} AS q FROM documents)""",
    "hybrid_merge_rerank": HYBRID_SQL.format(stem="licens", token="licensed"),
    "hybrid_vector_only_fallback": HYBRID_SQL.format(stem="zzqxunmatch", token="zzqxunmatched"),
    "lexical_index_match": f"SELECT doc_id, source FROM (SELECT doc_id, source, {stems_sql('text')} AS s FROM documents) WHERE list_contains(s, 'with') AND list_contains(s, 'licens')",
    "lexical_index_phrases": f"SELECT doc_id FROM ({COVER_SQL})",
    "lexical_index_top": f"""
        WITH s AS (SELECT doc_id, {PLACED_SQL} AS stems FROM documents),
        word AS (SELECT doc_id, unnest(stems) AS stem, unnest(range(0, len(stems))) AS pos FROM s WHERE list_contains(stems, 'licens') AND list_contains(stems, 'public')),
        span AS (SELECT doc_id, pos, max(CASE WHEN stem = 'licens' THEN pos END) OVER w AS a, max(CASE WHEN stem = 'public' THEN pos END) OVER w AS b FROM word WHERE stem IN ('licens', 'public') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        cover AS (SELECT doc_id, least(a, b) AS begin, min(pos) AS last FROM span WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id, least(a, b)),
        total AS (SELECT doc_id, round(sum(0.1::DOUBLE / (1 + last - begin - 1)), 6) AS lexical_score FROM cover GROUP BY doc_id)
        SELECT row_number() OVER (ORDER BY lexical_score DESC, doc_id) AS rank, doc_id, lexical_score FROM total QUALIFY rank <= 20""",
    "vector_index_topk": TOP_SQL.format(where="", n=10),
    "hybrid_index_rerank": HYBRID_SQL.format(stem="licens", token="licensed"),
    "unique_document_sources": f"WITH t AS ({TOP_SQL.format(where='', n=50)}) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank) = 1",
    "first_source_rank": f"WITH t AS ({TOP_SQL.format(where='', n=50)}) SELECT min(rank) AS source_rank FROM t WHERE lower(source) IN ('src3', 'src7')",
    "context_section": f"WITH t AS ({TOP_SQL.format(where='', n=10)}) SELECT rank, format('[{{}}] score={{:.4f}} file={{}} source={{}} path={{}} > {{}}', rank, score, t.source, t.lang, t.lang, t.source) || chr(10) || d.text AS section FROM t JOIN documents d ON d.doc_id = t.vec_id",
    "citations": f"WITH t AS ({TOP_SQL.format(where='', n=10)}) SELECT rank, source AS file_name, lang AS refs, lang || ' > ' || source AS path, score FROM t",
}
QUERIES = {f.__name__: f for f in (
    vector_topk_cosine, vector_topk_filtered, vector_topk_per_label, knn_label_vote, vector_norm_preview, lexical_match_all_terms, lexical_single_term_tf, lexical_cover_density,
    lexical_index_match, lexical_index_phrases, lexical_index_top, vector_index_topk, hybrid_index_rerank, phrase_overlap_score, hybrid_merge_rerank, hybrid_vector_only_fallback, unique_document_sources, first_source_rank, context_section, citations,
)}
