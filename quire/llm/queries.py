"""The corpus operators as queries on the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, conversation_trie, fim, jaccard, language, linededup, media, packing, quality, search, simhash, token_counts, token_files
from quire.llm.common import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout, _ = packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096)
    return layout.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_repeated_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; -1 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(-1))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = language.fit(documents, fold(3) != 1)
    found = language.predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(read_table(spark, sf_dir, "documents"), token_files.vocabulary("byte_bpe_50k"), end_id=2)
    return token_files.read_token_files(files)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = quality.fit(documents, read_table(spark, sf_dir, "labels"), ~fold(5).isin(0, -1))
    found = quality.predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, distance=4)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(read_table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.shared_prefix_trie(read_table(spark, sf_dir, "conversations"), every=5, most=8)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(read_table(spark, sf_dir, "documents"), words=5, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_media_columns": op3_media_columns,
    "op4_bpe_trie": op4_bpe_trie,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_token_files": op8_token_files,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_jaccard_join": op13_jaccard_join,
}

#: SQL for those that it can express: none hashes, encodes or clusters as these do but the top-k search.
ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_fill_in_middle": """
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
            FROM documents
        ), hashed AS (
            SELECT *, len(u)::BIGINT AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4
            FROM units
        ), cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM hashed
        ), parts AS (
            SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
    "op12_conversation_trie": """
        WITH own AS (
            SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t,
                   conv_id::VARCHAR AS name
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), hashed AS (  -- crc32 bit by bit: a byte, then eight shifts (-1)
            SELECT *, xor(list_reduce(flatten(list_transform(range(1, len(name) + 1), lambda i: [ascii(substr(name, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
            FROM own
        ), rebuilt AS (
            SELECT c.conv_id, CASE WHEN c.conv_id % 5 = 0 THEN c.t ELSE list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) END AS t
            FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
        ), members AS (
            SELECT conv_id, d AS depth, t[1:d] AS path, len(t) AS length FROM rebuilt, unnest(range(0, len(t) + 1)) AS r(d)
        ), nodes AS (
            SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(length) > depth AS inner_node,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256,
                   CASE WHEN depth > 0 THEN strlen(path[depth].text) ELSE 0 END AS bytes
            FROM members GROUP BY depth, path
        ), below AS (
            SELECT n.depth, n.path, count(*) FILTER (NOT u.inner_node) AS n_leaves, sum((u.n_convs - 1) * u.bytes)::BIGINT AS saved_tokens,
                   count(*) FILTER (u.depth = n.depth + 1) AS n_children
            FROM nodes n JOIN nodes u ON u.depth >= n.depth AND u.path[1:n.depth] = n.path GROUP BY n.depth, n.path
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
        FROM nodes n JOIN below b ON b.depth = n.depth AND b.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
    """,
    "op13_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words
        ), tokens AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
        ), links AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.v) AS component_id FROM sets s JOIN reached r ON r.u = s.doc_id GROUP BY s.doc_id, s.s
    """,
}
