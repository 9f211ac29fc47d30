"""Hybrid top-k retrieval: vectors, full text and token overlap.

A query's vector and terms are literals of the plan, so both branches are one
scan each with the filters at the scan, a score, and Spark's top-k; only the few
hundred candidates meet in a join.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import STOP_WORDS, Retrieval, Weights, candidate_limit, query_text
from quire.functions.text import bound, fold_case, meaningful_words, singulars_of


def vector_literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return dot(vector, vector_literal(query)) / F.nullif(norm(vector) * F.lit(length), F.lit(0.0))


def filtered(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Equality on file_name, file_type and document_id; other keys and empty values do not count."""
    for key in ("file_name", "file_type", "document_id"):
        if filters.get(key):
            rows = rows.filter(F.col(key) == filters[key])
    return rows


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def words(text: Column) -> Column:
    return F.regexp_extract_all(fold_case(text), F.lit("([a-z0-9]+)"), 1)


def word_stem(word: Column) -> Column:
    """A light English stem: plural, -ing and -ed endings go. An approximation, as no stemmer is built in."""
    plural = F.when((F.length(word) > 3) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when((F.length(word) > 3) & word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.when((F.length(plural) > 5) & plural.endswith("ing"), F.regexp_replace(plural, "ing$", "")).when((F.length(plural) > 4) & plural.endswith("ed"), F.regexp_replace(plural, "ed$", "")).otherwise(plural)


def stem_of(word: str) -> str:
    """word_stem of one word of a query."""
    if len(word) > 3 and word.endswith("ies"):
        word = word[:-3] + "y"
    elif len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if len(word) > 5 and word.endswith("ing"):
        return word[:-3]
    return word[:-2] if len(word) > 4 and word.endswith("ed") else word


def stems(text: Column) -> Column:
    """A document's stems in order; stop words keep their places as empty strings."""
    return F.transform(words(text), lambda w: F.when(w.isin(*STOP_WORDS), F.lit("")).otherwise(word_stem(w)))


def query_groups(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of (wanted, words): quoted words are a phrase, - excludes, `or` parts alternatives, the rest must all occur."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query.lower()):
        if word == "or" and not minus:
            groups.append([])
            continue
        found = [w for w in re.findall("[a-z0-9]+", phrase or word) if w not in STOP_WORDS]
        if found:
            groups[-1].append((not minus, found))
    return [g for g in groups if any(wanted for wanted, _ in g)]


def words_of_stem(stem: str) -> list[str]:
    """The words whose light stem is `stem`, stop words left out."""
    singles = [stem, f"{stem}ing", f"{stem}ed"]
    tries = {w for p in singles for w in (p, f"{p}s", f"{p[:-1]}ies")}
    return sorted(w for w in tries if stem_of(w) == stem and w not in STOP_WORDS)


def text_matches(text: Column, query: str) -> Column:
    """Whether a text matches a whole query by itself: one search of its lower-cased text for each word or phrase."""
    folded = fold_case(text)

    def has(found: list[str]) -> Column:
        words = ["(?:" + "|".join(words_of_stem(stem_of(w)) or ["(?!)"]) + ")" for w in found]
        return folded.rlike("(?<![a-z0-9])" + "[^a-z0-9]+".join(words) + "(?![a-z0-9])")

    return any_of([all_of([has(found) if wanted else ~has(found) for wanted, found in g]) for g in query_groups(query)])


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def cover_density(text: Column, query: str, weight: float = 0.1) -> Column:
    """Cover-density rank: each shortest span with all the query's words counts weight / (1 + words between them).

    One word's rank is weight for each occurrence. Without all words it is 0. One
    pass over the words finds the query's, one fold over those the spans.
    """
    stems_asked = sorted({stem_of(w) for g in query_groups(query) for keep, found in g if keep for w in found})
    if not stems_asked:
        return F.lit(0.0)
    n = len(stems_asked)

    def term(word: Column) -> Column:
        number = F.lit(-1)
        for k, s in enumerate(stems_asked):
            number = F.when(word.isin(*words_of_stem(s)), F.lit(k)).otherwise(number)
        return number

    hits = F.filter(F.transform(words(text), lambda w, i: F.struct(i.alias("at"), term(w).alias("term"))), lambda h: h["term"] >= 0)
    return covers(hits, n, weight)


def covers(hits: Column, n: int, weight: float = 0.1) -> Column:
    """Cover density from the places of a query's n words: structs of `at` and `term` (0 to n - 1), by place."""
    if not n:
        return F.lit(0.0)
    # The last place of each term, where the span counted last begins, the sum so far.
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("sum"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda x, k: F.when(k == hit["term"], hit["at"]).otherwise(x))

        def counted(own: Column) -> Column:
            begin = own["begin"]
            new = (begin >= 0) & (begin != state["begin"])
            return F.struct(own["last"].alias("last"), begin.alias("begin"), F.when(new, state["sum"] + F.lit(weight) / (F.lit(1.0) + hit["at"] - begin - (n - 1))).otherwise(state["sum"]).alias("sum"))

        return bound(bound(last, lambda x: F.struct(x.alias("last"), F.array_min(x).alias("begin"))), counted)

    return F.aggregate(hits, start, step, lambda state: state["sum"])


def phrase_overlap(query: str, *texts: Column) -> Column:
    """The share of the query's meaningful tokens (repeats count) that occur in the texts."""
    asked = meaningful_words(query)
    if not asked:
        return F.lit(0.0)
    wanted = {t: singulars_of(t) for t in asked}
    every = "|".join(sorted({w for ws in wanted.values() for w in ws})) or "(?!)"
    # One search gives the few words that count, whatever the length of the texts.
    found = F.regexp_extract_all(fold_case(F.concat_ws(" ", *texts)), F.lit(f"(?<![a-z0-9])({every})(?![a-z0-9])"), 1)

    def share(known: Column) -> Column:
        total = F.lit(0)
        for t in asked:
            total = total + F.when(any_of([F.array_contains(known, w) for w in wanted[t]]), 1).otherwise(0)
        return total / F.lit(len(asked))

    return bound(F.array_distinct(found), share)


def hybrid_score(vector: Column, lexical: Column, phrase: Column, any_lexical: Column, weights: Weights) -> Column:
    v, x = F.coalesce(vector, F.lit(0.0)), F.coalesce(lexical, F.lit(0.0))
    mixed = F.lit(weights.vector) * v + F.lit(weights.lexical) * F.least(x * 8.0, F.lit(1.0)) + F.lit(weights.phrase) * phrase
    return F.when(any_lexical, F.least(F.round(mixed, 12), F.lit(1.0))).otherwise(v)


def ranked_list(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`, 1 for the first; for lists of bounded length."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def merge(vector_hits: DataFrame, lexical_hits: DataFrame, key: str) -> DataFrame:
    """Both lists in one by key: the larger scores, each list's rank where it has the row."""
    both = vector_hits.select(key, "vector_score", F.lit(0.0).alias("lexical_score"), "vector_rank", F.lit(None).cast("int").alias("lexical_rank")).union(
        lexical_hits.select(key, "vector_score", "lexical_score", F.lit(None).cast("int"), "lexical_rank")
    )
    return both.groupBy(key).agg(*[F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("vector_score", "lexical_score")], F.max("vector_rank").alias("vector_rank"), F.max("lexical_rank").alias("lexical_rank"))


def rerank(merged: DataFrame, key: str, phrase: Column, weights: Weights, top_k: int) -> DataFrame:
    """The best `top_k` merged rows with score and rank. One lexical hit anywhere switches the formula for all."""
    any_lexical = F.max(F.col("lexical_rank").isNotNull()).over(Window.partitionBy())
    scored = merged.withColumn("score", hybrid_score(F.col("vector_score"), F.col("lexical_score"), phrase, any_lexical, weights))
    order = [F.desc("score"), F.desc("vector_score"), F.coalesce("vector_rank", F.lit(201)), F.coalesce("lexical_rank", F.lit(201)), F.col(key)]
    best = scored.orderBy(*order).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def retrieve(chunks: DataFrame, query: str, vector: Sequence[float], options: Retrieval | None = None) -> DataFrame:
    """The best chunks for a query.

    `chunks`: child_id, document_id, file_name, file_type, child_text,
    parent_text, embedding. Adds vector_score, lexical_score, both ranks, score
    and rank. A score of 0 falls back to the vector score.
    """
    options = options or Retrieval()
    query = query_text(query)
    n = candidate_limit(options.top_k)
    rows = filtered(chunks, options.filters).withColumn("vector_score", cosine(F.col("embedding"), vector))
    searchable = F.concat_ws(" ", "child_text", "parent_text", "file_name")
    by_vector = [F.desc("vector_score"), F.col("child_id")]
    vector_hits = ranked_list(top(rows.select("child_id", "vector_score"), by_vector, n), by_vector, "vector_rank")
    matched = rows.filter(any_of([text_matches(F.col(c), query) for c in ("child_text", "parent_text", "file_name")]))
    by_text = [F.desc("lexical_score"), F.desc("vector_score"), F.col("child_id")]
    lexical_hits = ranked_list(top(matched.select("child_id", "vector_score", cover_density(searchable, query).alias("lexical_score")), by_text, n), by_text, "lexical_rank")
    merged = merge(vector_hits, lexical_hits, "child_id")
    # At most twice the candidate limit, 400 rows: their texts come by a broadcast of the candidates.
    return finished(chunks.drop("embedding").join(F.broadcast(merged), "child_id"), query, options)


def finished(candidates: DataFrame, query: str, options: Retrieval) -> DataFrame:
    """The best of merged candidates with their texts. A score of 0 falls back to the vector score."""
    searchable = F.concat_ws(" ", "child_text", "parent_text", "file_name")
    texts = candidates.withColumn("lexical_score", F.greatest("lexical_score", cover_density(searchable, query)))
    ranked = rerank(texts, "child_id", phrase_overlap(query, F.col("file_name"), F.col("child_text"), F.col("parent_text")), options.weights, options.top_k)
    return ranked.withColumn("score", F.coalesce(F.nullif("score", F.lit(0.0)), F.nullif("vector_score", F.lit(0.0)), F.lit(0.0)))


def unique_sources(hits: DataFrame, key: Column) -> DataFrame:
    """The best hit of each source."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).filter("_n = 1").drop("_n")


def first_source_rank(hits: DataFrame, expected: list[str]) -> DataFrame:
    """One row: the least rank of a hit in an expected file, by name in any case; null if none."""
    names = [e.lower() for e in expected]
    return hits.agg(F.min(F.when(F.lower("file_name").isin(*names) if names else F.lit(False), F.col("rank"))).alias("source_rank"))
