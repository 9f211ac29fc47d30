"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

Classifiers are fitted on the documents and labels of sf_dir. A null text counts
as empty: the first stage rejects it, the others keep it if it comes to them.
Rows without a doc_id and repeated rows are documents of their own; other columns
pass unchanged but in the last stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language, linededup, packing, quality, simhash
from quire.llm.common import read_table
from quire.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; those that the classifier rejects go."""
    return language.accepted(docs, language.fit(read_table(spark, sf_dir, "documents"), F.lit(True)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the others go."""
    model = quality.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), F.lit(True))
    return quality.accepted(docs, model)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later repeated runs."""
    return linededup.drop_repeated_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 4096 tokens."""
    layout, _ = packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096)
    return layout


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("line dedup", unrepeated_lines),
    ("SimHash near-dedup", one_of_each),
    ("packing", packed),
]
