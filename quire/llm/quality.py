"""Quality classification by voting of the nearest labelled documents.

A text's vector counts its lower-cased words by a hash, the shapes of its words
(runs of upper-case, lower-case and digit characters and the signs around them),
pairs of neighbouring shapes, repeats of words and lines, by TF-IDF. A truncated SVD of labelled documents'
vectors gives the latent space. The labelled latent vectors, of bounded number,
go to every task; each document is compared with all of them in blocks, and the
nearest vote with their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import UnitCache, arrow_map, byte_slices, fresh
from quire.llm.language import bounded_sample

SHAPES, PAIRS, REPEATS, TERMS = 256, 512, 8, 1024
WIDTH = SHAPES + PAIRS + REPEATS + TERMS
#: What a term weighs beside a shape: most words are no mark of quality.
TERM_WEIGHT = 0.5
_RUNS = re.compile(r"(.)\1+")


#: A longer word counts as successive pieces of this many characters.
PIECE = 64


def shape(word: str) -> str:
    """Upper-case letters as A, lower-case as a, digits as 0, other characters as they are; runs of one are cut to it."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", kinds)


def pieces(text: str) -> list[str]:
    """The text's words, long ones in pieces: all of a text without spaces counts."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


@lru_cache(maxsize=1)
def word_codes() -> UnitCache:
    """A number for each word and its shape: the lower-cased word's hash above, the shape's bucket in the low 8 bits."""

    def codes(words: list[str]) -> list[int]:
        return [zlib.crc32(w.lower().encode()) << 8 | zlib.crc32(shape(w).encode()) % SHAPES for w in words]

    return UnitCache(codes)


def counts(codes: np.ndarray, lines: list[str]) -> np.ndarray:
    """The counts of one document from its words' codes."""
    out = np.zeros(WIDTH, np.float32)
    shapes = codes & 0xFF
    out[:SHAPES] = np.bincount(shapes, minlength=SHAPES)
    if len(codes) > 1:
        pairs = (shapes[:-1] * 31 + shapes[1:] * 17 + (shapes[:-1] ^ shapes[1:])) % PAIRS
        out[SHAPES : SHAPES + PAIRS] = np.bincount(pairs, minlength=PAIRS)
    at = SHAPES + PAIRS
    for back in (1, 2, 3):
        out[at + back] = (codes[back:] == codes[:-back]).sum() if len(codes) > back else 0
    out[at] = len(lines) - len(set(lines))
    out[at + 4] = sum(line == other for line, other in zip(lines, lines[1:], strict=False)) * 4
    out[at + REPEATS :] = np.bincount((codes >> 8) % TERMS, minlength=TERMS)
    return out


def vectors(texts: list[str]) -> np.ndarray:
    words = [pieces(t) for t in texts]
    codes: list[list[np.ndarray]] = [[] for _ in texts]
    for k, found in word_codes().runs(words):
        codes[k].append(np.array(found, dtype=np.int64))
    return np.array([counts(np.concatenate(c), t.split("\n")) for c, t in zip(codes, texts, strict=True)], dtype=np.float32).reshape(-1, WIDTH)


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors of shares of the document, damped; a row of zeros stays."""
    words = np.maximum(rows[:, :SHAPES].sum(axis=1, keepdims=True), 1.0)
    x = np.sqrt(rows / words) * idf
    x[:, SHAPES + PAIRS + REPEATS :] *= TERM_WEIGHT
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # WIDTH x rank
    known: np.ndarray  # labelled x rank, normalised
    labels: np.ndarray  # 0 or 1
    neighbours: int
    block: int = 512

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = weighted(rows, self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        """The share of label 1 in the votes of the nearest labelled documents; 0.5 without any."""
        if not len(self.known):
            return np.full(len(texts), 0.5)
        out = []
        for i in range(0, len(texts), self.block):
            z = self.latent(vectors(texts[i : i + self.block]))
            cosines = z @ self.known.T
            k = min(self.neighbours, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 0.0).astype(np.float64) ** 4 + 1e-9
            out.append((votes * self.labels[near]).sum(axis=1) / votes.sum(axis=1))
        return np.clip(np.concatenate(out), 0.0, 1.0) if out else np.zeros(0)


def fit(documents: DataFrame, labels: DataFrame, usable: Column, most: int = 4000, rank: int = 40, neighbours: int = 15) -> Model:
    """Fit on usable labelled rows, at most about `most` of them (a bounded sample by a hash of doc_id).

    IDF, latent axes and neighbours come from this sample; its vectors, not its
    texts, come to the driver. A doc_id whose labels differ has label 0; labels
    other than 0 and 1, null ones and those of a null doc_id are left out; of the
    rows that share a labelled doc_id one counts.
    """
    labelled = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(labelled.filter(usable), "doc_id", most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about `most` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            found = [zlib.compress(v.tobytes(), 1) for v in vectors(texts)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "quality")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["doc_id", "quality", "counts"])

    # One row for each doc_id: rows that repeat one do not make the sample grow.
    vectors_of = arrow_map(rows.select("doc_id", "quality", "text"), run, "doc_id long, quality int, counts binary")
    got = vectors_of.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("counts").alias("counts")).drop("doc_id").orderBy("quality", F.xxhash64("counts")).toArrow()
    if not got.num_rows:
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours)
    raw = np.frombuffer(b"".join(map(zlib.decompress, got.column("counts").to_pylist())), np.float32).reshape(-1, WIDTH)
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + np.float32(0.2)
    x = weighted(raw, idf)
    values, axes = np.linalg.eigh(x.T.astype(np.float64) @ x)
    axes = axes[:, np.argsort(-values)[:rank]].astype(np.float32)
    model = Model(idf, axes, np.zeros((0, 1), np.float32), np.array(got.column("quality").to_pylist(), np.float64), neighbours)
    model.known = model.latent(raw)
    return model


def predict(documents: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 if score >= `least`).

    A null text counts as empty and is scored like others; repeated rows stay; a
    very long text is scored whole. Of labelled texts at equal distance from the
    last place on, any may vote. Other columns pass; columns of these two names,
    in whatever case, are replaced. Without labelled rows all scores are 0.5; an
    empty table gives an empty one.
    """
    source = documents.select(*[c for c in documents.columns if c.lower() not in ("score", "predicted")])
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            score = model.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= least).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return arrow_map(source, run, T.StructType([*source.schema.fields, *added]))


def accepted(documents: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents that score at least `least`, with their own columns, whatever their names."""
    name = fresh("score", documents.columns)
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(texts))], [*batch.schema.names, name])

    return arrow_map(documents, run, schema).filter(F.col(name) >= least).drop(name)
