"""Language identification by nearest centroid.

A text's vector counts hashed n-grams (2 and 3 bytes of UTF-8) of its lower-cased
letters, weighted by TF-IDF and normalised. Each language has a few centroids,
clustered from labelled texts; the closest centroid by cosine names the
language. A text that is farther from its centroid than nearly all labelled ones
of about its length is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import arrow_map, below, byte_slices, fresh, staged

BUCKETS = 4096
#: Least bytes of letters of each length class; a shorter text is in the first one.
LENGTHS = tuple(8 << k for k in range(9))
#: ASCII letters to lower case, all other ASCII characters to spaces; bytes beyond ASCII stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def letters(text: str) -> bytes:
    """The text's lower-cased letters, words parted by single spaces."""
    lowered = text if text.isascii() else text.lower()
    return b" " + b" ".join(lowered.encode().translate(LETTERS).split()) + b" "


def counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the whole text."""
    return grams_of(letters(text))


def grams_of(data: bytes) -> np.ndarray:
    """Counts of hashed n-grams, in blocks that bound the memory."""
    total = np.zeros(BUCKETS, np.int64)
    block = 1 << 20
    for i in range(0, max(1, len(data) - 2), block):
        b = np.frombuffer(data[i : i + block + 2], np.uint8).astype(np.uint32)
        pairs = b[:-1] << np.uint32(8) | b[1:]
        if len(data) > i + block + 2:
            pairs = pairs[:-1]
        triples = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        for grams, salt in ((pairs, 0x9E3779B1), (triples, 0x85EBCA6B)):
            total += np.bincount((grams * np.uint32(salt)) >> np.uint32(20), minlength=BUCKETS)
    return total


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors with damped counts; a row of zeros stays."""
    x = np.sqrt(rows, dtype=np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def length_class(rows: np.ndarray) -> np.ndarray:
    """The length class of each row of counts: n bytes have n - 1 pairs and n - 2 triples."""
    return np.maximum(np.searchsorted(LENGTHS, (rows.sum(axis=1) + 3) // 2, side="right") - 1, 0)


def cluster(x: np.ndarray, k: int, rounds: int = 12, least: float = 0.02) -> np.ndarray:
    """Spherical k-means from equal parts along the main direction of spread; no chance in it.

    Clusters with less than a share `least` of the rows go: a few odd texts make no centroid.
    """
    centred = x - x.mean(axis=0)
    along = centred @ (centred.T @ (centred @ centred[int(np.argmax((centred**2).sum(axis=1)))]))
    own = np.argsort(np.argsort(along, kind="stable"), kind="stable") * min(k, len(x)) // len(x)
    for _ in range(rounds):
        used = [i for i in np.unique(own) if (own == i).sum() >= least * len(x)]
        c = np.array([x[own == i].mean(axis=0) for i in used])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
    return c


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    floors: np.ndarray  # the least cosine that each centroid accepts, by length class

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = np.array([counts(t) for t in texts]).reshape(-1, BUCKETS)
        x = weighted(rows, self.idf)
        cosines = x @ self.centroids.T
        best = np.argmax(cosines, axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best].astype(np.float64), 0.0, 1.0)
        lettered = np.array([has_letter(t) for t in texts], bool)
        found = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        return found, np.where(lettered, score, 0.0), ~lettered | (score < self.floors[best, length_class(rows)])


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` of the rows, twice as many at most, the same ones each time: those with the smallest hashes of `key`."""
    own = F.xxhash64(F.lit("sample"), key)
    return rows.filter(below(own, most / max(1, rows.count()))).orderBy(own, key).limit(2 * most)


def fit(documents: DataFrame, usable: Column, per_language: int = 300, clusters: int = 4, slack: float = 0.8, least: int = 20, most: int = 6000) -> Model:
    """Fit on the usable rows with text and lang, at most about `per_language` for each language and `most` in all.

    IDF, centroids and floors come from this bounded sample: the n-gram counts
    of its texts, not the texts, come to the driver. With so many lang values
    that `most` is reached, each has fewer texts, and a rare one may have none. Short texts lie far from
    every centroid, so each sampled text also gives a piece from its middle for
    each length class it reaches: a class's floor is `slack` times the cosine
    that one in a hundred of the language's pieces stays below. A class with
    fewer than `least` pieces takes the floor of the one before it, the first
    none (0).
    """
    rows = documents.filter(usable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    # One row for each doc_id and text: rows that repeat do not make the sample grow.
    key = F.xxhash64(F.lit("sample"), "doc_id", "text")
    # Written: a small table, as it is but for dirty tables, is broadcast by its size; else a language with very many texts is split.
    sizes = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    own_most = min(per_language, most / max(1, sizes.count()))
    # The whole hash counts: of a language with very many rows no more are taken.
    share = F.lit(float(own_most)) / F.col("n")
    chosen = (share >= 1) | (F.col("key").cast("double") + F.lit(2.0**63) < share * F.lit(2.0**64))
    sample = rows.withColumn("key", key).join(sizes, "lang").filter(chosen).dropDuplicates(["lang", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            rows = []
            for lang, t in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), texts, strict=True):
                if has_letter(t):
                    data = letters(t)
                    middles = [(len(data) - n) // 2 for n in LENGTHS if n <= len(data)]
                    parts = [data, *[data[a : a + n] for a, n in zip(middles, LENGTHS, strict=False)]]
                    rows += [(lang, k - 1, zlib.compress(grams_of(d).astype("<u4").tobytes(), 1)) for k, d in enumerate(parts)]
            for i in range(0, len(rows), 2000):
                columns = zip(zip(*rows[i : i + 2000], strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["lang", "class", "counts"])

    taken = arrow_map(sample.select("lang", "text"), run, "lang string, class int, counts binary").orderBy("lang", "class", F.xxhash64("counts")).toArrow()
    classes = taken.column("class").to_numpy()
    pieces, got = taken.filter(pa.array(classes >= 0)), taken.filter(pa.array(classes < 0))
    if not got.num_rows:
        return Model(np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), [], np.zeros((0, len(LENGTHS))))
    langs = np.array(got.column("lang").to_pylist())
    raw = unpacked(got)
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = weighted(raw, idf)
    centroids, names = [], []
    for lang in sorted(set(langs)):
        found = cluster(x[langs == lang], clusters)
        centroids.append(found)
        names += [str(lang)] * len(found)
    piece_langs, piece_classes = np.array(pieces.column("lang").to_pylist()), pieces.column("class").to_numpy()
    floors = []
    for lang, own in zip(sorted(set(langs)), centroids, strict=True):
        floor = [0.0]
        for k in range(len(LENGTHS)):
            of = pieces.filter(pa.array((piece_langs == lang) & (piece_classes == k)))
            enough = of.num_rows >= least
            floor.append(slack * float(np.quantile((weighted(unpacked(of), idf) @ own.T).max(axis=1), 0.01)) if enough else floor[-1])
        floors += [floor[1:]] * len(own)
    return Model(idf, np.concatenate(centroids), names, np.array(floors))


def unpacked(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(zlib.decompress(c) for c in table.column("counts").to_pylist()), "<u4").reshape(-1, BUCKETS)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with lang_pred, score and rejected.

    A null text or one without letters is `und`, scores 0 and is rejected. Ties
    go to the language first by name. Repeated rows stay; a very long text counts
    whole. Other columns pass; columns of these three names, in whatever case, are
    replaced. With no labelled rows at all, every row is `und`; an empty table
    gives an empty one.
    """
    kept = [c for c in documents.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    source = documents.select(*kept)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            lang, score, rejected = model.predict(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return arrow_map(source, run, T.StructType([*source.schema.fields, *added]))


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, with their own columns, whatever their names."""
    gone = fresh("rejected", documents.columns)
    schema = T.StructType([*documents.schema.fields, T.StructField(gone, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.predict(texts)[2])], [*batch.schema.names, gone])

    return arrow_map(documents, run, schema).filter(~F.col(gone)).drop(gone)
