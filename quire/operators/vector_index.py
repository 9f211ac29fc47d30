"""A stored vector index with exact answers: vectors in cells around centres, skipped by the triangle inequality.

Vectors count as directions. Each commit's vectors are written by the cell of their
nearest centre, and the log has each cell's radius and count. If the query is
at a distance d from a centre and all of a cell's vectors are within r of it, none is nearer to the query
than d - r: so a search reads the most promising cells, takes the n-th best
similarity there, and then the other cells that can still reach it. Centres only
change how much is read, never what is found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.arrow import arrow_map
from quire.log import Change, Snapshot
from quire.operators.retrieval import cosine, filtered
from quire.store import Store

#: Centres at most, vectors that they are fitted on at most, and rounds of fitting.
CENTRES, SAMPLE, ROUNDS = 64, 4096, 8
#: The cell of vectors without a direction.
NOWHERE = -1
#: Distances are exact to less than this.
SLACK = 1e-6


@dataclass(frozen=True)
class Nearest:
    """Rows with vector_score; the cells that there are, and those read."""

    rows: DataFrame
    cells: int
    read: int


def directions(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without a direction are zero."""
    vectors = np.nan_to_num(np.asarray(vectors, np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def fitted_centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Means of the nearest directions, from far apart ones on; always the same for the same sample."""
    sample = np.unique(directions(sample), axis=0)
    chosen = [0]
    away = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(most, max(1, len(sample) // 8)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    centres = sample[chosen]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        centres = np.stack([sample[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
    return centres


class VectorIndex:
    """Table `vector_cells` of a store: id, owner, file_name, file_type and embedding, by cell."""

    def __init__(self, store: Store, centres: int = CENTRES):
        self.store, self.most = store, centres
        self.known: dict[str, np.ndarray] = {}
        store.compactors["vector_cells"] = self.compact

    def centres(self, path: str) -> np.ndarray:
        if path not in self.known:
            rows = self.store.spark.read.parquet(path).orderBy("cell").collect()  # `most` rows at most
            self.known[path] = np.array([r["centre"] for r in rows], np.float64)
        return self.known[path]

    # writing

    def put(self, change: Change, vectors: DataFrame, replace: bool = True) -> None:
        """Add to a change: vectors (id, owner, file_name, file_type, embedding) in place of those of the same ids; `replace` drops all others of these owners."""
        saved = self.store.saved
        if replace:
            change.drop("vector_cells", "owner", saved("vector_cells", vectors.select("owner").distinct(), "drop"))
        change.drop("vector_cells", "id", saved("vector_cells", vectors.select("id").distinct(), "drop"))
        parts = self._parts(self.store.state())
        path = parts[-1]["centres"] if parts else self._fit(vectors)
        if path is not None:
            at, cells = self._save(vectors, path, "rows")
            change.rows("vector_cells", at, centres=path, cells=cells)

    def remove(self, change: Change, owners: DataFrame) -> None:
        """Add to a change: no vectors of these owners (a column `owner`) any longer."""
        change.drop("vector_cells", "owner", self.store.saved("vector_cells", owners.select("owner").distinct(), "drop"))

    def _fit(self, vectors: DataFrame) -> str | None:
        """Centres of a bounded sample, in a file; none without vectors."""
        known = vectors.filter("embedding is not null and size(embedding) > 0")
        sample = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
        if not sample:
            return None
        size = max(len(r[0]) for r in sample)
        centres = fitted_centres(np.array([[x or 0.0 for x in r[0]] for r in sample if len(r[0]) == size]), self.most)
        path = f"{self.store.root}/vector_cells/centres-{uuid.uuid4().hex}"
        self.store.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(path)
        return path

    def _save(self, vectors: DataFrame, path: str, kind: str) -> tuple[str, list]:
        """Write vectors by cell; the folder, and each cell's number, count and radius."""
        centres, spark = self.centres(path), self.store.spark
        rows = vectors.select("id", "owner", "file_name", "file_type", "embedding")
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(4).to_pylist()
                fits = np.array([v is not None and len(v) == centres.shape[1] and None not in v and bool(np.isfinite(v).all()) and any(v) for v in own], bool)
                cell, away = np.full(len(own), NOWHERE, np.int32), np.zeros(len(own))
                if fits.any():
                    unit = directions(np.array([v for v, f in zip(own, fits, strict=True) if f]))
                    nearest = (unit @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
                    cell[fits], away[fits] = nearest, np.linalg.norm(unit - centres[nearest], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

        at = f"{self.store.root}/vector_cells/{kind}-{uuid.uuid4().hex}"
        # A cell may hold very many vectors: they are dealt out by cell and id, so that each task writes a few cells.
        arrow_map(rows, assign, schema).repartitionByRange("cell", "id").write.partitionBy("cell").parquet(at)
        radii = spark.read.parquet(at).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
        return at, sorted([r["cell"], r["n"], r["radius"]] for r in radii)

    def compact(self) -> None:
        """Put all vectors, as of one version, into one folder around centres fitted anew."""
        state = self.store.state()
        parts = self._parts(state)
        change = Change()
        if parts:
            rows = self._alive(state, [(e, c[0]) for e in parts for c in e["cells"]])
            path = self._fit(rows) or parts[-1]["centres"]
            at, cells = self._save(rows, path, "base")
            change.base("vector_cells", at, state.version, centres=path, cells=cells)
            self.store.log.commit(change)

    # reading

    def _parts(self, state: Snapshot) -> list[dict]:
        return [e for e in state.actions("vector_cells") if e["kind"] in ("rows", "base") and e["path"]]

    def _alive(self, state: Snapshot, chosen: list[tuple[dict, int]]) -> DataFrame:
        """The vectors of these cells of commits, without those that a later commit dropped."""
        schema = self.store.schema("vector_cells")
        if not chosen:
            return self.store.spark.createDataFrame([], schema)
        rows = self.store.versioned(schema, self._parts(state), [f"{e['path']}/cell={c}" for e, c in chosen])
        return self.store.alive(rows, "vector_cells", state.actions("vector_cells")).select(*schema.names)

    def search(self, vector: Sequence[float], n: int, filters: dict[str, str] | None = None) -> Nearest:
        """At least the n vectors most similar to a query's, and all that equal the last of them, with vector_score (null without a direction).

        `filters` are those of `filtered`; where fewer than n vectors pass them, all cells are read.
        """
        state, query = self.store.state(), directions(np.array([vector]))[0]
        prospects = []
        for e in self._parts(state):
            away = np.linalg.norm(self.centres(e["centres"]) - query, axis=1)
            for cell, count, radius in e["cells"]:
                best = -2.0 if cell == NOWHERE else 1 - max(0.0, away[cell] - radius - SLACK) ** 2 / 2
                prospects.append((best, e, cell, count))
        prospects.sort(key=lambda p: -p[0])

        def rows(chosen: list[tuple]) -> DataFrame:
            return self._scored(state, [p[1:3] for p in chosen], vector, filters)

        first, held = 0, 0
        while first < len(prospects) and held < 2 * n:
            held += prospects[first][3]
            first += 1
        chosen = prospects
        if first < len(prospects):
            best = rows(prospects[:first]).select("vector_score").filter("vector_score is not null").orderBy(F.desc("vector_score")).limit(n).collect()
            if len(best) == n:
                chosen = [*prospects[:first], *(p for p in prospects[first:] if p[0] >= best[-1][0] - SLACK)]
        return Nearest(rows(chosen), len(prospects), len(chosen))

    def _scored(self, state: Snapshot, chosen: list[tuple[dict, int]], vector: Sequence[float], filters: dict[str, str] | None) -> DataFrame:
        rows = self._alive(state, chosen).withColumn("document_id", F.col("owner"))
        return filtered(rows, filters or {}).drop("document_id").withColumn("vector_score", cosine(F.col("embedding"), vector))

    def scores(self, vector: Sequence[float], wanted: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
        """The wanted rows (with a column id) that have vectors which pass the filters, with vector_score, which is worked out for these alone."""
        state = self.store.state()
        rows = self._alive(state, [(e, c[0]) for e in self._parts(state) for c in e["cells"]]).withColumn("document_id", F.col("owner"))
        kept = filtered(rows, filters or {}).select("id", "embedding")
        return kept.join(wanted, "id").withColumn("vector_score", cosine(F.col("embedding"), vector)).drop("embedding")
