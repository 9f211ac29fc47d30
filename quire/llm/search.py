"""Exact top-k inner products by aggregation without random access.

Each dimension is two lists of the candidates sorted by component, one rising, one
falling. A query reads the lists where its own component is not zero, in step, from
the end where the contribution to its score is largest. What it has read of a
candidate is the candidate's partial sum; for each list where the candidate has not
come up, the list's frontier (the last contribution read) bounds what it can still
add from above, the list's last contribution from below. A candidate whose upper
bound is under the k-th best score or lower bound so far cannot qualify. Reading
stops when only a few times k candidates qualify, and these are resolved; lists that
are read to the end have resolved themselves.

All queries of a cell read the same lists, so what is read to some depth is held once
for all: a matrix of lists and candidates that has a candidate's component where the
list has come to it, and the list's frontier elsewhere. Its product with the queries,
their negative components against the rising lists and their positive ones against
the falling, is all their upper bounds. A query first looks at its bounds a step before
the depth where it stopped in the block of candidates before.

Candidates and queries are dealt out in cells, one block of either in each: the
rows of a cell fit a task, and no vectors pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, staged

#: Bytes of candidates' and of queries' components in a cell.
CANDIDATE_BYTES, QUERY_BYTES = 32 << 20, 16 << 20
#: Candidates whose lists are sorted at once, first and later: early blocks give later ones a bound. At most 2**15.
FIRST, BLOCK = 512, 4096
#: Entries of each list that are read between two looks at the bounds, as a share of the list.
STEPS = 8
#: Candidates of a block that may be left to resolve for a query, in k.
RESOLVE = 4
#: Queries whose bounds are held at once, and pairs that are resolved at once.
TILE, PAIRS = 256, 1 << 14
NONE = -(1 << 62)
LAST = np.iinfo(np.int64).max
#: Scores must stay below this, so that sums of floats are exact.
EXACT = 1 << 53


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the array of floor(scale * x); rows with a null or non-finite component, or none at all, go."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(sound, F.lit(False)))
    return usable.select("vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))


def matrix(column: pa.ListArray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors by their number of components: that number, the rows' places, and a matrix."""
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    sizes = np.diff(offsets)
    found = []
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        found.append((int(dim), at, values[offsets[:-1][at][:, None] + np.arange(dim)]))
    return found


def firsts(rows: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (score, vec_id) of each row: row after row, the best first."""
    order = np.lexsort((vec, -score, rows))
    of = rows[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < k]


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE, np.int64)
        self.vec = np.full((n, k), LAST, np.int64)

    def add(self, rows: np.ndarray, vec: np.ndarray, score: np.ndarray, copies: np.ndarray) -> None:
        """rows: the query of each of these candidates."""
        if copies.max(initial=1) > 1:
            top = firsts(rows, vec, score, self.k)
            rows, vec, score = (np.repeat(a[top], np.minimum(copies[top], self.k)) for a in (rows, vec, score))
        some = np.unique(rows)
        v, s = np.concatenate([self.vec[some].ravel(), vec]), np.concatenate([self.score[some].ravel(), score])
        top = firsts(np.concatenate([np.repeat(some, self.k), rows]), v, s, self.k)
        self.vec[some], self.score[some] = v[top].reshape(-1, self.k), s[top].reshape(-1, self.k)


@dataclass
class Lists:
    """A block of candidates as sorted lists: for each dimension one that rises, then for each one that falls."""

    vec: np.ndarray
    copies: np.ndarray
    x: np.ndarray  # candidates x dimensions, of a kind of floats whose sums are exact
    both: np.ndarray = field(init=False)  # lists x candidates: the components
    rank: np.ndarray = field(init=False)  # lists x candidates: when each one comes
    values: np.ndarray = field(init=False)  # lists x entries: the components in the order of reading
    by_vec: np.ndarray = field(init=False)  # candidates by vec_id

    def __post_init__(self):
        n, d = self.x.shape
        small = np.abs(self.x).max(initial=0) < 1 << 15
        rising = np.argsort((self.x.astype(np.int16) if small else self.x).T, axis=1, kind="stable")
        self.both = np.concatenate([self.x.T, self.x.T])
        self.rank = np.empty((2 * d, n), np.int16)
        np.put_along_axis(self.rank[:d], rising, np.arange(n, dtype=np.int16)[None, :], axis=1)
        self.rank[d:] = n - 1 - self.rank[:d]
        values = np.take_along_axis(self.both[:d], rising, axis=1)
        self.values = np.concatenate([values, values[:, ::-1]])
        self.by_vec = np.argsort(self.vec, kind="stable")

    def depths(self) -> list[int]:
        """Entries of each list that are read at each look."""
        n = len(self.vec)
        step = max(1, -(-n // STEPS))
        return [*range(step, n, step), n]

    def read(self, depth: int, rest: int) -> np.ndarray:
        """Lists x candidates: the components down to `depth`; beyond it, the list's value at place `rest`."""
        return np.where(self.rank < depth, self.both, self.values[:, rest, None])

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the candidates are that have one of `ids`: its place, the candidate's."""
        vec = self.vec[self.by_vec]
        low = np.searchsorted(vec, ids)
        count = np.searchsorted(vec, ids, side="right") - low
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(np.arange(len(ids)), count), self.by_vec[np.repeat(low, count) + nth]


@dataclass
class Work:
    """What a search has done: entries read from lists, of how many, and candidates resolved afterwards."""

    read: int = 0
    entries: int = 0
    resolved: int = 0


def resolve(x: np.ndarray, q: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The scores of candidates `at` for the queries `of`."""
    score = np.empty(len(at), np.int64)
    for i in range(0, len(at), PAIRS):
        score[i : i + PAIRS] = np.einsum("ij,ij->i", x[at[i : i + PAIRS]], q[of[i : i + PAIRS]])
    return score


def read_lists(lists: Lists, ids: np.ndarray, q: np.ndarray, first: np.ndarray, best: Best, work: Work) -> None:
    """Add to `best` what qualifies in a block of candidates.

    `first` is the look, from 0, with which each query begins; it is set anew for
    the next block. A query's own vec_id is none of its candidates.
    """
    n, k = len(lists.vec), best.k
    depths = lists.depths()
    used = np.count_nonzero(q, axis=1)
    work.entries += n * int(used.sum())
    np.minimum(first, len(depths) - 1, out=first)
    reads = np.ones(len(ids), bool)  # who still reads
    for look, depth in enumerate(depths):
        asks = np.flatnonzero(reads & (first <= look))
        if not len(asks):
            continue
        frontier, least = lists.read(depth, depth - 1), None
        for i in range(0, len(asks), TILE):
            some = asks[i : i + TILE]
            signed = np.concatenate([np.minimum(q[some], 0), np.maximum(q[some], 0)], axis=1)
            above = signed @ frontier
            above[lists.own(ids[some])] = -np.inf
            floor = best.score[some, -1].astype(q.dtype)
            new = np.flatnonzero(best.score[some, -1] == NONE)
            if len(new) and n >= k:
                least = lists.read(depth, n - 1) if least is None else least
                below = signed[new] @ least
                below[lists.own(ids[some[new]])] = -np.inf
                floor[new] = np.maximum(floor[new], np.partition(below, n - k, axis=1)[:, n - k])
            keeps = above >= floor[:, None]
            left = np.count_nonzero(keeps, axis=1)
            ends = np.flatnonzero((left <= RESOLVE * k) | (depth == n))
            if not len(ends):
                continue
            done = some[ends]
            reads[done] = False
            work.read += depth * int(used[done].sum())
            first[done] = max(0, look - 1)
            of, at = np.divmod(np.flatnonzero(keeps[ends]), n)
            if depth < n:
                work.resolved += len(at)
                score = resolve(lists.x, q, at, done[of])
            else:
                score = above[ends[of], at].astype(np.int64)
            of = done[of]
            good = (score > best.score[of, -1]) | ((score == best.score[of, -1]) & (lists.vec[at] < best.vec[of, -1]))
            of, at, score = of[good], at[good], score[good]
            if len(at):
                best.add(of, lists.vec[at], score, lists.copies[at])


def blocks(n: int) -> Iterator[slice]:
    """Slices of n candidates, from FIRST on doubling up to BLOCK."""
    at, size = 0, FIRST
    while at < n:
        yield slice(at, min(n, at + size))
        at, size = at + size, min(2 * size, BLOCK)


def search(ids: np.ndarray, q: np.ndarray, vec: np.ndarray, copies: np.ndarray, x: np.ndarray, k: int, work: Work | None = None) -> Best:
    """The k best candidates of each query; a candidate counts as often as it has copies."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most >= EXACT:
        raise OverflowError(f"inner products of these vectors can reach 2**53 (dimension {q.shape[1]}): scale them down")
    kind = np.float32 if most < 1 << 24 else np.float64
    q, x = q.astype(kind), x.astype(kind)
    best, work = Best(len(ids), k), work or Work()
    first = np.zeros(len(ids), np.int64)
    for part in blocks(len(vec)):
        read_lists(Lists(vec[part], copies[part], x[part]), ids, q, first, best, work)
    return best


def cells(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (cb, qb, candidate, copies, vec_id, v): each cell (cb, qb) has one block of queries and one of candidates.

    A repeated row is one row with its copies. Blocks are of bounded size; there
    are as many blocks of queries as keep all cores busy, or more if they are many.
    """
    spark = vectors.sparkSession
    candidates = staged(vectors.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")), "candidates")
    wanted = staged(queries.select("vec_id", "v").distinct(), "queries")
    n, dim = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    m = wanted.count()
    nc = max(1, -(-n * dim * 8 // CANDIDATE_BYTES))
    nq = max(1, -(-m * dim * 8 // QUERY_BYTES), min(-(-m // 64), -(-spark.sparkContext.defaultParallelism // nc)))
    own = F.xxhash64("vec_id", "v")
    left = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"), F.pmod(own, F.lit(nq)).cast("int").alias("qb"), F.lit(False).alias("candidate"), F.lit(1).cast("long").alias("copies"), "vec_id", "v")
    right = candidates.select(F.pmod(own, F.lit(nc)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.lit(True).alias("candidate"), "copies", "vec_id", "v")
    # By ranges, so that each task has one cell: hashes of a few cells would meet.
    return left.union(right).repartitionByRange(nc * nq, "cb", "qb").sortWithinPartitions("cb", "qb", "candidate", "vec_id")


def top_in_cells(dealt: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each cell for each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if held and (held[0].column(0)[0], held[0].column(1)[0]) != (part.column(0)[0], part.column(1)[0]):
                    yield from found(held)
                    held = []
                held.append(part)
        if held:
            yield from found(held)

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        candidate, copies, vec = rows.column(2).to_numpy(zero_copy_only=False), rows.column(3).to_numpy(), rows.column(4).to_numpy()
        for _, at, m in matrix(rows.column(5)):
            asks = ~candidate[at]
            if not asks.any() or asks.all():
                continue
            ids, of = vec[at[asks]], at[~asks]
            # In an order of chance, so that the first blocks bound the later ones.
            shuffled = np.argsort((vec[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), kind="stable")
            best = search(ids, m[asks], vec[of][shuffled], copies[of][shuffled], m[~asks][shuffled], k)
            a, b = np.nonzero(best.score > NONE)
            for i in range(0, len(a), 100_000):
                p, r = a[i : i + 100_000], b[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(best.vec[p, r]), pa.array(best.score[p, r])], ["query_id", "vec_id", "score"])

    return arrow_map(dealt, run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by inner product.

    `vectors` and `queries` have vec_id and v (integers); other columns are
    ignored, null or empty vectors must be gone (see `integer_vectors`). A query's own
    vec_id is no candidate; ties go to the smaller vec_id; vectors of another
    number of components are not compared; with fewer candidates than k all are
    given, and no candidates or no queries give no rows. Repeated rows of a
    vec_id count as candidates each; a repeated query is one query, and one whose
    rows differ has the k best over all its vectors. Scores are exact; vectors
    whose scores could reach 2**53 raise an error.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = top_in_cells(cells(vectors, queries), k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
