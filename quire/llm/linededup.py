"""Line deduplication by winnowing over line hashes.

Only lines with words count; a line is compared by its words. A gram is a run of
lines from one line on until it has `noise` words. A window is a run of lines
from one line on until it has `guarantee` words; of the grams wholly in a window,
the one with the smallest hash (the last of equal ones) is a fingerprint of the
document. So a run of `guarantee` words or more that two documents share, or that
one repeats, has a fingerprint in both places.

Each fingerprint is joined with its first position (by document and line), and
the match is extended line by line both ways, up to a window's words each way.
A later run's lines go.

A fingerprint's first position may stand among other lines than a later pair of
positions shares. So each window, from its first line on and up to its last line,
is a key of its own as well, unless a fingerprint has just its lines, and goes
wherever it has an earlier position: the windows within a repeated run of
`guarantee` words or more cover all its lines.

Keys have 128 bits, 64 from either half of the lines' hashes of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, byte_slices, fresh, staged


def line_hashes(text: str) -> tuple[list[bytes], list[int]]:
    """A hash of 16 bytes and the number of words of each line that has words."""
    from xxhash import xxh3_128_digest

    words = [w for w in map(str.split, text.split("\n")) if w]
    return [xxh3_128_digest(" ".join(w)) for w in words], [len(w) for w in words]


class Runs:
    """The lines of several documents, one after the other, and runs of them that stay within a document."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.n = len(counts)
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])  # words before each line
        ends = np.cumsum(sizes)
        self.first, self.last = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)  # a line's document's first line, and the line after it

    def ends(self, least: int) -> np.ndarray:
        """For each line, the line after the shortest run from it with `least` words, or -1."""
        found = np.searchsorted(self.before, self.before[:-1] + least)
        return np.where(found <= self.last, found, -1)

    def starts(self, least: int) -> np.ndarray:
        """For each line, the first line of the shortest run up to it with `least` words, or -1."""
        found = np.searchsorted(self.before, self.before[1:] - least, side="right") - 1
        return np.where((found >= self.first) & (self.before[1:] >= least), found, -1)

    def on(self, lines: np.ndarray, least: int) -> np.ndarray:
        """The line after the shortest run from each of `lines` on with `least` words, or after the document's last one (lines: ends of runs)."""
        return np.minimum(np.searchsorted(self.before, self.before[lines] + least), self.last[lines - 1])

    def back(self, lines: np.ndarray, least: int) -> np.ndarray:
        """The first line of the shortest run up to before each of `lines` with `least` words, or the document's first one."""
        return np.maximum(np.searchsorted(self.before, self.before[lines] - least, side="right") - 1, self.first[lines])


def winnow(runs: Runs, keys: np.ndarray, grams: np.ndarray, guarantee: int) -> np.ndarray:
    """The first lines of the selected grams, given each line's gram's hash and the line after that gram."""
    windows = runs.ends(guarantee)
    at = np.flatnonzero(windows >= 0)
    best = at.copy()
    for step in range(1, guarantee):  # a window has `guarantee` lines at most
        other = np.minimum(at + step, runs.n - 1)
        inside = (at + step < windows[at]) & (grams[other] >= 0) & (grams[other] <= windows[at])
        if not inside.any():
            break
        best = np.where(inside & (keys[other] <= keys[best]), other, best)
    return np.unique(best)


#: Odd bases of the runs' two polynomial hashes, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def span_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
    """A hash of the line hashes of each span, from prefix sums: a span's cost does not grow with its length."""
    powers, inverses = (np.cumprod(np.full(len(hashes) + 1, b, np.uint64), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
    return (((sums[high] - sums[low]) * inverses[low]) ^ (high - low).astype(np.uint64)).view(np.int64)


def lists_of(values: np.ndarray, low: np.ndarray, high: np.ndarray, reverse: bool = False) -> pa.ListArray:
    """The values of each span, from its end backwards if `reverse`."""
    sizes = high - low
    ends = np.cumsum(sizes)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    at = np.repeat(high - 1, sizes) - within if reverse else np.repeat(low, sizes) + within
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values[at].view(np.int64)))


def positions(documents: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """A row for each fingerprint: gram and check (its 128 bits), doc_id, the text's hash, the lines from `line` to before `high`, and the line hashes before and after.

    And one for each window, without line hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            found = [line_hashes(t) for t in texts]
            digests, sizes = b"".join([d for f in found for d in f[0]]), np.array([len(f[1]) for f in found])
            if not digests:
                continue
            own, other = (np.ascontiguousarray(h) for h in np.frombuffer(digests, "<u8").reshape(-1, 2).T)
            runs = Runs(np.array([n for f in found for n in f[1]], np.int64), sizes)
            of = np.repeat(np.arange(len(texts)), sizes)
            grams = runs.ends(noise)
            lines = np.arange(runs.n)
            keys = span_hashes(own, lines, np.where(grams >= 0, grams, lines), BASES[0])
            chosen = winnow(runs, keys, grams, guarantee)
            fingerprints = np.stack([chosen, grams[chosen]])
            ahead, behind = runs.ends(guarantee), runs.starts(guarantee)
            windows = np.concatenate([np.stack([lines, ahead])[:, ahead >= 0], np.stack([behind, lines + 1])[:, behind >= 0]], axis=1)
            taken = fingerprints[0] * (runs.n + 1) + fingerprints[1]
            spans = np.setdiff1d(windows[0] * (runs.n + 1) + windows[1], taken)
            yield from rows(batch, of, runs, own, other, *fingerprints, guarantee)
            yield from rows(batch, of, runs, own, other, *np.divmod(spans, runs.n + 1), None)

    def rows(batch: pa.RecordBatch, of: np.ndarray, runs: Runs, own: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int | None) -> Iterator[pa.RecordBatch]:
        gram, check = (span_hashes(h, low, high, base) for h, base in zip((own, other), BASES, strict=True))
        for i in range(0, len(low), 20_000):
            part = slice(i, i + 20_000)
            a, b = low[part], high[part]
            ids = [batch.column(c).take(pa.array(of[a])) for c in (0, 1)]
            if reach is None:
                around = [pa.nulls(len(a), pa.list_(pa.int64()))] * 2
            else:
                around = [lists_of(own, runs.back(a, reach), a, reverse=True), lists_of(own, b, runs.on(b, reach))]
            start = runs.first[a]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[part]), pa.array(check[part]), *ids, pa.array((a - start).astype(np.int32)), pa.array((b - start).astype(np.int32)), *around], ["gram", "check", "doc_id", "text_hash", "line", "high", "before", "after"]
            )

    schema = "gram long, check long, doc_id long, text_hash long, line int, high int, before array<long>, after array<long>"
    return arrow_map(documents.select("doc_id", F.xxhash64("text"), "text"), run, schema)


def repeated_runs(found: DataFrame) -> DataFrame:
    """Runs to delete: doc_id, text_hash, and the lines from `low` to before `high`."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_hash", "line")
    with_place = found.filter("before IS NOT NULL").withColumn("place", place)
    # Written, so that the join below has a plain shuffle on either side, whose hot keys adaptive execution can split.
    firsts = with_place.groupBy("gram", "check").agg(F.min(F.struct("place", "before", "after")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = staged(firsts.drop("n"), "firsts")
    later = with_place.join(first, ["gram", "check"]).filter("place > first.place")

    def shared(side: str):
        """The first index at which both arrays differ, or the shorter one's length."""
        both = F.least(F.size(side), F.size(f"first.{side}"))
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(both, F.lit(1))),
            F.lit(0),
            lambda n, i: F.when((n == i - 1) & (i <= both) & (F.try_element_at(F.col(side), i) == F.try_element_at(F.col(f"first.{side}"), i)), i).otherwise(n),
        )

    extended = later.select("doc_id", "text_hash", (F.col("line") - shared("before")).alias("low"), (F.col("high") + shared("after")).alias("high"))
    windows = found.filter("before IS NULL").select("gram", "check", place.alias("place"), "high")
    earliest = windows.groupBy("gram", "check").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = windows.join(staged(earliest.drop("n"), "first_windows"), ["gram", "check"]).filter("place > first")
    return extended.union(again.select(F.col("place.id"), "place.text_hash", F.col("place.line"), "high"))


def drop_repeated_lines(documents: DataFrame, noise: int = 5, guarantee: int = 8) -> DataFrame:
    """The documents without the lines of later repeated runs; all rows and columns stay.

    Every run of `guarantee` words or more goes wherever it occurs again, in
    another document or the same: with the defaults every repeated line of 8 words
    or more, and shorter ones that follow each other. One of fewer than `noise`
    words never goes; one in between does where it is a fingerprint. The first
    occurrence, by doc_id (null last), text and line, stays.

    Lines are parted by newlines and compared by their words; lines without words
    are not compared, and go where the lines on either side go. A null text stays
    null; a text may become empty; a text without repeats stays as it is, however
    long. Rows of equal doc_id and text are one place: they are not repeats of each
    other. Other columns pass, whatever their names. An empty table gives an empty one.
    """
    if not 0 < noise <= guarantee:
        raise ValueError("noise must be positive and not over guarantee")
    runs = staged(repeated_runs(staged(positions(documents, noise, guarantee), "positions")), "runs")
    spans = runs.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    taken = documents.columns
    own, key, spans_name = fresh("text_hash", taken), fresh("key", taken), fresh("spans", taken)
    other = fresh("other_hash", taken)
    keyed = spans.select(F.col("doc_id").alias(key), F.col("spans").alias(spans_name), F.col("text_hash").alias(other))
    # By text too: a doc_id, or null, that many different texts share is no hot key.
    tagged = documents.withColumn(own, F.xxhash64("text"))
    joined = tagged.join(keyed, tagged["doc_id"].eqNullSafe(keyed[key]) & (tagged[own] == keyed[other]), "left").drop(key, own, other)
    schema = documents.schema
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, found in enumerate(batch.column(len(schema)).to_pylist()):
                if found and texts[k] is not None:
                    texts[k] = without(texts[k], [(r["low"], r["high"]) for r in found])
            columns = list(batch.columns[: len(schema)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[: len(schema)])

    return arrow_map(joined, run, schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the lines of the spans, which count lines with words, and the lines without words within them."""
    lines = text.split("\n")
    with_words = [k for k, line in enumerate(lines) if line.split()]
    gone: set[int] = set()
    reached = 0
    for low, high in sorted(spans):
        if high > reached:
            gone.update(range(with_words[max(low, reached)], with_words[high - 1] + 1))
            if low < reached:  # the lines without words between the two spans
                gone.update(range(with_words[reached - 1], with_words[reached]))
            reached = high
    return "\n".join(line for k, line in enumerate(lines) if k not in gone)
