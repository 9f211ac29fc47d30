"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints of 64 bits that differ in at most `distance` bits agree up to
t_i bits in some part i of m, for any thresholds t_i >= -1 (-1: the part is not
probed) with a sum of distance - m + 1. Correlated bits share a part, so that
the parts are as independent as they can be; the number of parts and the thresholds are
those with the least estimated work. Each distinct fingerprint probes, in each
part, the buckets within the part's threshold. Within a bucket all candidates
are verified and a spanning forest of the links, nearest first, goes on: no
bucket emits all its pairs. Where a similarity of shingle sets is asked for, the
links of the forests are candidates beside those of an exact join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import arrow_map, below, byte_slices, fresh, staged
from quire.llm.components import roots
from quire.llm.jaccard import similar_classes

BITS = 64
#: Numbers of parts to choose from.
PARTS = (5, 4, 3, 2)


def shingle_hashes(data: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of each run of `words` words of lower-cased UTF-8 text, joined by single spaces."""
    from xxhash import xxh64_intdigest

    split = data.split()  # at 0x20 and 0x09-0x0D
    if not split:
        return []
    if len(split) <= words:
        return [xxh64_intdigest(b" ".join(split), 42)]
    joined = b" ".join(split)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces[: len(split) - words] + 1).tolist()]
    ends = [*spaces[words - 1 :].tolist(), len(joined)]
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)]


def fingerprint(text: str, words: int = 4, repeats: bool = True) -> int:
    """A bit is 1 if set in over half the shingle hashes (each once without `repeats`); 0 for a text without words."""
    hashes = shingle_hashes(text.encode().lower(), words)
    if not repeats:
        hashes = list(set(hashes))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[i : i + (1 << 16)], dtype=">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (64 bits as a signed long); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            found = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(found)], ["doc_id", "fp"])

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, fp long")


def correlated_parts(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m parts of about equal width; each takes the bits that correlate most with those it has."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    centred = bits.astype(np.float64) - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    related = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-9)
    free, parts = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        part = [max(free, key=lambda b: (related[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            best = max(free, key=lambda b: (related[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def masks(width: int, most: int) -> list[int]:
    """All values of `width` bits with at most `most` of them set."""
    return [sum(1 << b for b in c) for t in range(most + 1) for c in combinations(range(width), t)]


#: What a probe's row (dealt out, sorted, read) costs, in comparisons of two fingerprints.
PROBE = 500.0


def thresholds(sample: np.ndarray, parts: list[list[int]], distance: int, rows: int, bound: float = math.inf) -> tuple[float, list[int]]:
    """Estimated work and thresholds for the parts, by dynamic programming over the work.

    A part's work at threshold t: candidates within t bits in it, estimated from
    the sample's pairs for `rows` fingerprints, and `PROBE` times its probes.
    Infinite, without thresholds, if none comes below `bound`.
    """
    total = distance - len(parts) + 1
    pairs = max(1, len(sample) * (len(sample) - 1))
    work: list[dict[int, float]] = []
    for part in parts:
        values = sum(((sample >> np.uint64(b)) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(part)).astype(np.int64)
        known, counts = np.unique(values, return_counts=True)
        costs, found, tried = {-1: 0.0}, 0, 0
        for t in range(min(distance, 3) + 1):
            if PROBE * max(rows, 1) * (tried + math.comb(len(part), t)) >= bound:
                break
            for c in combinations(range(len(part)), t):
                other = known ^ sum(1 << b for b in c)
                at = np.minimum(np.searchsorted(known, other), len(known) - 1)
                found += int((counts * np.where(known[at] == other, counts[at], 0)).sum()) if len(known) else 0
                tried += 1
            by_chance = tried / 2.0 ** len(part)
            share = max((found - len(sample)) / pairs, by_chance)
            costs[t] = share * rows * rows + PROBE * max(rows, 1) * tried
        work.append(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in work:
        following: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, c in costs.items():
                if done + t not in following or cost + c < following[done + t][0]:
                    following[done + t] = (cost + c, [*chosen, t])
        best = following
    return best.get(total, (math.inf, []))


def partition(sample: np.ndarray, distance: int, rows: int, ms: tuple[int, ...]) -> tuple[list[list[int]], list[int]]:
    """The parts and thresholds with the least estimated work, of those with a number of parts in `ms`.

    Many fingerprints crowd narrow parts, so wider ones with more probes win as
    `rows` grows; every choice finds all links.
    """
    least, chosen = math.inf, None
    for m in ms:
        parts = correlated_parts(sample, m)
        work, limits = thresholds(sample, parts, distance, rows, least)
        if work < least:
            least, chosen = work, (parts, limits)
    if chosen is None:
        raise ValueError(f"no thresholds in {ms} parts reach a distance of {distance}")
    return chosen


def part_value(part: list[int]) -> Column:
    """The part's bits of column fp, as one number."""
    bits = [F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), k) for k, b in enumerate(part)]
    value = bits[0]
    for bit in bits[1:]:
        value = value.bitwiseOR(bit)
    return value


def probes(nodes: DataFrame, parts: list[list[int]], limits: list[int]) -> DataFrame:
    """Rows (bucket, probe, fp): each fingerprint in its own bucket of each part, and as a probe in those near it."""
    probed = [(k, part, limit) for k, (part, limit) in enumerate(zip(parts, limits, strict=True)) if limit >= 0]
    own = nodes.select("fp", *[F.shiftleft(F.lit(k).cast("long"), 40).bitwiseOR(part_value(part)).alias(f"own{k}") for k, part, _ in probed])

    def near(k: int, flips: list[int]) -> Column:
        return F.transform(F.lit(flips).cast("array<long>"), lambda x: F.struct(F.col(f"own{k}").bitwiseXOR(x).alias("bucket"), (x != 0).alias("probe")))

    rows = F.concat(*[near(k, masks(len(part), limit)) for k, part, limit in probed])
    return own.select("fp", F.explode(rows).alias("r")).select("r.bucket", "r.probe", "fp")


def cells(rows: DataFrame, largest: int) -> DataFrame:
    """Rows (cell, probe, fp): buckets of up to `largest` rows are one cell; a larger one has a cell for each pair of its blocks."""
    heavy = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest)
    blocks = heavy.select("bucket", F.ceil(F.col("n") / largest).cast("int").alias("blocks"))
    known = rows.join(blocks, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    spread = known.withColumn("other", other)
    cell = F.when(F.col("blocks").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    return spread.select(cell.alias("cell"), "probe", "fp")


def forest(pairs: Iterator[tuple[int, int]], parent: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Those of the pairs that join two trees."""

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def spread_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values, of the nearest ones that span it."""
    left, n, links = values.copy(), len(values), []
    while n > 1:
        n -= 1
        at = left[n]
        near, by = np.bitwise_count(left[:n] ^ at), np.full(n, at)
        while n and near[i := int(np.argmin(near[:n]))] <= distance:
            at = left[i]
            links.append((int(by[i]), int(at)))
            n -= 1
            for column in (left, near, by):  # the last one takes its place
                column[i] = column[n]
            now = np.bitwise_count(left[:n] ^ at)
            closer = np.flatnonzero(now < near[:n])
            near[closer], by[closer] = now[closer], at
    return links


#: Runs up to this length are compared by shifting the whole column against itself.
SMALL = 48
#: Near pairs of a larger run that are sorted; where there are more, the nearest are found one by one.
DENSE = 100_000


def large_run(own: np.ndarray, probing: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that a bucket's own values have, with each other and with those that probe it."""
    own = np.unique(own)
    every = np.unique(np.concatenate([own, probing]))
    touched, pairs, total = np.zeros(len(every), bool), [], 0
    rows = max(1, (1 << 20) // len(every))
    for i in range(0, len(own), rows):
        part = own[i : i + rows]
        away = np.bitwise_count(part[:, None] ^ every)
        a, b = np.nonzero(away <= distance)
        other = part[a] != every[b]
        a, b = a[other], b[other]
        touched[b] = True
        touched[np.searchsorted(every, part[a])] = True
        total += len(a)
        if total <= DENSE:
            pairs.append((away[a, b], part[a], every[b]))
    if total > DENSE:
        return spread_links(every[touched], distance)
    if not total:
        return []
    away, a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(away, kind="stable")
    return list(forest(zip(a[order].tolist(), b[order].tolist(), strict=True), {}))


def linked(cell: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within each run of equal cells, nearest first."""
    cuts = np.flatnonzero(np.diff(cell)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.append(starts, len(cell)))
    out: list[tuple[int, int]] = []
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        out += large_run(fp[s : s + n][~probe[s : s + n]], fp[s : s + n][probe[s : s + n]], distance)
    keep = np.repeat((sizes <= SMALL) & (sizes > 1), sizes)
    cell, probe, fp = cell[keep], probe[keep], fp[keep]
    found = []
    for shift in range(1, SMALL):
        same = cell[shift:] == cell[:-shift] if len(cell) > shift else np.zeros(0, bool)
        if not same.any():
            break
        a, b = np.flatnonzero(same), np.flatnonzero(same) + shift
        some = ~(probe[a] & probe[b])
        a, b = a[some], b[some]
        away = np.bitwise_count(fp[a] ^ fp[b])
        found.append([x[away <= distance] for x in (away, a, b)])
    if found:
        away, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(away, kind="stable")
        a, b = a[order], b[order]
        pairs = zip(zip(cell[a].tolist(), fp[a].tolist(), strict=True), zip(cell[b].tolist(), fp[b].tolist(), strict=True), strict=True)
        out += [(x[1], y[1]) for x, y in forest(pairs, {})]
    return out


def links(nodes: DataFrame, distance: int = 4, ms: tuple[int, ...] = PARTS, sample_rows: int = 8_000, largest: int = 8192) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) that span every component of those within `distance` bits.

    About `sample_rows` fingerprints, twice as many at most, come to the driver, for the parts
    and thresholds alone; these change the work, never the links.
    """
    count = nodes.count()
    own = F.xxhash64("fp")
    picked = nodes.filter(below(own, sample_rows / max(1, count))).orderBy(own).limit(2 * sample_rows).select("fp").toArrow()
    sample = np.sort(picked.column("fp").to_numpy().view(np.uint64)) if len(picked) else np.zeros(1, np.uint64)
    parts, limits = partition(sample, distance, count, ms)
    rows = cells(probes(nodes, parts, limits), largest)
    dealt = rows.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64))
            if not len(now[0]):
                continue
            kept = now if kept is None else tuple(np.concatenate(x) for x in zip(kept, now, strict=True))
            end = int(np.searchsorted(kept[0], kept[0][-1]))
            if end >= 1 << 16:
                yield found(tuple(x[:end] for x in kept))
                kept = tuple(x[end:] for x in kept)
        if kept is not None:
            yield found(kept)

    def found(columns: tuple) -> pa.RecordBatch:
        pairs = np.array(linked(*columns, distance), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return arrow_map(dealt, run, "u long, v long")


def near_duplicates(documents: DataFrame, words: int = 4, distance: int = 4, ms: tuple[int, ...] = PARTS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable by links of fingerprints. A
    null text counts as empty; texts without words share fingerprint 0 and are
    linked like others; repeated rows stay. A component without any doc_id has a
    null component_id. Other columns are ignored; an empty table gives an empty one.
    """
    rows = staged(fingerprints(documents, words), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    # Written tables on either side of each join: a large component's root and a common
    # fingerprint are hot keys, which adaptive execution splits there.
    found = staged(roots(links(nodes.select("fp"), distance, ms)), "roots")
    named = staged(found.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first_doc").alias("component_id")), "named")
    members = found.join(named, "root").select("node", "component_id")
    labels = staged(nodes.join(members, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id")), "labels")
    return rows.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def jaccard(a: np.ndarray, b: np.ndarray, sketch: int) -> float:
    """The similarity of two sets from the distinct smallest hashes of each; two empty sets are equal."""
    union, times = np.unique(np.concatenate([a, b]), return_counts=True)
    times = times[:sketch]
    return float((times == 2).mean()) if len(times) else 1.0


def proposed(rows: DataFrame, nodes: DataFrame, distance: int, ms: tuple[int, ...]) -> DataFrame:
    """Pairs (u, v) of doc_ids that connect what has one fingerprint or links of fingerprints, from (doc_id, fp) and one doc_id (first_doc) of each fp."""
    same = rows.join(nodes, "fp").filter("doc_id <> first_doc").select(F.col("doc_id").alias("u"), F.col("first_doc").alias("v"))
    first = links(nodes.select("fp"), distance, ms).distinct().join(nodes, F.col("u") == F.col("fp")).select(F.col("first_doc").alias("u"), "v")
    return same.union(first.join(nodes, F.col("v") == F.col("fp")).select("u", F.col("first_doc").alias("v")))


def one_of_each(documents: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 4, ms: tuple[int, ...] = PARTS) -> DataFrame:
    """The documents without near-duplicates: of each group, one row with the smallest doc_id (null ids last).

    Two texts are linked if their sets of `words`-word shingles (A-Z as a-z) have a similarity
    of `similarity` or more, a whole number of hundredths; groups are what links connect. Fingerprints of
    these sets within `distance` bits propose pairs; as no number of bits has all that are
    similar, the signature trees of `jaccard` propose the rest, and all are held
    against the sets. Texts without words are one group. A null text counts as empty.

    All columns stay as they are, whatever their names. The rows are written once with their
    fingerprints and a number each, so that equal rows are told apart. An empty
    table gives an empty one.
    """
    percent = round(100 * similarity)
    if abs(100 * similarity - percent) > 1e-9 or not 0 < percent <= 100:
        raise ValueError("similarity must be a whole number of hundredths, above 0 and at most 1")
    fp, row = fresh("fp", documents.columns), fresh("row", documents.columns)
    schema = T.StructType([*documents.schema.fields, T.StructField(fp, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            found = np.array([fingerprint(t, words, repeats=False) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, fp])

    tagged = staged(arrow_map(documents, run, schema).withColumn(row, F.monotonically_increasing_id()), "tagged")
    rows = tagged.select(F.col(row).alias("doc_id"), F.col(fp).alias("fp"))
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    classes = similar_classes(tagged.select(F.col(row).alias("doc_id"), "text"), words, percent, also=staged(proposed(rows, nodes, distance, ms), "proposed"))
    group = classes.select(F.col("doc_id").alias("of"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(-1).alias("group"))
    known = tagged.select(F.col(row).alias("at"), "doc_id").join(group, F.col("at") == F.col("of"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("at").alias("row"))).alias("first")
    winners = staged(known.groupBy("group").agg(first).select(F.col("first.row").alias(row)), "winners")
    return tagged.join(winners, row, "left_semi").select(*documents.columns)
