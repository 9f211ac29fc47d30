"""Documents whose sets of word shingles are similar, by signature trees.

Two sets of a Jaccard similarity of 0.8 share a token within the first fifth of
each, in any common order of tokens. So each token's bucket is a tree of the sets that
have it there: their bitmaps show twice this prefix, and what the traversal cannot rule
out connects sets to clusters. No link between two clusters is possible; within one,
a second tree over whole sets leaves out what it can, and the rest is held against
the sets themselves. Tokens that many sets have come last in the order, so that
a passage which stands in many documents makes no large bucket. Buckets and clusters
give spanning links, never all their pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest, xxh3_128_digest

from quire.llm.common import arrow_map, byte_slices, staged
from quire.llm.components import roots
from quire.llm.signature_tree import LEAF, Sets, SignatureTree, bitmap, folded, possible

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Buckets beyond this many sets are pushed to the end of the order, as far as the list of their tokens is bounded.
MOST = 128
LISTED = 1 << 18
#: Sets of a bucket that a tree takes; a larger one, of sets made of frequent tokens alone, is one cluster without a look.
TREE = 8192
#: Sets and tokens of a block of a cluster, and the blocks that a smaller cluster is spread over.
BLOCK_SETS, BLOCK_TOKENS, SPREAD_SETS, SPREAD = 4096, 4_000_000, 256, 16
#: Prefixes that a bitmap shows, and rows of a chunk of buckets.
SHOWN, ROWS = 2, 100_000
#: Bytes of a text whose words are split at once.
SEGMENT = 4 << 20
WHOLE = np.uint64(2**64 - 1)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Shingles:
    """Sets of hashed shingles; `seed` chooses the hash."""

    def __init__(self, words: int, seed: int = 0):
        self.words, self.seed = words, seed

    def of_words(self, words: list[bytes]) -> bytes:
        return b"".join(map(xxh3_64_digest, words) if not self.seed else [xxh3_64_digest(w, self.seed) for w in words])

    def set_of(self, text: str) -> np.ndarray:
        """The sorted distinct hashes of a text's shingles of `words` words; with fewer words, of all in one; none without words."""
        data, parts, at = text.encode().lower(), [], 0  # bytes: A-Z alone, and white space 0x20, 0x09-0x0D
        while at < len(data):
            end = re.compile(rb"[\x09-\x0d ]").search(data, at + SEGMENT)
            end = end.start() if end else len(data)
            parts.append(self.of_words(data[at:end].split()))
            at = end
        hashes = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
        k = min(self.words, len(hashes))
        if not k:
            return hashes
        rows = len(hashes) - k + 1
        value = np.full(rows, k, np.uint64)
        for j in range(k):
            value = (value ^ hashes[j : j + rows]) * MIX[0]
            value = (value ^ (value >> np.uint64(29))) * MIX[1]
            value ^= value >> np.uint64(32)
        return distinct(value)


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of n in which it shares one with any set of a similarity of `percent`, whatever the order."""
    return n - (percent * n + 99) // 100 + 1


def is_in(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def prefix(tokens: np.ndarray, size: int, frequent: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A set's first tokens, in the order of hashes with frequent ones last, and the place of the last of them in that order."""
    late = is_in(tokens, frequent)
    first = tokens[~late][:size]
    if len(first) == min(size, len(tokens)):
        return first, first[-1] >> np.uint64(1)
    first = np.concatenate([first, tokens[late][: size - len(first)]])
    return first, (first[-1] >> np.uint64(1)) | np.uint64(1 << 63)


def column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def frequent_tokens(documents: DataFrame, shingles: Callable[[], Shingles], percent: int, known: np.ndarray, most: int) -> np.ndarray:
    """Tokens that stand in more than `most` prefixes, at most LISTED, the most frequent ones; those of `known` among them.

    With tokens known, only what they bring into prefixes is counted. The list
    changes the work, never the links, and has 2 MB at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingles()
        for _, texts in byte_slices(batches, "text"):
            found = []
            for tokens in map(own.set_of, texts):
                if len(tokens):
                    first = tokens[: prefix_size(len(tokens), percent)]
                    if len(known):
                        now = prefix(tokens, len(first), known)[0] if is_in(first, known).any() else first[:0]
                        first = now[(now > first[-1]) & ~is_in(now, known)]
                    found.append(first)
            values, times = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([column(values), pa.array(times)], ["token", "n"])

    counts = arrow_map(documents.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    listed = counts.filter(F.col("n") > most).orderBy(F.desc("n"), "token").limit(LISTED).select("token").toArrow()
    return np.unique(np.concatenate([known, listed.column("token").to_numpy().view(np.uint64)]))[:LISTED]


def sets_of(documents: DataFrame, shingles: Callable[[], Shingles], percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, and for texts with words: id (64 bits of the set's digest), digest, prefix, bits (the bitmap of SHOWN prefixes) and last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingles()
        for batch, texts in byte_slices(batches, "text"):
            rows = []
            for tokens in map(own.set_of, texts):
                if len(tokens):
                    size = prefix_size(len(tokens), percent)
                    shown, last = prefix(tokens, SHOWN * size, frequent)
                    digest = xxh3_128_digest(tokens.tobytes())
                    rows.append((len(tokens), int.from_bytes(digest[:8], "big", signed=True), digest, shown[:size].tobytes(), bitmap(shown).tobytes(), int(last.view(np.int64))))
                else:
                    rows.append((0, *[None] * 5))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *columns], ["doc_id", "n", "id", "digest", "prefix", "bits", "last"])

    return arrow_map(documents.select("doc_id", "text"), run, "doc_id long, n long, id long, digest binary, prefix binary, bits binary, last long")


def whole_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Sorted (token, id) without repeats, some whole runs of a token at a time, about `rows` rows; a run of more than TREE comes apart, as large."""
    tokens, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large = None
    for batch in batches:
        tokens, ids = np.concatenate([tokens, batch.column(0).to_numpy()]), np.concatenate([ids, batch.column(1).to_numpy()])
        while len(tokens):
            if large is not None:
                end = int(np.searchsorted(tokens, large, side="right"))
                if end:
                    yield tokens[:end], ids[:end], True
                tokens, ids = tokens[end:], ids[end:]
                large = large if not len(tokens) else None
                continue
            start = int(np.searchsorted(tokens, tokens[-1]))
            if len(tokens) - start > 2 * TREE:
                if start:
                    yield tokens[:start], ids[:start], False
                large, tokens, ids = tokens[-1], tokens[start:], ids[start:]
                continue
            if start >= rows:
                yield tokens[:start], ids[:start], False
                tokens, ids = tokens[start:], ids[start:]
            break
    if len(tokens):
        yield tokens, ids, False


def shared_tokens(found: DataFrame) -> DataFrame:
    """(chunk, id, tokens): the tokens of a set's prefix that stand in another's too; a chunk has all that share its tokens. Chunk -1 has tokens of very many sets, one by one."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, firsts = np.unique(batch.column(0).to_numpy(), return_index=True)
            own = [np.frombuffer(batch.column(1)[int(k)].as_py(), np.uint64) for k in firsts]
            yield pa.RecordBatch.from_arrays([column(np.concatenate([*own, np.zeros(0, np.uint64)])), pa.array(np.repeat(ids, [len(x) for x in own]))], ["token", "id"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        kept_tokens, kept_ids, size = [], [], 0
        for tokens, ids, large in whole_runs(batches, ROWS):
            new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])])
            tokens, ids = tokens[new], ids[new]
            if large:
                yield chunk(np.full(len(ids), -1), ids, tokens, np.arange(len(ids)))
                continue
            same = tokens[1:] == tokens[:-1]
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            kept_tokens.append(tokens[shared])
            kept_ids.append(ids[shared])
            size += int(shared.sum())
            if size >= ROWS:
                yield grouped(part, kept_tokens, kept_ids)
                kept_tokens, kept_ids, size, part = [], [], 0, part + 1
        if size:
            yield grouped(part, kept_tokens, kept_ids)

    def grouped(part: int, tokens: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        tokens, ids = np.concatenate(tokens), np.concatenate(ids)
        order = np.argsort(ids, kind="stable")
        tokens, ids = tokens[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        return chunk(np.full(len(starts), part), ids[starts], tokens, starts)

    def chunk(number: np.ndarray, ids: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        offsets = 8 * np.append(starts, len(tokens)).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(tokens.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(ids), packed], ["chunk", "id", "tokens"])

    rows = arrow_map(found.filter("id is not null").select("id", "prefix"), spread, "token long, id long")
    return arrow_map(rows.repartition("token").sortWithinPartitions("token", "id"), runs, "chunk long, id long, tokens binary")


def small_runs(token: np.ndarray, at: np.ndarray, sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that may be similar, by their places, among rows (token, place) whose runs of equal tokens are one leaf each; sorted by token and size."""
    words = np.array([len(b) for b in sets.bits], np.int64)
    views: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def view(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each set among those with bitmaps of this width or twice it, these as a matrix, and their slack."""
        if width not in views:
            rows = np.flatnonzero((words == width) | (words == 2 * width))
            matrix = np.vstack([folded(sets.bits[k][None, :], width) for k in rows])
            place = np.full(len(words), -1, np.int64)
            place[rows] = np.arange(len(rows))
            views[width] = place, matrix, sets.n[rows] - np.bitwise_count(matrix).sum(axis=1, dtype=np.int64)
        return views[width]

    found: list[np.ndarray] = []
    n, last = sets.n, sets.last
    for shift in range(1, LEAF):
        a = np.flatnonzero(token[shift:] == token[:-shift]) if len(token) > shift else np.zeros(0, np.int64)
        if not len(a):
            break
        a, b = at[a], at[a + shift]
        near = possible(percent, n[a], n[b], n[a])
        pairs = np.unique(np.stack([a[near], b[near]], axis=1), axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
        narrow, wide = np.minimum(words[a], words[b]), np.maximum(words[a], words[b])
        far = wide > 2 * narrow  # sets of nearly one size differ by one doubling; others are not ruled out here
        found.append(pairs[far])
        for width in np.unique(narrow[~far]):
            here = np.flatnonzero((narrow == width) & ~far)
            place, matrix, slack = view(int(width))
            for k in range(0, len(here), 1 << 16):
                i, j = a[here[k : k + (1 << 16)]], b[here[k : k + (1 << 16)]]
                both = np.bitwise_count(matrix[place[i]] & matrix[place[j]]).sum(axis=1, dtype=np.int64)
                good = possible(percent, n[i], n[j], both + np.where(last[i] <= last[j], slack[place[i]], slack[place[j]]))
                found.append(np.stack([i[good], j[good]], axis=1))
    pairs = np.concatenate([*found, np.zeros((0, 2), np.int64)])
    return pairs[:, 0], pairs[:, 1]


def stars(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each member of a class that the pairs make, but the smallest, (member, smallest): few and short paths, so that classes of many tasks meet in few rounds."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in pairs:
        i, j = top(x), top(y)
        if i != j:
            parent[max(i, j)] = min(i, j)
    return [(x, t) for x in parent if (t := top(x)) != x]


def bucket_links(token: np.ndarray, at: np.ndarray, sets: Sets, percent: int) -> list[tuple[int, int]]:
    """Links, between places of sets, that connect what may be similar in each bucket: rows (token, place of a set)."""
    order = np.lexsort((sets.n[at], token))
    token, at = token[order], at[order]
    cuts = np.flatnonzero(np.diff(token)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(token)]])
    out, small = [], np.ones(len(token), bool)
    for s, e in zip(starts[ends - starts > LEAF].tolist(), ends[ends - starts > LEAF].tolist(), strict=True):
        small[s:e] = False
        own = at[s:e]
        out += [(int(own[x]), int(own[y])) for x, y in SignatureTree(sets.take(own)).links(percent, lambda x, y: True)]
    a, b = small_runs(token[small], at[small], sets, percent)
    return out + list(zip(a.tolist(), b.tolist(), strict=True))


def link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def candidates(found: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between sets that connect, within clusters, all that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                if s < e:
                    if numbers[s] != chunk and held:
                        yield of_chunk(held)
                        held = []
                    chunk = numbers[s]
                    held.append(batch.slice(s, e - s))
        if held:
            yield of_chunk(held)

    def of_chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        ids, n, last = (whole.column(c).to_numpy() for c in ("id", "n", "last"))
        own = [np.frombuffer(x, np.int64) for x in whole.column("tokens").to_pylist()]
        sets = Sets(n, last.view(np.uint64), [np.frombuffer(x, np.uint64) for x in whole.column("bits").to_pylist()])
        links = bucket_links(np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own]), sets, percent)
        return link_batch(stars((int(ids[x]), int(ids[y])) for x, y in links))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours in size: sets made of tokens that very many have are one cluster without a look."""
        end = None
        for batch in batches:
            tokens, n, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if end is not None:
                tokens, n, ids = [end[0], *tokens], np.concatenate([[end[1]], n]), np.concatenate([[end[2]], ids])
            if len(tokens):
                end = tokens[-1], n[-1], ids[-1]
                same = np.array([x == y for x, y in zip(tokens[1:], tokens[:-1], strict=True)], bool)
                near = same & possible(percent, n[:-1], n[1:], n[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1][near]), pa.array(ids[1:][near])], ["u", "v"])

    shared = staged(shared_tokens(found), "shared")
    entries = shared.join(nodes.select("id", "n", "last", "bits"), "id")
    near = entries.filter("chunk >= 0").select("chunk", "id", "n", "last", "bits", "tokens").repartition("chunk").sortWithinPartitions("chunk")
    large = entries.filter("chunk < 0").select("tokens", "n", "id").repartition("tokens").sortWithinPartitions("tokens", "n", "id")
    return arrow_map(near, run, "u long, v long").union(arrow_map(large, chain, "u long, v long")).distinct()


def filter_words(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of two bits for each id, `bits` long: what it lets through besides is dropped by a join."""
    places = F.explode(F.array(F.col("id").bitwiseAND(bits - 1), F.shiftrightunsigned("id", 32).bitwiseAND(bits - 1))).alias("at")
    mask = F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))")
    found = ids.select(places).groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(mask.alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return words


def may_have(words: np.ndarray, number: int) -> bool:
    bits = 64 * len(words)
    return all(int(words[p >> 6]) >> (p & 63) & 1 for p in (number & (bits - 1), (number & (2**64 - 1)) >> 32 & (bits - 1)))


def clustered_sets(documents: DataFrame, shingles: Callable[[], Shingles], clusters: DataFrame) -> DataFrame:
    """root, id, n and the whole set of each set in a cluster. The texts are read again; a filter of 16 MB at most keeps other sets from the shuffle."""
    count = clusters.count()
    words = filter_words(clusters.select(F.col("node").alias("id")), 1 << min(27, max(10, (16 * count).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingles()
        for _, texts in byte_slices(batches, "text"):
            rows = {}
            for tokens in map(own.set_of, texts):
                if len(tokens):
                    number = int.from_bytes(xxh3_128_digest(tokens.tobytes())[:8], "big", signed=True)
                    if number not in rows and may_have(words, number):
                        rows[number] = tokens
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([len(x) for x in rows.values()], pa.int64()), pa.array([x.tobytes() for x in rows.values()], pa.binary())], ["id", "n", "tokens"])

    whole = arrow_map(documents.select("text"), run, "id long, n long, tokens binary").dropDuplicates(["id"])
    return clusters.withColumnRenamed("node", "id").join(whole, "id")


def cells(sets: DataFrame) -> DataFrame:
    """(cell, side, id, n, tokens): a small cluster is a cell; a larger one has one for each block and each pair of blocks, whose sides are told apart."""
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens_in"))
    wide = F.least(F.lit(SPREAD), F.ceil(F.col("sets") / SPREAD_SETS))
    blocks = F.greatest(wide, F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("tokens_in") / BLOCK_TOKENS)).cast("int")
    many = sizes.select(F.col("root").alias("of"), blocks.alias("blocks")).filter("blocks > 1")
    known = sets.join(many, F.col("root") == F.col("of"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.struct("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    return dealt.select(cell.alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "tokens")


def cell_links(sides: np.ndarray, ids: list[int], sets: list[np.ndarray], percent: int, two: bool) -> list[tuple[int, int]]:
    """Links that connect what is similar among a cell's sets, which are sorted by size, each held against the sets."""
    n = np.array([len(x) for x in sets], np.int64)
    tree = SignatureTree(Sets(n, np.full(len(sets), WHOLE), [bitmap(x) for x in sets]))

    def check(x: int, y: int) -> bool:
        a, b = sets[x], sets[y]
        both = int(is_in(a, b).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    return [(ids[x], ids[y]) for x, y in tree.links(percent, check, sides if two else None)]


def verified(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) for each set and the smallest that links of a similarity of `percent` or more connect it with in its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides, ids, own = None, [], [], []
        for batch in batches:
            out = []
            for c, side, number, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                c = tuple(c.values())
                if c != cell:
                    if len(ids) > 1:
                        out += stars(iter(cell_links(np.array(sides), ids, own, percent, cell[1] != cell[2])))
                    cell, sides, ids, own = c, [], [], []
                sides.append(side)
                ids.append(number)
                own.append(np.frombuffer(tokens, np.uint64))
            yield link_batch(out)
        if len(ids) > 1:
            yield link_batch(stars(iter(cell_links(np.array(sides), ids, own, percent, cell[1] != cell[2]))))

    dealt = cells(sets).repartition("cell").sortWithinPartitions("cell", "n", "id").select("cell", "side", "id", "tokens")
    return arrow_map(dealt, run, "u long, v long")


def between_sets(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (u, v) of doc_ids as pairs of the sets that these have."""
    own = found.filter("id is not null").select("doc_id", "id")
    first = pairs.join(own, F.col("u") == F.col("doc_id")).select(F.col("id").alias("u"), "v")
    return first.join(own, F.col("v") == F.col("doc_id")).select("u", F.col("id").alias("v")).filter("u <> v").distinct()


def similar_classes(documents: DataFrame, words: int = 5, percent: int = 80, most: int = MOST, also: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set has its distinct shingles of `words` words; A-Z count as a-z,
    and a text with fewer words is one shingle. Documents are linked if their sets have
    a Jaccard similarity of `percent` or more; component_id is the smallest doc_id
    that links reach. A null text counts as empty; texts without words have no
    shingle and no link, and are components of their own. Repeated rows stay, equal sets are
    one node, a component without any doc_id has a null component_id. Other columns are ignored;
    an empty table gives an empty one. All is exact but for collisions of 64-bit
    hashes of shingles; if two different sets have one 64-bit id, another hash is taken.
    `also` has candidates (u, v) by doc_id from elsewhere, which are held against the sets like all others.
    """
    for seed in range(8):

        def shingles(seed: int = seed) -> Shingles:
            return Shingles(words, seed)

        frequent = np.zeros(0, np.uint64)
        for _ in range(2):
            frequent = frequent_tokens(documents, shingles, percent, frequent, most)
            if not len(frequent):
                break
        found = staged(sets_of(documents, shingles, percent, frequent), "sets")
        same = [F.first(c).alias(c) for c in ("n", "last", "bits")]
        nodes = staged(found.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.min("digest").alias("a"), F.max("digest").alias("b"), *same), "nodes")
        if nodes.filter("a <> b").isEmpty():
            break
    else:
        raise RuntimeError("different sets have equal ids whatever the hash")
    near = candidates(found, nodes, percent)
    clusters = roots(staged(near if also is None else near.union(between_sets(also, found)), "candidates"))
    sets = staged(clustered_sets(documents, shingles, staged(clusters, "clusters")), "whole")
    linked = staged(roots(staged(verified(sets, percent), "links")), "roots")
    first = nodes.select("id", "first_doc")
    named = staged(linked.join(first, F.col("node") == F.col("id")).groupBy("root").agg(F.min("first_doc").alias("component_id")), "named")
    labels = staged(first.join(linked.join(named, "root").select("node", "component_id"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component_id", "first_doc").alias("component_id")), "labels")
    with_words = found.filter("id is not null").select("doc_id", "n", "id").join(labels, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(found.filter("id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
