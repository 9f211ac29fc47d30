"""Prefix tries of conversations, by the ownership of each conversation's path.

A node is a distinct sequence of first turns, known by its depth and a rolling
hash of its turns. Its owner is its smallest member, so a conversation owns a
suffix of its path: from the first node that no smaller one has, on. With that
depth and the prefix sums of its texts, each conversation can tell at each of its nodes which bytes
below it does not own, which child and which leaf it does own: one group-by over
all paths sums these to what the whole subtrees have. No subtree is walked and no
sequence of turns collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, staged

#: A sequence's hash is a polynomial in BASE modulo a Mersenne prime: sequences can be joined without their turns.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation trie").digest()[:15], "big")
ROOT = bytes(16)


def packed(value: int) -> bytes:
    return value.to_bytes(16, "big")


def turn_hash(role: str, text: str) -> int:
    role_bytes = role.encode()
    return xxhash.xxh3_128_intdigest(len(role_bytes).to_bytes(4, "big") + role_bytes + text.encode()) % PRIME


PATHS = "conv_id long, depth long, key binary, above binary, size long, total long"


def local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PATHS of a partition's sorted turns, as if its first conversation began in it, with the partition's number."""
    part, conv, depth, key, total = TaskContext.get().partitionId(), None, 0, 0, 0
    for batch in batches:
        rows = []
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if c != conv:
                conv, depth, key, total = c, 0, 0, 0
            above, size = key, len(text.encode())
            key, depth, total = (key * BASE + turn_hash(role, text)) % PRIME, depth + 1, total + size
            rows.append((part, c, depth, packed(key), packed(above), size, total))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["part", "conv_id", "depth", "key", "above", "size", "total"])


def carried(ends: list) -> dict[int, tuple[int, int, int, int]]:
    """For each partition that goes on with a conversation: its id, and depth, hash and bytes before the partition.

    `ends` has part, first conversation and the last row (conv_id, depth, key, total) of each partition.
    """
    out, open_conv, depth, key, total = {}, None, 0, 0, 0
    for part, first, (last, d, k, t) in sorted(ends):
        if first == open_conv:
            out[part] = (first, depth, key, total)
        if last != open_conv or first != last:
            open_conv, depth, key, total = last, 0, 0, 0
        depth, key, total = depth + d, (key * pow(BASE, d, PRIME) + int.from_bytes(k, "big")) % PRIME, total + t
    return out


def paths(conversations: DataFrame) -> DataFrame:
    """PATHS: for each turn of each conversation its depth, the hash of the turns up to it and of those before it, its text's bytes and theirs up to it.

    Turns are sorted by turn (null first), role and text; null roles and texts are
    empty, rows without a conv_id take no part. All turns are sorted together, so that a very long
    conversation is spread over tasks; of each partition one row comes to the driver.
    """
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", "role", "text"]
    ordered = turns.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    local = staged(arrow_map(ordered.select("conv_id", "role", "text"), local_paths, f"part int, {PATHS}"), "turns")
    last = F.max(F.struct("conv_id", "depth", "key", "total")).alias("last")
    before = carried([(r.part, r.first, tuple(r.last)) for r in local.groupBy("part").agg(F.min("conv_id").alias("first"), last).collect()])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, c, depth, key, above, size, total in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                conv, d, k, t = before.get(part, (None, 0, 0, 0))
                if c == conv:
                    shift = k * pow(BASE, depth - 1, PRIME)
                    above, key = (packed((int.from_bytes(x, "big") + s) % PRIME) for x, s in ((above, shift), (key, shift * BASE)))
                    depth, total = depth + d, total + t
                rows.append((c, depth, key, above, size, total))
            yield path_batch(rows)

    return arrow_map(local.select("part", "conv_id", "depth", "key", "above", "size", "total"), whole, PATHS)


def path_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "depth", "key", "above", "size", "total"])


def with_roots(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The rows, and a root for each conv_id."""
    none = F.lit(0).cast("long")
    return rows.unionByName(convs.select("conv_id", none.alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("above"), none.alias("size"), none.alias("total")))


def with_shared_heads(own: DataFrame, every: int, head: Column, most: int) -> DataFrame:
    """PATHS, roots included, of conversations that begin with the first turns of another.

    Conversation c takes the first `head` turns (an expression of conv_id, `most` at most) of
    conversation c - c mod `every`, all if there are fewer, and goes on with its own after as many.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(every))
    cut = F.when(F.pmod("conv_id", F.lit(every)) == 0, F.lit(0)).otherwise(head).cast("long")
    convs = staged(own.withColumn("cut", cut).groupBy("conv_id", "cut").agg(F.max(F.when(F.col("depth") == F.col("cut"), F.struct("key", "total"))).alias("own")), "convs")
    firsts = own.filter((F.col("conv_id") == base) & (F.col("depth") <= most)).withColumnRenamed("conv_id", "from")
    # A first turn goes to the every - 1 conversations that may begin with it, so none is a hot key.
    spread = firsts.withColumn("conv_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(every - 1)), lambda k: F.col("from") + k))) if every > 1 else firsts.withColumn("conv_id", F.col("from")).limit(0)
    heads = staged(spread.filter(F.col("depth") <= cut).drop("from").join(convs.select("conv_id"), "conv_id", "left_semi"), "heads")
    joints = staged(convs.join(heads.groupBy("conv_id").agg(F.max(F.struct("depth", "key", "total")).alias("head")), "conv_id", "left"), "joints")
    # A long conversation is a hot key; the other side has one row for it, so adaptive execution can split it.
    rest = own.join(joints, "conv_id").filter("depth > cut").select("conv_id", "depth", "key", "above", "size", "total", "cut", "own.key", "own.total", "head.depth", "head.key", "head.total")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, depth, key, above, size, total, cut_at, own_key, own_total, d, k, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                change = int.from_bytes(k or ROOT, "big") - int.from_bytes(own_key or ROOT, "big")
                shift = change * pow(BASE, depth - cut_at - 1, PRIME)
                above, key = (packed((int.from_bytes(x, "big") + s) % PRIME) for x, s in ((above, shift), (key, shift * BASE)))
                rows.append((c, depth - cut_at + (d or 0), key, above, size, total - (own_total or 0) + (t or 0)))
            yield path_batch(rows)

    names = ["conv_id", "depth", "key", "above", "size", "total", "cut", "own_key", "own_total", "head_depth", "head_key", "head_total"]
    return with_roots(arrow_map(rest.toDF(*names), moved, PATHS).unionByName(heads), convs)


#: Conversations whose ids are joined to one text before they meet others of their node.
IDS_TOGETHER = 65_536


def ends_digests(last: DataFrame) -> DataFrame:
    """depth, key and ends_sha256: the SHA-256 of the ascending conv_ids that end at a node, joined by commas.

    Ids come in joined runs of neighbours; a digest needs all runs of a node in order, which pass through it one by one.
    """
    run = F.floor(F.col("conv_id") / IDS_TOGETHER).alias("run")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    runs = last.groupBy("depth", "key", run).agg(ids)
    dealt = runs.repartition("depth", "key").sortWithinPartitions("depth", "key", "run").select("depth", "key", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for depth, key, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (depth, key) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, key), hashlib.sha256(own.encode())
                else:
                    state.update(b"," + own.encode())
            yield as_batch(done)
        if node is not None:
            yield as_batch([(*node, state.hexdigest())])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.string()), strict=True)], ["depth", "key", "ends_sha256"])

    return arrow_map(dealt, digest, "depth long, key binary, ends_sha256 string")


def owned_suffixes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with their owners, and a row for each conversation: conv_id, length, last_key, total, and start, the depth of the first node it owns (null: none), its node above and the bytes before it.

    A window over each node's members marks the smallest; only one row of each node and task is shuffled for it.
    """
    first = F.row_number().over(Window.partitionBy("depth", "key").orderBy("conv_id"))
    owners = staged(members.withColumn("place", first).filter("place = 1").drop("place"), "owners")
    starts = owners.groupBy("conv_id").agg(F.min(F.struct("depth", "above", (F.col("total") - F.col("size")).alias("before"))).alias("s"))
    ends = members.groupBy("conv_id").agg(F.max(F.struct("depth", "key", "total")).alias("e"))
    joined = ends.join(starts, "conv_id", "left").select("conv_id", F.col("e.depth").alias("length"), F.col("e.key").alias("last_key"), F.col("e.total").alias("total"), F.col("s.depth").alias("start"), F.col("s.above").alias("above"), F.col("s.before").alias("before"))
    return owners, staged(joined, "suffixes")


def trie(members: DataFrame) -> DataFrame:
    """One row per node of the trie of `members` (PATHS with roots): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation counts as one member of a node, so `members` must have one row
    for each conv_id and depth. An empty table gives an empty one, without a root.
    """
    members = staged(members, "members")
    owners, suffixes = owned_suffixes(members)
    begun = suffixes.filter("start > 0").select(F.col("conv_id").alias("of"), (F.col("start") - 1).alias("depth"), F.col("above").alias("key"))
    parents = begun.join(owners.select("depth", "key", F.col("conv_id").alias("parent")), ["depth", "key"]).select("of", "parent")
    # The last node on a path is a leaf if no path that another conversation owns begins below it.
    grown = begun.select(F.col("depth").alias("at"), F.col("key").alias("under")).distinct()
    leaves = suffixes.filter("start is not null").join(grown, (F.col("length") == F.col("at")) & (F.col("last_key") == F.col("under")), "left_anti").select(F.col("conv_id").alias("leaf_of"))
    facts = suffixes.join(parents, F.col("conv_id") == F.col("of"), "left").join(leaves, F.col("conv_id") == F.col("leaf_of"), "left")
    owned_from = F.coalesce("start", F.col("length") + 1)
    facts = staged(facts.select("conv_id", "length", owned_from.alias("start"), F.coalesce("before", "total").alias("unowned"), "parent", F.col("leaf_of").isNotNull().cast("long").alias("leaf")), "facts")
    rows = members.join(facts, "conv_id")
    unowned_below = F.greatest(F.lit(0).cast("long"), F.col("unowned") - (F.col("total") - F.col("size")))
    owned_child = ((F.col("start") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))).cast("long")
    parent = F.when(F.col("depth") == F.col("start"), F.col("parent")).when(F.col("depth") > F.col("start"), F.col("conv_id"))
    nodes = rows.groupBy("depth", "key").agg(
        F.min(F.struct("conv_id", parent.alias("parent"))).alias("owner"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(owned_child).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(unowned_below).alias("saved_tokens"),
    )
    ends = ends_digests(suffixes.select("conv_id", F.col("length").alias("depth"), F.col("last_key").alias("key")))
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.join(ends, ["depth", "key"], "left").select(F.col("owner.conv_id").alias("conv_id"), "depth", F.col("owner.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are; see `paths` and `trie`."""
    own = staged(paths(conversations), "paths")
    return trie(with_roots(own, own.select("conv_id").distinct()))


def shared_prefix_trie(conversations: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """The trie of conversations rebuilt by `with_shared_heads`: c takes crc32(decimal c) mod (`most` + 1) turns of c - c mod `every`."""
    own = staged(paths(conversations), "paths")
    return trie(with_shared_heads(own, every, F.crc32(F.col("conv_id").cast("string")) % (most + 1), most))
