"""A stored full-text index: postings in files by bucket of their term, in blocks by range of their document.

A unit is a text that is indexed once (a chunk, a file name); a target is what a
search finds, one or several units in a row (a chunk, its parent and its file's
name). A block has units of one term and one range of owners, with the most times
any of them has the term. In blocks a unit is its number within its folder and
range; a folder has its units' names beside its blocks. A search reads the files of
its terms' buckets alone: first the blocks' headers, which give each range the best
score that it can have, then the ranges with the best prospects, and then those that
can still reach the n-th best score. Each commit adds postings for its own texts;
`compact` merges them and leaves out what no target has any longer.

What is shuffled is texts once, by range, and names: a task makes the blocks of its
ranges, and a merge reads each bucket in a task of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.arrow import arrow_map
from quire.log import Change, Snapshot
from quire.operators.retrieval import all_of, any_of, covers, query_groups, stem_of, stems, words
from quire.store import Store

#: Buckets of terms, and bits of a range's number: about a thousand units to a range keep blocks small.
BUCKETS, RANGE_BITS = 64, 10
#: Ranges that a search for the n best reads at first.
FIRST = 16
BLOCK = "term string, range int, most int, units int, entries array<struct<number:int,positions:array<int>>>"
UNIT = "unit string, range int, number int, words int"
#: What a folder of postings has: blocks, in a folder for each bucket, and units, in one beside them.
ROW = f"{BLOCK}, unit string, number int, words int"
UNITS = -1


@dataclass(frozen=True)
class Found:
    """Targets with lexical_score; the blocks that the query's terms have, and those read."""

    rows: DataFrame
    blocks: int
    read: int


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


#: Words whose places are sorted at once, and those of a task's blocks at once.
WORDS_AT_ONCE, BLOCKED_AT_ONCE = 200_000, 1_000_000
#: Units whose new numbers, 4 bytes each, a merge hands to all tasks at once; beyond them it takes some ranges after others.
NUMBERED_AT_ONCE = 5_000_000


def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (unit, range, stems) a row for each unit and term with its places; an empty stem has none. Some units at a time, as arrays."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + WORDS_AT_ONCE, side="right")))
            yield places_of(batch.slice(start, end - start))
            start = end


def places_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    sizes = pc.fill_null(pc.list_value_length(rows.column(2)), 0).to_numpy(zero_copy_only=False)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stems_ = rows.column(2).flatten()
    known = pc.fill_null(pc.not_equal(stems_, ""), False).to_numpy(zero_copy_only=False)
    coded = stems_.dictionary_encode()
    code = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    unit, place, code = unit[known], place[known], code[known]
    order = np.lexsort((code, unit))  # stable: places stay in order
    unit, place, code = unit[order], place[order], code[order]
    firsts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (code[1:] != code[:-1])])) if len(unit) else np.zeros(0, np.int64)
    positions = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(unit)), pa.int32()), pa.array(place, pa.int32()))
    at = pa.array(unit[firsts])
    columns = [coded.dictionary.take(pa.array(code[firsts])), rows.column(1).take(at), rows.column(0).take(at), positions]
    return pa.RecordBatch.from_arrays(columns, ["term", "range", "unit", "positions"])


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (unit, range, stems) in the order of ranges a row for each unit, with its number within its range, and blocks, each of a bounded number of words."""
    held: list[pa.RecordBatch] = []
    size, last, count = 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ranges = batch.column(1).to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))
        sizes = np.diff(np.append(firsts, len(ranges)))
        numbers = np.arange(len(ranges)) - np.repeat(firsts, sizes)
        if ranges[0] == last:
            numbers[: sizes[0]] += count
        last, count = ranges[-1], numbers[-1] + 1
        number = pa.array(numbers, pa.int32())
        yield rows_of({"unit": batch.column(0), "range": batch.column(1), "number": number, "words": pc.fill_null(pc.list_value_length(batch.column(2)), 0)})
        for part in by_term(iter([pa.RecordBatch.from_arrays([number, batch.column(1), batch.column(2)], ["unit", "range", "stems"])])):
            held.append(part)
            size += len(part.column(3).flatten())
            if size >= BLOCKED_AT_ONCE:
                yield blocks_of(held)
                held, size = [], 0
    if held:
        yield blocks_of(held)


def blocks_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Blocks of (term, range, unit: a number, positions) in the order of ranges and numbers."""
    rows = pa.Table.from_batches(parts)
    terms = rows.column("term").combine_chunks().dictionary_encode()
    code, ranges, number = terms.indices.to_numpy(zero_copy_only=False), rows.column("range").to_numpy(), rows.column("unit").to_numpy()
    order = np.argsort(code, kind="stable")
    code, ranges, number = code[order], ranges[order], number[order]
    firsts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (ranges[1:] != ranges[:-1]))) if len(code) else np.zeros(0, np.int64)
    positions = rows.column("positions").combine_chunks().take(pa.array(order))
    return blocks(terms.dictionary.take(pa.array(code[firsts])), ranges[firsts], np.append(firsts, len(code)), number, positions)


def blocks(terms: pa.Array, ranges: np.ndarray, ends: np.ndarray, number: np.ndarray, positions: pa.Array) -> pa.RecordBatch:
    """Rows of blocks; `ends` has where the first begins and each ends among the units' numbers and positions."""
    most = np.maximum.reduceat(pc.list_value_length(positions).to_numpy(), ends[:-1]) if len(ends) > 1 else np.zeros(0, np.int32)
    entries = pa.StructArray.from_arrays([pa.array(number, pa.int32()), positions], ["number", "positions"])
    heads = {"term": terms, "range": pa.array(ranges, pa.int32()), "most": pa.array(most, pa.int32()), "units": pa.array(np.diff(ends), pa.int32())}
    return rows_of({**heads, "entries": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)})


def merger(given: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of (term, range, part, entries) in the order of terms and ranges, merged where both are equal, under their units' new numbers.

    `given` has where the numbers of a part and range start, and the new numbers, -1 for units that go.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # blocks that may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                rows = joined([*rest, batch])
                first = firsts_of(rows)[-1]
                if first:
                    yield together(rows.slice(0, first), *given.value)
                rest = [rows.slice(first)]
        if rest:
            yield together(joined(rest), *given.value)

    return merged


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def firsts_of(rows: pa.RecordBatch) -> np.ndarray:
    """Where a term and range begin."""
    code, ranges = rows.column(0).dictionary_encode().indices.to_numpy(), rows.column(1).to_numpy()
    return np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (ranges[1:] != ranges[:-1])))


def together(rows: pa.RecordBatch, starts: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    firsts, ranges, sizes = firsts_of(rows), rows.column(1).to_numpy(), pc.list_value_length(rows.column(3)).to_numpy()
    entries = rows.column(3).flatten()
    number = new[np.repeat(starts[rows.column(2).to_numpy(), ranges], sizes) + entries.field(0).to_numpy()]
    block = np.repeat(np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(ranges)))), sizes)
    kept = np.flatnonzero(number >= 0)
    kept = kept[np.lexsort((number[kept], block[kept]))]
    block = block[kept]
    begins = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    at = firsts[block[begins]]
    return blocks(rows.column(0).take(pa.array(at)), ranges[at], np.append(begins, len(block)), number[kept], entries.field(1).take(pa.array(kept)))


KINDS = {
    "term": pa.string(), "range": pa.int32(), "most": pa.int32(), "units": pa.int32(), "entries": pa.list_(pa.struct({"number": pa.int32(), "positions": pa.list_(pa.int32())})),
    "unit": pa.string(), "number": pa.int32(), "words": pa.int32(),
}


def rows_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows of a folder of postings with these columns, null in the others."""
    n = len(columns["range"])
    return pa.RecordBatch.from_arrays([columns[name].cast(kind) if name in columns else pa.nulls(n, kind) for name, kind in KINDS.items()], list(KINDS))


class TextIndex:
    """Tables `postings` and `text_targets` of a store."""

    def __init__(self, store: Store, buckets: int = BUCKETS, range_bits: int = RANGE_BITS):
        self.store, self.buckets, self.range_bits = store, buckets, range_bits
        store.compactors["postings"] = self.compact

    def range_of(self, owner: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(owner), 64 - self.range_bits).cast("int")

    # writing

    def put(self, change: Change, units: DataFrame, targets: DataFrame, replace: bool = True) -> None:
        """Add to a change: units (unit, owner, text) and targets (target, owner, units: array of their names in order) in place of those of the same names.

        `replace` drops all other targets of these owners as well. All units of a
        target have its owner. A null text has no words.
        """
        store, spark = self.store, self.store.spark
        # Texts are shuffled, as their stems take more room; a range's units meet in one task.
        own = units.select("unit", self.range_of(F.col("owner")).alias("range"), "text").repartition("range").sortWithinPartitions("range")
        own = own.select("unit", "range", F.coalesce(stems(F.col("text")), F.array().cast("array<string>")).alias("stems"))
        rows = arrow_map(own, posted, ROW).withColumn("bucket", F.coalesce(self.bucket(), F.lit(UNITS)))
        path = f"{store.root}/postings/rows-{uuid.uuid4().hex}"
        self._write(rows, path)
        names = spark.read.schema(UNIT).parquet(f"{path}/bucket={UNITS}") if UNITS in self._buckets(path) else spark.createDataFrame([], UNIT)
        change.drop("postings", "unit", store.saved("postings", names.select("unit").distinct(), "drop"))
        change.rows("postings", path, buckets=[b for b in self._buckets(path) if b != UNITS])
        listed = targets.select("target", "owner", F.posexplode("units").alias("at", "unit"))
        sized = listed.join(names.select("unit", "words"), "unit")
        parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "unit", "words"))), lambda p: F.struct(p["unit"].alias("unit"), p["words"].alias("words")))
        rows = sized.groupBy("target", "owner").agg(parts.alias("parts")).withColumn("range", self.range_of(F.col("owner")))
        path = store.saved("text_targets", rows.select(store.read_schema("text_targets")).sortWithinPartitions("range"))
        written = spark.read.schema(store.schema("text_targets")).parquet(path)
        if replace:
            change.drop("text_targets", "owner", store.saved("text_targets", units.select("owner").distinct(), "drop"))
        change.drop("text_targets", "target", store.saved("text_targets", written.select("target"), "drop"))
        change.rows("text_targets", path, units=written.agg(F.max(F.size("parts"))).first()[0] or 1)

    def remove(self, change: Change, owners: DataFrame) -> None:
        """Add to a change: no targets of these owners (a column `owner`) any longer."""
        change.drop("text_targets", "owner", self.store.saved("text_targets", owners.select("owner").distinct(), "drop"))

    def bucket(self) -> Column:
        return F.pmod(F.crc32("term"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        """Add rows to a folder of postings, each bucket's in a folder of its own, in the order of terms."""
        rows.sortWithinPartitions("bucket", "term", "range").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(path)

    def _buckets(self, path: str) -> list[int]:
        files, at = self.store.log._files()[0], self.store.spark._jvm.org.apache.hadoop.fs.Path(path)
        return sorted(int(name.split("=")[1]) for s in files.listStatus(at) if (name := s.getPath().getName()).startswith("bucket="))

    def compact(self) -> None:
        """Merge the blocks of all commits as of one version, and leave out units that no target has.

        Units that stay are numbered anew. A task reads all of one bucket, so blocks are not shuffled.
        """
        store = self.store
        state = store.state()
        entries, parts = state.actions("postings"), self._parts(state)
        live = store.read("text_targets", state).select(F.explode("parts.unit").alias("unit")).distinct()
        units = self._units(state)
        order = Window.partitionBy("range").orderBy("unit", "_folder", "number")
        kept = store.alive(units, "postings", entries).join(live, "unit", "left_semi").withColumn("new", F.row_number().over(order) - 1)
        path = f"{store.root}/postings/base-{uuid.uuid4().hex}"
        by_number = F.sort_array(F.collect_list(F.struct("number", "new")))
        renamed = units.select("_folder", "range", "number").join(kept.select("_folder", "range", "number", "new"), ["_folder", "range", "number"], "left")
        numbers = renamed.groupBy("_folder", "range").agg(F.transform(by_number, lambda x: F.coalesce(x["new"], F.lit(-1))).alias("new"))
        turns = -(-units.count() // NUMBERED_AT_ONCE)
        for turn in range(turns):
            own = F.pmod("range", F.lit(turns)) == turn
            self._write(self._merged(parts, kept.filter(own), numbers.filter(own), own), path)
        change = Change()
        change.base("postings", path if turns else None, state.version, buckets=[b for b in self._buckets(path) if b != UNITS] if turns else [])
        store.log.commit(change)

    def _merged(self, parts: list[dict], units: DataFrame, numbers: DataFrame, own: Column) -> DataFrame:
        """Units and blocks of some ranges under the new numbers, the blocks of a bucket in one task."""
        order = {e["path"].rsplit("/", 1)[1]: k for k, e in enumerate(parts)}
        given = numbers.toArrow()  # a row for each folder and range
        lists = given.column("new").combine_chunks()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        starts = np.zeros((len(parts), 1 << self.range_bits), np.int64)
        starts[[order[x] for x in given.column("_folder").to_pylist()], given.column("range").to_numpy()] = np.append(0, ends)[:-1]
        merge = merger(self.store.spark.sparkContext.broadcast((starts, lists.flatten().to_numpy(zero_copy_only=False))))
        part = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("_folder"))
        # Parts of a union that all have one partition would be put into one; units have several.
        fill = [F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("term", "most", "units", "entries") else F.col(f.name) for f in T.StructType.fromDDL(ROW)]
        rows = units.withColumn("number", F.col("new")).select(*fill, F.lit(UNITS).alias("bucket"))
        for b in sorted({b for e in parts for b in e["buckets"]}):
            blocks_ = self._of(parts, {b}).filter(own).select("term", "range", part.alias("part"), "entries").coalesce(1).sortWithinPartitions("term", "range")
            rows = rows.union(arrow_map(blocks_, merge, ROW).withColumn("bucket", F.lit(b)))
        return rows

    # reading

    def _parts(self, state: Snapshot) -> list[dict]:
        return [e for e in state.actions("postings") if e["kind"] in ("rows", "base") and e["path"]]

    def _of(self, parts: list[dict], buckets: set[int] | None) -> DataFrame:
        """The blocks of some buckets, or all, with the folder and version of each; no file of another bucket is opened."""
        paths = [f"{e['path']}/bucket={b}" for e in parts for b in e["buckets"] if buckets is None or b in buckets]
        schema = T.StructType.fromDDL(BLOCK)
        if not paths:
            return self.store.spark.createDataFrame([], schema).withColumns({"_folder": F.lit(""), "_version": F.lit(0).cast("long")})
        return self.store.versioned(schema, parts, paths)

    def _blocks(self, state: Snapshot, terms: Sequence[str] | None) -> DataFrame:
        """The blocks of these terms, or all."""
        rows = self._of(self._parts(state), None if terms is None else {bucket_of(t, self.buckets) for t in terms})
        return rows if terms is None else rows.filter(F.col("term").isin(*terms))

    def _units(self, state: Snapshot) -> DataFrame:
        """(unit, range, number, words) of all folders, with the folder and version of each."""
        parts = [e for e in self._parts(state) if e["buckets"] or UNITS in self._buckets(e["path"])]
        schema = T.StructType.fromDDL(UNIT)
        if not parts:
            return self.store.spark.createDataFrame([], schema).withColumns({"_folder": F.lit(""), "_version": F.lit(0).cast("long")})
        return self.store.versioned(schema, parts, [f"{e['path']}/bucket={UNITS}" for e in parts])

    def _entries(self, state: Snapshot, blocks: DataFrame, ranges: Sequence[int] | None = None) -> DataFrame:
        """(term, range, unit, positions) of the blocks, of some ranges, without units that a later commit replaced."""
        units = self._units(state)
        units = units if ranges is None else units.filter(F.col("range").isin(*ranges) if ranges else F.lit(False))
        names = self.store.alive(units, "postings", state.actions("postings")).select("_folder", "range", "number", "unit")
        return blocks.select("term", "range", "_folder", F.inline("entries")).join(names, ["_folder", "range", "number"])

    def search(self, query: str, n: int | None = None, weight: float = 0.1) -> Found:
        """target, owner and lexical_score of the targets a unit of which matches the query: all, or at least the `n` best and all that equal them.

        lexical_score is the cover density of the target's units in a row, 0
        without all the query's words. A range's best score follows from its blocks:
        each cover ends at a word of its own, and one of the rarest word is in no more covers than there are words.
        """
        state = self.store.state()
        groups = query_groups(query)
        asked = sorted({stem_of(w) for g in groups for keep, found in g if keep for w in found})
        terms = sorted({stem_of(w) for g in groups for _, found in g for w in found})
        blocks = self._blocks(state, terms) if terms else self._blocks(state, [""])
        # A target has so many units at most, each with a term as often as the block of that unit says.
        units = max((e["units"] for e in state.actions("text_targets") if "units" in e), default=1)
        most = [F.max(F.when(F.col("term") == t, F.col("most") * units)).alias(f"m{k}") for k, t in enumerate(asked)]
        heads = blocks.groupBy("range").agg(F.count(F.lit(1)).alias("blocks"), *most)
        prospects = [(self._best([r[f"m{k}"] or 0 for k in range(len(asked))], weight), r["range"], r["blocks"]) for r in heads.collect()]  # a row for each of a bounded number of ranges
        prospects.sort(key=lambda p: (-p[0], p[1]))
        total = sum(p[2] for p in prospects)
        chosen = prospects
        if n is not None and len(prospects) > FIRST:
            first = self._scored(state, groups, asked, terms, weight, [p[1] for p in prospects[:FIRST]])
            best = [r["lexical_score"] for r in first.select("lexical_score").orderBy(F.desc("lexical_score")).limit(n).collect()]
            if len(best) == n:
                chosen = [*prospects[:FIRST], *(p for p in prospects[FIRST:] if p[0] * (1 + 1e-9) >= best[-1])]
        return Found(self._scored(state, groups, asked, terms, weight, [p[1] for p in chosen]), total, sum(p[2] for p in chosen))

    @staticmethod
    def _best(most: list[int], weight: float) -> float:
        return weight * min(sum(most) - len(most) + 1, len(most) * min(most)) if most and min(most) else 0.0

    def _scored(self, state: Snapshot, groups: list, asked: list[str], terms: list[str], weight: float, ranges: list[int]) -> DataFrame:
        blocks = self._blocks(state, terms or [""]).filter(F.col("range").isin(*ranges) if ranges else F.lit(False))
        places = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{k}") for k, t in enumerate(terms)] or [F.lit(None).cast("array<int>").alias("p0")]
        units = self._entries(state, blocks, ranges).groupBy("unit").agg(*places)
        at = {t: F.col(f"p{k}") for k, t in enumerate(terms)}

        def has(found: list[str]) -> Column:
            ends = at[stem_of(found[0])]
            for word in found[1:]:
                ends = F.array_intersect(F.transform(ends, lambda x: x + 1), at[stem_of(word)])
            return F.coalesce(F.size(ends) > 0, F.lit(False))

        units = units.withColumn("matches", any_of([all_of([has(found) if wanted else ~has(found) for wanted, found in g]) for g in groups]))
        targets = self.store.read("text_targets", state).filter(F.col("range").isin(*ranges) if ranges else F.lit(False))
        offset = lambda p, k: F.aggregate(F.slice("parts", F.lit(1), k), F.lit(0), lambda s, x: s + x["words"])
        listed = targets.select("target", "owner", F.inline(F.transform("parts", lambda p, k: F.struct(p["unit"].alias("unit"), offset(p, k).alias("offset")))))

        def placed(k: int, places: Column) -> Column:
            return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda x: F.struct((x + F.col("offset")).alias("at"), F.lit(k).alias("term")))

        hit = [placed(k, at[t]) for k, t in enumerate(asked)]
        hits = F.concat(*hit) if hit else F.array().cast("array<struct<at:int,term:int>>")
        rows = listed.join(units, "unit").select("target", "owner", "matches", hits.alias("hits"))
        whole = rows.groupBy("target", "owner").agg(F.max("matches").alias("matches"), F.flatten(F.collect_list("hits")).alias("hits")).filter("matches")
        return whole.select("target", "owner", covers(F.array_sort("hits"), len(asked), weight).alias("lexical_score"))

