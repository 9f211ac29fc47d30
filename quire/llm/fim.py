"""Fill-in-middle texts, cut by a parallel scan of an automaton.

The automaton reads a text's bytes, counts its units (runs of letters, and all
other characters one by one) and sees whether a marker stands in it. A block of
bytes is a function: from each state, the state it ends in and the units that
begin in it. Functions compose associatively, so blocks are read side by side and
their functions combined in a tree; a walk down the tree finds where a unit
begins. A text of up to `piece` bytes is scanned by the task that reads it. The
pieces of a longer one are dealt out to all tasks: these give a function each, the
chain of the functions gives each piece its entry state and the units before it, and only
the pieces that hold a cut are read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, byte_slices, staged

MARKERS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of 100 that keep their text as it is, and of the others those that get the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

#: Classes of bytes. The bytes within a character change nothing, so they fill blocks up as well.
WITHIN, MARK, LETTER, OPEN, CLOSE, OTHER = range(6)
FILL = b"\x80"
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[0x80:0xC0] = WITHIN
for _c in range(26):
    CLASSES[[65 + _c, 97 + _c]] = LETTER
CLASSES[[ord(m[1]) for m in MARKERS]] = MARK
CLASSES[ord("<")], CLASSES[ord(">")] = OPEN, CLOSE

#: States: after no letter, after a letter, after "<", after "<" and a marker's letter; a marker was seen, and a letter stands not before or before.
START, WORD, OPENED, NAMED, SEEN, SEEN_WORD = range(6)


def step(state: int, kind: int) -> tuple[int, int]:
    """The next state, and whether a unit begins."""
    if kind == WITHIN:
        return state, 0
    letter = kind in (MARK, LETTER)
    begins = int(not letter or state not in (WORD, NAMED, SEEN_WORD))
    if state in (SEEN, SEEN_WORD) or (state == NAMED and kind == CLOSE):
        return (SEEN_WORD if letter else SEEN), begins
    if letter:
        return (NAMED if state == OPENED and kind == MARK else WORD), begins
    return (OPENED if kind == OPEN else START), begins


STATES = 6
NEXT = np.array([[step(s, k)[0] for k in range(6)] for s in range(STATES)], np.uint8).ravel()
BEGINS = np.array([[step(s, k)[1] for k in range(6)] for s in range(STATES)], np.uint8).ravel()
#: Bytes of the smallest blocks.
BLOCK = 64


class Scan:
    """The functions of some texts: `levels` has those of all blocks, of pairs of blocks, and so on up to one for each text."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], np.int64)
        data = b"".join([t.ljust(int(n) * BLOCK, FILL) for t, n in zip(texts, sizes, strict=True)])
        self.kinds = CLASSES[np.frombuffer(data, np.uint8)].reshape(-1, BLOCK)
        state = np.tile(np.arange(STATES, dtype=np.uint8), (len(self.kinds), 1))
        units = np.zeros(state.shape, np.int64)
        for column in np.ascontiguousarray(self.kinds.T):
            at = state * np.uint8(6) + column[:, None]
            units += BEGINS[at]
            state = NEXT[at]
        self.levels = [(sizes, state, units)]
        while self.levels[-1][0].max(initial=1) > 1:
            self.levels.append(paired(*self.levels[-1]))

    def ends(self, state: int = START) -> tuple[np.ndarray, np.ndarray]:
        """Each text's last state and number of units, entered in `state`."""
        return self.levels[-1][1][:, state], self.levels[-1][2][:, state]

    def find(self, text: np.ndarray, unit: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The byte of `text` at which its `unit` (from 0, less than all) begins, if the text is entered in `state`."""
        block, unit, state = np.zeros(len(text), np.int64), unit.astype(np.int64), state.astype(np.int64)
        for sizes, after, units in reversed(self.levels[:-1]):
            left = (np.cumsum(sizes) - sizes)[text] + 2 * block
            passed = units[left, state]
            right = unit >= passed
            unit = np.where(right, unit - passed, unit)
            state = np.where(right, after[left, state], state)
            block = 2 * block + right
        sizes = self.levels[0][0]
        row = (np.cumsum(sizes) - sizes)[text] + block
        found = np.full(len(text), -1, np.int64)
        for k in range(BLOCK):
            at = state * 6 + self.kinds[row, k]
            begins = BEGINS[at].astype(np.int64)
            found = np.where((found < 0) & (unit == 0) & (begins == 1), block * BLOCK + k, found)
            unit = unit - begins
            state = NEXT[at]
        return found


def paired(sizes: np.ndarray, state: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions of each text's pairs of neighbours; a last one without a neighbour stays."""
    above = (sizes + 1) // 2
    own = np.repeat(np.arange(len(sizes)), above)
    within = np.arange(len(own)) - np.repeat(np.cumsum(above) - above, above)
    left = (np.cumsum(sizes) - sizes)[own] + 2 * within
    right = np.where(2 * within + 1 < sizes[own], left + 1, len(state))
    state_or_none = np.vstack([state, np.arange(STATES, dtype=np.uint8)])
    units_or_none = np.vstack([units, np.zeros(STATES, np.int64)])
    middle = state[left]
    after = np.take_along_axis(state_or_none[right], middle, 1)
    return above, after, units[left] + np.take_along_axis(units_or_none[right], middle, 1)


def plan(doc_id: int | None, units: int, marked: bool) -> tuple[str, int, int]:
    """The form, and the units before the first and the second cut. A null doc_id counts as an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (units + 1), h[1] % (units + 1)))
    plain = not units or marked or h[2] % 100 >= 100 - PLAIN
    return "plain" if plain else "spm" if h[3] % 100 < SUFFIX_FIRST else "psm", a, b


def arranged(text: str, form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "plain":
        return text
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def short_texts(documents: DataFrame) -> DataFrame:
    """RESULT for texts that a task scans whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches, "text"):
            data = [t.encode() for t in texts]
            scan = Scan(data)
            states, units = scan.ends()
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            plans = [plan(i, n, s >= SEEN) for i, n, s in zip(ids.to_pylist(), units.tolist(), states.tolist(), strict=True)]
            cuts = np.array([[a, b] for _, a, b in plans], np.int64).reshape(-1, 2)
            text = np.repeat(np.arange(len(data)), 2)
            inside = cuts.ravel() < units[text]
            at = np.array([len(d) for d in data], np.int64)[text]
            at[inside] = scan.find(text[inside], cuts.ravel()[inside], np.zeros(int(inside.sum())))
            rows = []
            for t, d, (form, _, _), (a, b) in zip(texts, data, plans, at.reshape(-1, 2).tolist(), strict=True):
                parts = [x.decode() for x in (d[:a], d[a:b], d[b:])]
                rows.append((form, *([None, None] if form == "plain" else map(len, parts[:2])), arranged(t, form, *parts)))
            columns = [list(x) for x in zip(*rows, strict=True)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(units, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return arrow_map(documents, run, RESULT)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a text's functions in order: for each piece its entry state, the units before it and its own, and the text's units and whether it has a marker."""
    for batch in batches:
        rows = []
        for digest, steps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            state, before, own = START, 0, []
            for s in steps:
                own.append((digest, s["part"], state, before, s["units"][state]))
                state, before = s["after"][state], before + s["units"][state]
            rows += [(*x, before, state >= SEEN) for x in own]
        names = ["digest", "part", "state", "before", "units", "n", "marked"]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        columns = zip(*rows, strict=True) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans = [plan(*x) for x in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)]
        columns = [pa.array([p[k] for p in plans], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "digest", "n", "form", "a", "b"])


#: Units of a piece whose cuts are found together.
TOGETHER = 4096


def long_texts(documents: DataFrame, piece: int) -> DataFrame:
    """RESULT for texts of more than `piece` bytes. Equal texts are scanned once."""
    data = F.col("text").cast("binary")
    keyed = documents.select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    starts = F.sequence(F.lit(0), ((F.octet_length("text") - 1) / piece).cast("int"))
    cut = F.transform(starts, lambda k: F.substring(data, k * piece + 1, F.lit(piece)))
    pieces = staged(keyed.select("digest", F.posexplode(cut).alias("part", "data")).dropDuplicates(["digest", "part"]), "pieces")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                level = Scan([batch.column(2)[k].as_py()]).levels[-1]
                after, units = pa.array([level[1][0].tolist()], pa.list_(pa.int32())), pa.array([level[2][0].tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in (0, 1)), after, units], ["digest", "part", "after", "units"])

    found = arrow_map(pieces.select("digest", "part", "data"), functions, "digest string, part int, after array<int>, units array<long>")
    # A text's functions are few: a string has 2 GB at most.
    steps = found.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("part", "after", "units"))).alias("steps"))
    chain = staged(arrow_map(steps, chained, "digest string, part int, state int, before long, units long, n long, marked boolean"), "chain")
    texts = keyed.select("doc_id", "digest").distinct().join(chain.filter("part = 0").select("digest", "n", "marked"), "digest")
    plans = staged(arrow_map(texts.select("doc_id", "digest", "n", "marked"), planned, "doc_id long, digest string, n long, form string, a long, b long"), "plans")
    wanted = plans.filter("form <> 'plain'").select("digest", F.explode(F.array("a", "b")).alias("at")).distinct()
    held = wanted.join(chain, "digest").filter("at >= before and at < before + units")
    # The cuts of many copies with different ids may meet in one piece: it is read once for each run of units.
    asked = held.groupBy("digest", "part", "state", "before", F.floor(F.col("at") / TOGETHER).alias("run")).agg(F.collect_set("at").alias("ats"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, part, state, before, ats, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.array(ats, np.int64)
                place = part * piece + Scan([own]).find(np.zeros(len(at), np.int64), at - before, np.full(len(at), state))
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(at)), pa.array(at), pa.array(place)], ["digest", "at", "place"])

    cuts = staged(arrow_map(asked.join(pieces, ["digest", "part"]).select("digest", "part", "state", "before", "ats", "data"), find, "digest string, at long, place long"), "cuts")
    first, second = (cuts.select(F.col("digest").alias(f"d{c}"), F.col("at").alias(f"at{c}"), F.col("place").alias(f"place{c}")) for c in "ab")
    placed = plans.join(first, (F.col("digest") == F.col("da")) & (F.col("a") == F.col("ata")), "left").join(second, (F.col("digest") == F.col("db")) & (F.col("b") == F.col("atb")), "left")
    placed = staged(placed.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "n", "form", "placea", "placeb"), "placed")
    rows = keyed.join(placed, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    size = F.octet_length("text")
    a, b = (F.coalesce(F.col(c), size).cast("int") for c in ("placea", "placeb"))  # a cut after all units has no place
    prefix, middle, suffix = (x.cast("string") for x in (F.substring(data, F.lit(1), a), F.substring(data, a + 1, b - a), F.substring(data, b + 1, size)))
    plain, psm = F.col("form") == "plain", F.col("form") == "psm"
    output = F.when(plain, F.col("text")).when(psm, F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    chars = [F.when(~plain, F.length(x).cast("long")).alias(name) for x, name in ((prefix, "prefix_chars"), (middle, "middle_chars"))]
    return rows.select("doc_id", "n", "form", *chars, output.alias("output"))


def fill_in_middle(documents: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n units, form, prefix_chars, middle_chars, and the text arranged by its form as `output`.

    A null text counts as empty, a null doc_id as an empty one in the hash that
    chooses the cuts; repeated rows stay and are cut alike; other columns are ignored,
    whatever their names; an empty table gives an empty one. `piece` bounds what one task
    scans of a text; it changes the work, never the result. Long texts are written
    once to the shared folder, in pieces.
    """
    docs = documents.select("doc_id", "text")
    is_long = F.octet_length("text") > piece
    short = short_texts(docs.filter(F.coalesce(~is_long, F.lit(True))))
    long = docs.filter(is_long)
    return short if long.isEmpty() else short.unionByName(long_texts(long, piece))


def restored(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` arranged as `output`. No part holds a marker, nor makes one with what stands beside it, so these split it into its three parts."""
    parts = F.split(output, "|".join(MARKERS), -1)
    first, second, last = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, last, second)).otherwise(F.concat(second, last, first))
