"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.arrow import BATCH_BYTES, BATCH_ROWS, arrow_map, byte_slices, small_batches

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "UnitCache", "arrow_map", "below", "byte_slices", "fresh", "new_folder", "read_table", "shared_dir", "small_batches", "staged"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    The written files replace the lineage: they outlive lost executors, and what
    reads them twice does not compute them twice.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), value)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def below(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the given share of all; no share is too small to be told from none."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(share * 2**64) - 2**63)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, whatever the case of its letters."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


class UnitCache:
    """Results for the distinct units (words, runs between spaces) of texts, each computed once while it stays.

    `encode` maps a list of units to a list of results; it gets about
    `batch_chars` characters at a time. Results live in two generations of at
    most `limit` units each, besides those of the call at hand: a full young
    generation becomes the old one, and what is asked for again moves up.
    """

    def __init__(self, encode: Callable[[list], list], limit: int = 150_000, batch_chars: int = 1 << 16):
        self.encode, self.limit, self.batch_chars = encode, limit, batch_chars
        self.known: dict = {}
        self.old: dict = {}

    def learn(self, units: Iterable) -> dict:
        """A dictionary that has the results of all these units."""
        known, old = self.known, self.old
        missing = {u for u in units if u not in known}
        if len(known) + len(missing) > self.limit:
            old = self.old = known
            known = self.known = {}
            missing = set(units)
        if old:
            known.update([(u, old[u]) for u in missing if u in old])
            missing.difference_update(known.keys() & missing)
        part: list = []
        size = 0
        for u in missing:
            part.append(u)
            size += len(u) + 1 if isinstance(u, str) else 1
            if size >= self.batch_chars:
                known.update(zip(part, self.encode(part), strict=True))
                part, size = [], 0
        if part:
            known.update(zip(part, self.encode(part), strict=True))
        return known

    def runs(self, lists: list[list]) -> Iterator[tuple[int, list]]:
        """For each list of units, by its place, their results, in runs of at most SEGMENT; a list without units has one empty run."""
        whole = [u for units in lists if len(units) <= SEGMENT for u in units]
        known = self.learn(whole) if whole else {}
        for k, units in enumerate(lists):
            if len(units) <= SEGMENT:
                yield k, [known[u] for u in units]
        for k, units in enumerate(lists):
            if len(units) > SEGMENT:
                for i in range(0, len(units), SEGMENT):
                    known = self.learn(part := units[i : i + SEGMENT])
                    yield k, [known[u] for u in part]


#: Units looked up at once in a very long text.
SEGMENT = 200_000
