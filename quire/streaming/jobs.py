"""Ingestion jobs, their state, and rate limits as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, ListState, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quire.operators.embeddings import Provider
from quire.plans.ingest import ingest
from quire.session import ship
from quire.sources.files import SCHEMA
from quire.store import Store


def ingest_stream(spark: SparkSession, folder: str, store: Store, provider: Provider, checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Ingest what is new in a folder, some files at a time, and stop when all is done."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).load(folder)

    def batch(rows: DataFrame, _: int) -> None:
        ingest(rows, store, provider)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_state_stream(events: DataFrame) -> DataFrame:
    """The newest status of each job from a stream of (job_id, seq, status)."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("n_events"))


def admit(times: list[int], offered: list[int], limit: int, micros: int) -> tuple[list[int], list[bool]]:
    """Which offered times are admitted, given those admitted before: at most `limit` within any `micros` past. Rejected ones do not count."""
    kept, verdicts = deque(times), []
    for t in offered:
        while kept and kept[0] < t - micros:
            kept.popleft()
        ok = limit <= 0 or len(kept) < limit
        if ok and limit > 0:
            kept.append(t)
        verdicts.append(ok)
    return list(kept), verdicts


def admitted(requests: DataFrame, limit: int = 120, seconds: int = 60) -> DataFrame:
    """Requests (client, event_id, at in microseconds) with admitted, by a sliding window for each client.

    Whether a request counts depends on the verdicts before it, so a client's
    requests are folded in time order, in batches of a sorted partition: a hot
    client needs no more memory than its window.
    """
    ship(requests.sparkSession)
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = requests.select("client", "event_id", "at").repartition(n, "client").sortWithinPartitions("client", "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, kept = None, []
        for batch in batches:
            out = []
            for own, rows in batch.groupby("client", sort=False, dropna=False):
                kept = kept if own == client else []
                client = own
                kept, verdicts = admit(kept, rows["at"].tolist(), limit, seconds * 1_000_000)
                out.append(rows.assign(admitted=verdicts))
            if out:
                yield pd.concat(out)[["client", "event_id", "at", "admitted"]]

    return dealt.mapInPandas(run, "client long, event_id long, at long, admitted boolean")


class Limiter(StatefulProcessor):
    """One client's sliding window: requests wait until the watermark has passed them, and are judged in the order of their times."""

    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at long")
        self.kept = handle.getListState("kept", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times = []
        for batch in rows:
            self.waiting.appendList([(int(i), int(t)) for i, t in zip(batch["event_id"], batch["at"], strict=True)])
            times += batch["at"].tolist()
        self.handle.registerTimer(after_ms(min(times)))
        yield pd.DataFrame({"client": [], "event_id": [], "at": [], "admitted": []}).astype({"client": "int64", "event_id": "int64", "at": "int64", "admitted": "bool"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((r[1], r[0]) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in waiting if after_ms(r[0]) <= passed]
        kept, verdicts = admit([r[0] for r in self.kept.get()] if self.kept.exists() else [], [t for t, _ in ready], self.limit, self.micros)
        left = waiting[len(ready) :]
        # What no later request can meet goes; a client without any state has none stored.
        kept = [t for t in kept if after_ms(t + self.micros) > passed]
        put_list(self.waiting, [(i, t) for t, i in left])
        put_list(self.kept, [(t,) for t in kept])
        if left:
            self.handle.registerTimer(after_ms(left[0][0]))
        if kept:
            self.handle.registerTimer(after_ms(kept[-1] + self.micros))
        yield pd.DataFrame({"client": [key[0]] * len(ready), "event_id": [i for _, i in ready], "at": [t for t, _ in ready], "admitted": verdicts}).astype({"client": "int64", "event_id": "int64", "at": "int64", "admitted": "bool"})

    def close(self) -> None:
        pass


def after_ms(micros: int) -> int:
    """The first millisecond after a time."""
    return int(micros) // 1000 + 1


def put_list(state: ListState, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def admitted_stream(requests: DataFrame, limit: int = 120, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """`admitted` for a stream, whatever order requests come in, if none is later than `late` behind the newest one.

    A request's verdict comes when the watermark has passed it; one that comes
    after that is dropped. A client's state goes with a timer when its window is
    over. Sets the session's state store to RocksDB, which the operator needs.
    """
    spark = requests.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = requests.select("client", "event_id", "at", F.timestamp_micros("at").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("client").transformWithStateInPandas(Limiter(limit, seconds * 1_000_000), "client long, event_id long, at long, admitted boolean", "append", "eventTime")
