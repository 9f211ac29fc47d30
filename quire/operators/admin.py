"""Reports on documents, jobs, traces and conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import page


def with_counts(rows: DataFrame, key: str, **parts: tuple[DataFrame, str]) -> DataFrame:
    """Rows with a count for each of the parts (a table and its foreign key), 0 where it has none.

    Each part is counted before the join, so no join multiplies rows.
    """
    for name, (table, foreign) in parts.items():
        counts = table.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias(name))
        rows = rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return rows


def paged(rows: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the rows in an order that must end in a unique key."""
    limit, offset = page(limit, offset)
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_after(rows: DataFrame, order: list[tuple[str, bool]], last: Sequence[object] | None = None, limit: int = 100) -> DataFrame:
    """The rows that follow `last`, a row's values in the columns of the order, whose last one is unique; the first page without it.

    `order` has columns and whether they descend; nulls come last. The bound of the
    first column is a filter of its own, which a scan of Parquet can take: rows
    before it are not sorted, and files and row groups without any after it not read.
    """
    limit, _ = page(limit, 0)
    if last is not None:
        following, same = F.lit(False), F.lit(True)
        for (name, descends), value in zip(order, last, strict=True):
            column = F.col(name)
            beyond = F.lit(False) if value is None else ((column < F.lit(value)) if descends else (column > F.lit(value))) | column.isNull()
            following = following | (same & beyond)
            same = same & column.eqNullSafe(F.lit(value))
        name, descends = order[0]
        bound = F.col(name).isNull() if last[0] is None else ((F.col(name) <= F.lit(last[0])) if descends else (F.col(name) >= F.lit(last[0]))) | F.col(name).isNull()
        rows = rows.filter(bound).filter(following)
    keys = [F.desc_nulls_last(name) if descends else F.asc_nulls_last(name) for name, descends in order]
    return rows.orderBy(*keys).limit(limit)


def since_buckets(rows: DataFrame, ts: str, as_of: Column | None = None) -> DataFrame:
    """How many rows lie in the day, month and year of `as_of` (default: the newest row's time), and in all; one row."""
    if as_of is None:
        as_of = rows.agg(F.max(ts)).scalar()
    units = {"today": "day", "this_month": "month", "this_year": "year"}
    return rows.agg(*[F.count_if(F.col(ts) >= F.date_trunc(u, as_of)).alias(n) for n, u in units.items()], F.count(F.lit(1)).alias("total"))


def status_pivot(rows: DataFrame, status: str, names: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(status) == n).alias(n) for n in names], F.count(F.lit(1)).alias("total"))


def latest_state(events: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Each key's status in its last event, and how many events it has."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("n_events"))


def stage_snapshot(events: DataFrame, stage: str, status: Column, value: str, *order: str, started: str | None = None, as_of: Column | None = None) -> DataFrame:
    """For each stage its events, the sum of its durations, and the status of its last event.

    With `as_of`, a stage whose last status is `started` counts the time since
    that event too: the first of `order` must then be a timestamp.
    """
    marked = events.withColumn("_status", status)
    last = F.max_by("_status", F.struct(*order))
    total = F.sum(value)
    if started is not None and as_of is not None:
        running = (F.unix_micros(as_of) - F.unix_micros(F.max(F.col(order[0]).cast("timestamp")))) / 1000.0
        total = F.coalesce(total, F.lit(0.0)) + F.when(last == started, running).otherwise(F.lit(0.0))
    return marked.groupBy(stage).agg(F.count(F.lit(1)).alias("n_events"), F.round(total, 4).alias("total_ms"), last.alias("status"))


def operation_metrics(events: DataFrame, operation: str, failed: Column, value: str) -> DataFrame:
    return events.groupBy(operation).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~failed).alias("succeeded"),
        F.count_if(failed).alias("failed"),
        F.round(F.sum(value), 4).alias("duration_ms"),
    )


def session_list(messages: DataFrame, session: str, order: str) -> DataFrame:
    """A row per conversation: messages, first user message as the title, last turn."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(order)))
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("n_messages"), F.max(order).alias("last_turn"), first.alias("first_text"))


def session_title(messages: DataFrame, session: str, order: str, limit: int = 80) -> DataFrame:
    """A conversation's title: the first `limit` characters of its first message that is not empty, else New chat."""
    said = messages.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    titles = said.groupBy(session).agg(F.min_by(F.substring("text", 1, limit), order).alias("title"))
    return messages.select(session).distinct().join(titles, session, "left").withColumn("title", F.coalesce("title", F.lit("New chat")))


def readiness(vectors: Column, children: Column) -> Column:
    """Indexed share in whole per cent, at most 100; null if either count is 0."""
    return F.when((vectors > 0) & (children > 0), F.least(F.lit(100), F.round(vectors * 100.0 / children)).cast("int"))


def index_stats(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    spark = next(iter(tables.values())).sparkSession
    return spark.range(1).select(*[t.agg(F.count(F.lit(1))).scalar().alias(name) for name, t in tables.items()])


def event_arrays(events: DataFrame, key: str, *fields: str) -> DataFrame:
    """Each key's events in order, as an array; a key's events are those of one job, so few."""
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("events"))


def queued(jobs: DataFrame, status: str, *order: str) -> DataFrame:
    """The queued jobs, the next one first."""
    return jobs.filter(F.col(status) == "queued").orderBy(*order)


def offered_in_window(requests: DataFrame, client: str, ts: str, seconds: int) -> DataFrame:
    """Adds offered: the client's requests in the last `seconds`, its own included, admitted or not."""
    w = Window.partitionBy(client).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("offered", F.count(F.lit(1)).over(w))


def first_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
