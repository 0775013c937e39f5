"""Streaming forms: new documents as they land, feedback without repeats, live counts; medians and votes kept by key."""

from __future__ import annotations

import statistics
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..sources.store import Store


def landed(spark: SparkSession, folder: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """Rows of Parquet files as they are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``handle`` on every micro-batch. It must be idempotent by batch id: a batch may come again after a failure."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def votes(stream: DataFrame, time: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Feedback with repeats of the same key within the delay dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, by: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Tumbling counts; late rows within the delay are counted."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


#: The store of state that keyed processors need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastValues(StatefulProcessor):
    """The last values of a key by time, then number, and their median."""

    def __init__(self, window: int, ttl_ms: int | None):
        self.window, self.ttl_ms = window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "at timestamp, number long, value double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = [((r[0].replace(tzinfo=None), r[1]), r[2]) for r in self.held.get()]
        for df in rows:  # a batch of rows at a time, however many the key has
            new = [((pd.Timestamp(at).to_pydatetime(), int(n)), None if pd.isna(v) else float(v)) for at, n, v in zip(df["at"], df["number"], df["value"], strict=True)]
            last = sorted(dict(last + new).items())[-self.window :]  # a row that comes again is the same row
        self.held.put([(at, n, v) for (at, n), v in last])
        values = [v for _, v in last if v is not None]
        yield pd.DataFrame({"key": [key[0]], "median": [statistics.median(values) if values else None], "n": [len(values)]})


class _LatestVote(StatefulProcessor):
    """The vote of the greatest number of a key."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = max(((int(s), float(f)) for df in rows for s, f in zip(df["seq"], df["fit"], strict=True)), key=lambda x: x[0])
        known = self.last.get()
        if known is None or best[0] > known[0]:
            self.last.update((best[0],))
            yield pd.DataFrame({"query_id": [key[0]], "id": [key[1]], "fit": [best[1]], "seq": [best[0]]})


def medians(stream: DataFrame, key: str, value: str, at: str, number: str, window: int = 20, expires: timedelta | None = None) -> DataFrame:
    """(key, median, n) whenever a key has new rows: the median of its last ``window`` rows by ``at``, then ``number``, as
    ``scoring.rolling_median`` has it. State of a key that is silent for ``expires`` goes."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(number).cast("long").alias("number"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(_LastValues(window, _ms(expires)), "key string, median double, n long", "Update", "ProcessingTime" if expires else "None")


def latest_votes(stream: DataFrame, expires: timedelta | None = None) -> DataFrame:
    """Votes (query_id, id, fit, seq) that are later than all of their query and id before; of a batch the last alone."""
    rows = stream.select(F.col("query_id").cast("string").alias("query_id"), F.col("id").cast("string").alias("id"), F.col("fit").cast("double").alias("fit"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("query_id", "id").transformWithStateInPandas(_LatestVote(_ms(expires)), "query_id string, id string, fit double, seq long", "Update", "ProcessingTime" if expires else "None")


def _ms(expires: timedelta | None) -> int | None:
    return None if expires is None else int(expires.total_seconds() * 1000)


def stored(stream: DataFrame, store: Store, name: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch as a change of the table ``name``. A commit says which batch it is, so one that comes again after a failure changes
    nothing."""

    def save(batch: DataFrame, number: int) -> None:
        with store.transaction() as t:
            if t.once(f"{name}@{checkpoint}", number) and not batch.isEmpty():
                t.upsert(name, batch, key, order)

    return stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
