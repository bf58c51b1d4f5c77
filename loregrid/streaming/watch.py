"""Watching: file events are debounced and decide what is indexed again and what goes.

``settled`` keeps the pending event of each path as state with a processing-time timer, so a path is handed on when
it has been quiet for the gap, with no later event needed. It needs the RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from loregrid.operators import ingest

GAP, LATE = "500 milliseconds", "10 seconds"

GAP_MS = 500
#: The setting that ``settled`` needs before its query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SETTLED = "path string, op string, at timestamp, events long"


class Debounce(StatefulProcessor):
    """The last event of a path, and one timer that each further event moves on."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "op string, at timestamp, n long, events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # the clock
            for _ in rows:
                pass
            return iter(())
        last = self.pending.get() if self.pending.exists() else None
        op, at, n, events = last or (None, None, None, 0)
        for frame in rows:
            events += len(frame)
            for row in frame[["op", "at", "n"]].itertuples(index=False):
                if at is None or (row.at, row.n) >= (pd.Timestamp(at), n):
                    op, at, n = row.op, row.at.to_pydatetime(), int(row.n)
        self.pending.update((op, at, n, events))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            op, at, _, events = self.pending.get()
            self.pending.clear()
            text = lambda x: pd.Series([x], dtype=object)  # noqa: E731  strings of another type do not reach Arrow as plain arrays
            yield pd.DataFrame({"path": text(key[0]), "op": text(op), "at": [pd.Timestamp(at)], "events": [events]})

    def close(self) -> None:
        pass


def settled(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """(path, op, at, events) of each path that has had no event (path, op, at, n) for ``gap_ms`` since its last one came.

    The last event by (at, n) counts, however the events are spread over micro-batches; state is one row a pending
    path and goes with it. After a restart pending paths go on waiting: none is lost, none is handed on twice
    by the stream itself. A row a second without a path is added, since a restarted query looks at its timers
    only once a row has come; events without a path are ignored.
    """
    own = events.select("path", "op", F.col("at").cast("timestamp").alias("at"), F.col("n").cast("long").alias("n"))
    clock = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    none = F.lit(None)
    own = own.unionByName(clock.select(none.cast("string").alias("path"), none.cast("string").alias("op"), none.cast("timestamp").alias("at"), none.cast("long").alias("n")))
    return own.groupBy("path").transformWithStateInPandas(statefulProcessor=Debounce(gap_ms), outputStructType=SETTLED, outputMode="Append", timeMode="ProcessingTime")


def watch_settled(events: DataFrame, upsert: Callable[[DataFrame], None], remove: Callable[[DataFrame], None], checkpoint: str, gap_ms: int = GAP_MS) -> StreamingQuery:
    """Starts a query that hands each settled path to ``upsert`` or, after ``remove`` or ``rename``, to ``remove``. A batch repeated after a failure does the same again."""

    def run(batch: DataFrame, _: int) -> None:
        gone = F.col("op").isin("remove", "rename")
        done = batch.persist()
        if done.count():  # all of it: the state of every partition has to be written
            remove(done.filter(gone))
            upsert(done.filter(~gone))
        done.unpersist()

    return settled(events, gap_ms).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(gap_ms // 2, 100)} milliseconds").start()


def bursts(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(path, started, ended, events) of each burst of events (path, op, at) of a stream, once the watermark has passed it."""
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return ingest.debounced(timed, gap)


def watch(events: DataFrame, upsert: Callable[[DataFrame], None], remove: Callable[[DataFrame], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that hands the last event of each path in a micro-batch to ``upsert`` or ``remove``.

    ``events`` has path, op, at and n (the order of events of one time); a path whose last event is
    ``remove`` or ``rename`` goes. A repeated batch, after a failure, does the same again: both have to be
    idempotent.
    """

    def run(batch: DataFrame, _: int) -> None:
        last = ingest.latest_events(batch).persist()
        gone = F.col("op").isin("remove", "rename")
        remove(last.filter(gone))
        upsert(last.filter(~gone))
        last.unpersist()

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()
