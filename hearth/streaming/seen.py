"""Keys seen within a horizon, as state that expires.

A row is a first encounter if its key wasn't seen within ``horizon`` before it, however often
it is seen after.  A key's state is the time at which it was last seen; a timer drops it once
the watermark has passed the horizon behind that, so the state holds the keys of one horizon
and of the delay, not all that ever came.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Seen(StatefulProcessor):
    """Lets first encounters through; times in microseconds since 1970."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # rows of one key and micro-batch, whose size files_per_batch bounds
        ordered = sorted(((r["__micros"], k, r) for k, r in enumerate(rows)), key=lambda x: x[:2])
        last = self.last.get()[0] if self.last.exists() else None
        for at, _, row in ordered:
            if last is None or at - last > self.horizon:
                yield row
            last = at if last is None else max(last, at)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.horizon) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_encounters(stream: DataFrame, key: str, time: str, horizon: timedelta, delay: str = "1 hour") -> DataFrame:
    """The rows of a stream whose key wasn't seen within ``horizon`` before.

    Within a micro-batch rows count by their time; over micro-batches in the order in which
    they land, and rows older than the watermark by ``delay`` are dropped as late.  Null keys
    are one key.  The session's state store must be ``STORE``.
    """
    marked = stream.withColumn("__micros", F.unix_micros(F.col(time))).withWatermark(time, delay)
    seen = Seen(horizon // timedelta(microseconds=1))
    found = marked.groupBy(key).transformWithState(seen, marked.schema, "Append", "EventTime")
    return found.drop("__micros")


def first_encounters_of(rows: DataFrame, key: str, time: str, horizon: timedelta) -> DataFrame:
    """The same rule on a table: rows whose key has no row within ``horizon`` before them."""
    before = F.lag(F.unix_micros(F.col(time))).over(Window.partitionBy(key).orderBy(time))
    gap = F.unix_micros(F.col(time)) - F.col("__before")
    return rows.withColumn("__before", before).where(F.col("__before").isNull() | (gap > F.lit(horizon // timedelta(microseconds=1)))).drop("__before")
