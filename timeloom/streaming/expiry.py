"""Exports that expire, as a stream: timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

EXPIRIES = StructType([StructField("export_id", LongType()), StructField("expires_ms", LongType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: From the year 1 to 1970. A watermark starts at 1970 and takes all before it as late, so the stream's clock is this much ahead of the events'.
AHEAD_MS = 62_135_596_800_000


class Expiry(StatefulProcessor):
    """Of an export, the time that it expires at and the timer for it. A later export under the id takes the place of the earlier one, as
    publishing again does; state goes with the timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("created_ms", LongType()), StructField("expires_ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max((r.created_ms, r.created_ms + r.ttl_hours * 3_600_000) for r in rows)
        held = self.held.get()
        was = tuple(held) if held is not None else None
        if was is None or best > was:
            if was:
                self.handle.deleteTimer(was[1] + AHEAD_MS)
            self.held.update(best)
            self.handle.registerTimer(best[1] + AHEAD_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() - AHEAD_MS
        held = self.held.get()
        if held is not None and held[1] == at:
            self.held.clear()
            yield Row(export_id=key[0], expires_ms=at)

    def close(self) -> None:
        pass


def expiries(exports: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(export_id, expires_ms) of a stream (export_id, created_ms, ttl_hours, ts) once its watermark on ``ts`` is past that time: what
    ``expired_exports`` tells of the newest row of each id. ``ts`` is from the year 1 to 8000. Needs the state store of ``rocks``."""
    timed = exports.select("export_id", "created_ms", "ttl_hours", F.timestamp_micros(F.unix_micros("ts") + AHEAD_MS * 1000).alias("ts"))
    return timed.withWatermark("ts", delay).groupBy("export_id").transformWithState(Expiry(), EXPIRIES, "append", "eventtime")


class rocks:
    """Queries that start inside keep their state in RocksDB, which timers need; the session is as before afterwards."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.was = self.conf.get(self.KEY, None)
        self.conf.set(self.KEY, ROCKS)

    def __exit__(self, *_) -> None:
        self.conf.set(self.KEY, self.was) if self.was else self.conf.unset(self.KEY)
