"""Event-time timers: a running tile that falls silent is reported as failed."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "tile_id string, updated_at_ms long, status string"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Timers need the RocksDB state store; the session's own choice is restored afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class StaleTile(StatefulProcessor):
    """State per tile: time and status of its latest event. One timer while it runs."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.last.get()) if self.last.exists() else None
        for batch in rows:
            newest = batch.sort_values(["ms", "event_id"]).iloc[-1]
            if best is None or int(newest["ms"]) >= best[0]:
                best = (int(newest["ms"]), str(newest["status"]))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.last.update(best)
        if best[1] == "running":
            self.handle.registerTimer(best[0] + self.quiet_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, status = self.last.get()
        if status == "running":
            self.last.update((ms, "failed"))
            yield pd.DataFrame({"tile_id": [key[0]], "updated_at_ms": [ms], "status": ["failed"]})

    def close(self) -> None:
        pass


def stale_tiles(stream: DataFrame, *, quiet_minutes: int) -> DataFrame:
    """Tiles silent for ``quiet_minutes`` while running. ``stream`` has tile_id, event_id, status, ms and a watermark."""
    return stream.groupBy("tile_id").transformWithStateInPandas(
        StaleTile(quiet_minutes * 60_000), OUTPUT, "append", "eventTime"
    )
