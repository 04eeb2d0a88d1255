"""Progress of builds: after every so many finished tiles, in the order of event time, the rate so far and the time still needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "build string, handled long, at_ms long, elapsed_s double, tiles_per_hour double, eta_hours double"


class BuildRate(StatefulProcessor):
    """State per build: how many tiles are counted, when the first one ended, and the ends that the watermark has not passed yet.

    Late events may still come before those, so an end is counted when the watermark has passed it. One timer waits for the
    earliest of them; what is buffered is bounded by the watermark's delay.
    """

    def __init__(self, every: int, expected: int):
        self.every, self.expected = every, expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counted = handle.getValueState("counted", "handled long, first_ms long")
        self.waiting = handle.getListState("waiting", "ms long, event_id long")

    def _wait(self, ends: list[tuple[int, int]]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if ends:
            self.waiting.put(ends)
            self.handle.registerTimer(min(ends)[0])
        else:
            self.waiting.clear()

    def _held(self) -> list[tuple[int, int]]:
        return [(int(ms), int(event)) for ms, event in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [pair for batch in rows for pair in zip(batch["ms"].astype(int), batch["event_id"].astype(int), strict=True)]
        self._wait(self._held() + [(int(a), int(b)) for a, b in new])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ends = sorted(self._held())
        passed = [ms for ms, _ in ends if ms <= now]
        handled, first = tuple(self.counted.get()) if self.counted.exists() else (0, None)
        out = []
        for ms in passed:
            handled, first = handled + 1, ms if first is None else first
            if handled % self.every == 0:
                elapsed = (ms - first) / 1000.0
                rate = handled / elapsed * 3600.0 if elapsed else None
                out.append((key[0], handled, ms, elapsed, rate, (self.expected - handled) / rate if rate else None))
        if passed:
            self.counted.update((handled, first))
        self._wait(ends[len(passed):])
        if out:
            names = [c.split()[0] for c in OUTPUT.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"tiles_per_hour": float, "eta_hours": float})

    def close(self) -> None:
        pass


def build_rates(stream: DataFrame, *, every: int, expected: int) -> DataFrame:
    """A row after every ``every`` finished tiles of a build of ``expected`` ones. ``stream`` has build, event_id, ms (the end) and a
    watermark; it holds each end once."""
    return stream.groupBy("build").transformWithStateInPandas(BuildRate(every, expected), OUTPUT, "append", "eventTime")
