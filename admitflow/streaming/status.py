"""The last status of each endpoint as a stream's state (SNK3, section 2.11 of the survey), with timers for those that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from admitflow.functions import vocab as V
from admitflow.streaming.harvest import is_failure

SCHEMA = "code string, status string, pages bigint, failures bigint, at double"
_HELD = "pages long, failures long, nth int, at double, timer long"


class _LastStatus(StatefulProcessor):
    """Of an endpoint: pages and failures so far, the last page, and the timer after which it counts as stale."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", _HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        pages, failures, nth, at, timer = self.held.get() if self.held.exists() else (0, 0, -1, 0.0, 0)
        state = None
        for row in sorted(rows, key=lambda r: r["nth"]):  # a batch holds a page of each endpoint, or the few of a restart
            if row["nth"] <= nth:
                continue  # delivered again
            nth, at, state = row["nth"], row["at"], row["state"]
            pages, failures = (pages, failures + 1) if is_failure(state) else (pages + 1, 0)
        if timer:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.silent_ms
        self.handle.registerTimer(timer)
        self.held.update((pages, failures, nth, at, timer))
        yield Row(code=key[0], status=f"UNAVAILABLE:{state}" if is_failure(state) else "OK", pages=pages, failures=failures, at=at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        pages, failures, nth, at, _ = self.held.get()
        self.held.update((pages, failures, nth, at, 0))
        yield Row(code=key[0], status="STALE", pages=pages, failures=failures, at=at)

    def close(self) -> None:
        pass


def last_statuses(pages: DataFrame, silent_seconds: float = V.STALE_SECONDS) -> DataFrame:
    """A row for each endpoint and batch with pages of it, and one with STALE once nothing came for `silent_seconds`.

    Rows are updates: the last one of a code counts, so they go to a store that keeps it. The session needs the RocksDB state store.
    """
    return pages.groupBy("code").transformWithState(_LastStatus(int(silent_seconds * 1000)), SCHEMA, "Update", "ProcessingTime")
