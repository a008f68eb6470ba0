"""Crawl runs and page stops as keyed state with timers (``transformWithState``).

The state store has to be RocksDB: ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

KNOWN_PAGES = 2
ENDED = ("success", "partial", "failed")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_RUNS = "run string, status string, started_at timestamp, finished_at timestamp, rows long, stale boolean"
_PAGES = "job string, page long, run long, stop boolean"


class Runs(StatefulProcessor):
    """Start, last sign of life and rows of each open run; a timer ends the run that goes on too long."""

    def __init__(self, cutoff_ms: int, since_progress: bool):
        self.cutoff_ms, self.since_progress = cutoff_ms, since_progress

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "started long, moved long, rows long, closed boolean")

    def _row(self, key: tuple, status: str, started: int, at: int, rows: int, stale: bool) -> pd.DataFrame:
        moment = lambda ms: pd.Timestamp(ms, unit="ms", tz="UTC").tz_localize(None)
        return pd.DataFrame([(key[0], status, moment(started), moment(at), rows, stale)], columns=["run", "status", "started_at", "finished_at", "rows", "stale"])

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + self.cutoff_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        log = sorted((at, status or "", fetched) for b in rows for at, status, fetched in zip(b["at_ms"].tolist(), b["status"], b["fetched"].tolist()))
        started, moved, total, closed = self.state.get() if self.state.exists() else (log[0][0], log[0][0], 0, False)
        started = min(started, log[0][0])
        for at, status, fetched in log:
            if closed:
                break
            end = (moved if self.since_progress else started) + self.cutoff_ms
            if at > end:  # too late, whether or not the timer has fired yet
                closed = True
                yield self._row(key, "failed", started, end, total, True)
                break
            total, moved = total + fetched, max(moved, at)
            if status in ENDED:
                closed = True
                yield self._row(key, status, started, at, total, False)
        self.state.update((started, moved, total, closed))
        if closed:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        else:
            self._timer(moved if self.since_progress else started)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and not self.state.get()[3]:
            started, moved, total, _ = self.state.get()
            self.state.update((started, moved, total, True))
            yield self._row(key, "failed", started, expiredTimerInfo.getExpiryTimeInMs(), total, True)


def ended_runs(log: DataFrame, cutoff: str, delay: str, since_progress: bool = False, run_col: str = "run", at_col: str = "at") -> DataFrame:
    """``(run, status, started_at, finished_at, rows, stale)`` of a stream of ``(run, at, status, fetched)``, each run once.

    A run ends with the first row that says so. One that does not is failed, stale, at
    its start plus ``cutoff`` (with ``since_progress`` at its last row plus that), as soon as
    the watermark, ``delay`` behind the newest row, has passed that moment; rows that come later don't open it again.
    """
    ms = _millis(log, cutoff)
    rows = log.select(F.col(run_col).cast("string").alias("run"), F.col(at_col).alias("at"), F.unix_millis(at_col).alias("at_ms"), F.col("status"), F.coalesce(F.col("fetched").cast("long"), F.lit(0)).alias("fetched"))
    return rows.withWatermark("at", delay).groupBy("run").transformWithStateInPandas(Runs(ms, since_progress), outputStructType=_RUNS, outputMode="Append", timeMode="EventTime")


class Stops(StatefulProcessor):
    """How many pages in a row were all known; a timer forgets the number some time after the job's last page."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pages", "run long, moved long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        run, moved = self.state.get() if self.state.exists() else (0, None)
        out = []
        for at, page, n, known in sorted(p for b in rows for p in zip(b["at_ms"].tolist(), b["page"].tolist(), b["rows"].tolist(), b["known"].tolist())):
            run = 0 if moved is not None and at > moved + self.forget_ms else run  # whether or not the timer has fired yet
            run = run if run >= KNOWN_PAGES else run + 1 if n and n == known else 0
            moved = at if moved is None else max(moved, at)
            out.append((key[0], page, run, run >= KNOWN_PAGES))
        self.state.update((run, moved))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(moved + self.forget_ms)
        yield pd.DataFrame(out, columns=["job", "page", "run", "stop"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"job": pd.Series(dtype=str), "page": pd.Series(dtype="int64"), "run": pd.Series(dtype="int64"), "stop": pd.Series(dtype=bool)})


def stops(pages: DataFrame, forget: str = "7 days", delay: str = "1 hour", job_col: str = "job", at_col: str = "at") -> DataFrame:
    """``(job, page, run, stop)`` for a stream of ``(job, at, page, rows, known)``.

    ``run`` counts pages in a row whose rows are all known; ``KNOWN_PAGES`` of them
    stop the job. Without a page for the time ``forget`` a job's count begins anew.
    """
    rows = pages.select(F.col(job_col).cast("string").alias("job"), F.col(at_col).alias("at"), F.unix_millis(at_col).alias("at_ms"), F.col("page").cast("long"), F.col("rows").cast("long"), F.col("known").cast("long"))
    return rows.withWatermark("at", delay).groupBy("job").transformWithStateInPandas(Stops(_millis(pages, forget)), outputStructType=_PAGES, outputMode="Append", timeMode="EventTime")


def _millis(df: DataFrame, length: str) -> int:
    start = "TIMESTAMP '2000-01-01 00:00:00'"
    return df.sparkSession.range(1).select(F.expr(f"unix_millis({start} + INTERVAL {length}) - unix_millis({start})")).first()[0]
