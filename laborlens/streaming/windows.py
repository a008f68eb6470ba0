"""Windowed counters over events: each takes a batch or a streaming DataFrame.

``late`` is the watermark: how long a stream waits for late rows before it closes
a window and drops its state. Batch runs see every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(events: DataFrame, window, keys: list[str], time_col: str, late: str) -> DataFrame:
    rows = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    rows = rows.withWatermark(time_col, late) if events.isStreaming else rows
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def tumbling(events: DataFrame, length: str, keys: list[str], time_col: str = "ts", late: str = "10 minutes", offset: str = "0 seconds") -> DataFrame:
    """``(start, end, *keys, n)``. A day that begins at midnight in Seoul has the offset 15 hours."""
    return _counts(events, F.window(time_col, length, length, offset), keys, time_col, late)


def sliding(events: DataFrame, length: str, step: str, keys: list[str], time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    return _counts(events, F.window(time_col, length, step), keys, time_col, late)


def sessions(events: DataFrame, gap: str, keys: list[str], time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A session ends ``gap`` after its last event."""
    return _counts(events, F.session_window(time_col, gap), keys, time_col, late)


def within_limit(counts: DataFrame, limit: int) -> DataFrame:
    """``counts`` with ``allowed``: whether the window's count is within the limit."""
    return counts.withColumn("allowed", F.col("n") <= limit)
