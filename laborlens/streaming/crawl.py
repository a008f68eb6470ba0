"""Incremental crawl: list rows not seen lately, and merging of new versions. Runs and page stops are in ``runs``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from laborlens.operators import merge
from laborlens.operators.buckets import BucketTable


def first_seen(listed: DataFrame, keys: list[str], time_col: str, days: int) -> DataFrame:
    """Rows of a stream whose key was not seen in the ``days`` before; the state is dropped after that time."""
    return listed.withWatermark(time_col, f"{days} days").dropDuplicatesWithinWatermark(keys)


def unseen(listed: DataFrame, seen: DataFrame, keys: list[str], seen_col: str, since) -> DataFrame:
    """Rows of a batch whose key is not in ``seen`` at ``since`` or later."""
    return listed.join(seen.where(F.col(seen_col) >= since).select(*keys).distinct(), keys, "left_anti")


def ingest(versions: DataFrame, table: BucketTable, checkpoint: str) -> StreamingQuery:
    """Merge a stream of posting versions into a table of postings.

    A version of a key replaces those before it; of one batch the one with the
    greatest collected_at. Only buckets with a changed row are rewritten, so a batch
    that runs again after a failure changes nothing.
    """

    def write(batch: DataFrame, n: int) -> None:
        key = list(merge.POSTING_KEY)
        last = batch.groupBy(*key).agg(F.max(F.struct("collected_at", *(c for c in batch.columns if c not in (*key, "collected_at")))).alias("v"))
        table.merge(last.select(*key, "v.*"), merge.upsert_postings)

    return versions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
