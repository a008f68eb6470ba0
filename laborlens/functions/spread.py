"""Rows of a few columns dealt over all cores, before each of them becomes much work."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks a core, so that uneven ones even out.
TASKS_A_CORE = 3


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by hash of ``keys`` over a number of partitions that Spark doesn't merge.

    Small rows come from a file in a task or two, and Spark merges small shuffle
    partitions, whatever each row costs afterwards. Joins and groups by ``keys`` need no other shuffle.
    """
    spark = rows.sparkSession
    n = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys)
