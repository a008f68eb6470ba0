"""Batches for an embedding model and the estimate of tokens that they hold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Tokens a character at first and at least, decay of the ratio, and the margin of what is seen.
FIRST, FLOOR, DECAY, SAFETY = 0.85, 0.45, 0.95, 1.10


def token_ratio(seen: DataFrame, keys: list[str], order: list[str], chars: str = "chars", tokens: str = "tokens") -> DataFrame:
    """``(*keys, samples, ratio)``: tokens a character after all observations of a key.

    The ratio jumps up at once and decays by ``DECAY`` an observation, never below
    ``FLOOR``. After n of them it is the largest of the floor, the first ratio
    decayed n times and each observation decayed since, so one maximum of logarithms
    stands for the fold. Observations without characters or tokens do not count.
    """
    step = math.log(DECAY)
    rows = seen.where((F.col(chars) > 0) & (F.col(tokens) > 0))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    height = F.ln(F.col(tokens) / F.col(chars) * SAFETY) - F.col("at") * step
    out = rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.max(height).alias("h"))
    decayed = F.exp(F.greatest(F.col("h"), F.lit(math.log(FIRST))) + F.col("samples") * step)
    return out.select(*keys, "samples", F.greatest(decayed, F.lit(FLOOR)).alias("ratio"))


def packed(rows: DataFrame, lane: str, order: str, size: str, most_size: int, most_rows: int | None = None) -> DataFrame:
    """``(lane, order, size, batch)``: batches from 0 on in each lane, filled in order.

    A batch ends before the row that would take it over ``most_size`` or
    ``most_rows``; a row that is larger by itself has its own. Rows stream through
    sorted partitions with two numbers of state, so a lane of any length is held by
    no task; lanes fill independently of each other.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, batch, total, n = None, 0, 0, 0
        for part in parts:
            out = []
            for key, more in zip(part["lane"], part["size"]):
                if key != current:
                    current, batch, total, n = key, 0, 0, 0
                if n and (total + more > most_size or (most_rows is not None and n >= most_rows)):
                    batch, total, n = batch + 1, 0, 0
                total, n = total + more, n + 1
                out.append(batch)
            yield part.assign(batch=out)

    lanes = rows.select(F.coalesce(F.col(lane).cast("string"), F.lit("")).alias("lane"), F.col(order).cast("long").alias("seq"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    return lanes.repartition("lane").sortWithinPartitions("lane", "seq").mapInPandas(run, "lane string, seq long, size long, batch long")
