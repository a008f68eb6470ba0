"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, line feed, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, as in tests, a session in one process takes a temporary
    folder; on a cluster that is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def in_one(df: DataFrame) -> DataFrame:
    """``cut`` for few rows, in one partition: aggregates and joins with broadcast rows need no shuffle then, whose tasks and files would be more than the rows."""
    return cut(df.coalesce(1)).coalesce(1)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once for a row, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two longs that name a row by id and content; equal rows share them, and null ids are told apart."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull()).alias("k2"),
    ]
