"""Chart payloads as one JSON value; the rows are those of a top list, so they are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _payload(df: DataFrame, kind: str, title: str, row) -> DataFrame:
    rows = F.sort_array(F.collect_list(row))
    return df.agg(F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), rows.alias("data"))).alias("payload"))


def bar_chart(df: DataFrame, title: str, label: str, value: str) -> DataFrame:
    return _payload(df, "bar", title, F.struct(F.col(label).alias("label"), F.col(value).alias("value")))


def grouped_bar_chart(df: DataFrame, title: str, group: str, label: str, value: str) -> DataFrame:
    return _payload(df, "grouped_bar", title, F.struct(F.col(group).alias("group"), F.col(label).alias("label"), F.col(value).alias("value")))


def table_chart(df: DataFrame, title: str) -> DataFrame:
    return _payload(df, "table", title, F.struct(*df.columns))
