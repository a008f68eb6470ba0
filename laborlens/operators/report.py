"""Facts of a weekly report as the text that a language model is asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the facts.
WEEK, FIELD, ALL, POSTINGS = "주차: {} 시작", "분야: {}", "전체", "이번 주 수집 공고: {}건"
POPULAR, GAINED, LOST, MENTIONS = "\n가장 많이 찾은 기술 스택", "\n최대 상승: {} {}", "최대 하락: {} {}", "\n주요 기술 언급량"
CHANGE, FRESH = "{} → {}건 ({}%)", "{}건 (신규)"
TOP = 10


def _worded(pattern: str, *values: Column) -> Column:
    """A pattern with a value for each pair of braces; null if one is null."""
    parts = pattern.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(values, parts[1:]) for x in (v, F.lit(p))))


def _number(value: Column) -> Column:
    return F.format_number(value, 0)


def change_text(previous: Column, current: Column, rate: Column) -> Column:
    """Before, after and the change in percent with its sign; a rate that is null tells of something new."""
    percent = F.format_string("%+.1f", F.round(rate * 100, 1))
    return F.when(rate.isNull(), _worded(FRESH, _number(current))).otherwise(_worded(CHANGE, _number(previous), _number(current), percent))


def facts_text(facts: DataFrame, week: str, field: str | None = None, postings: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """One row ``(text)`` from ``lookups.report_facts``: the week and field, the first ``top`` skills, who gained and lost most, and the counts of the same skills.

    ``postings`` is one row ``n``. A part without a fact is left out. The facts have a row a skill of the dictionary.
    """
    one = change_text(F.col("prev"), F.col("cur"), F.col("rate"))
    listed = lambda line: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", line.alias("line"))))), lambda x: x["line"]), "\n")
    popular = listed(_worded("  {}. {} {}", F.col("rank").cast("string"), F.col("name"), one))
    counts = listed(_worded("  {} {} → {}", F.col("name"), _number(F.col("prev")), _number(F.col("cur"))))
    ends = [F.max(F.when(F.col(flag), _worded(pattern, F.col("name"), one))) for flag, pattern in (("most_gained", GAINED), ("most_lost", LOST))]
    made = facts.agg(popular.alias("popular"), ends[0].alias("gained"), ends[1].alias("lost"), counts.alias("counts"))
    n = F.lit(None).cast("string")
    if postings is not None:
        made, n = made.join(F.broadcast(postings.agg(F.max("n").alias("n")))), _number(F.col("n"))  # one row by one row
    head = [F.lit(WEEK.format(week)), F.lit(FIELD.format(field or ALL)), _worded(POSTINGS, n)]
    lines = [F.lit(POPULAR), F.nullif("popular", F.lit("")), F.col("gained"), F.col("lost"), F.lit(MENTIONS), F.nullif("counts", F.lit(""))]
    return made.select(F.concat_ws("\n", *head, *lines).alias("text"))
