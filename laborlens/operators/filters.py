"""Posting filters as columns; every clock is an explicit ``as_of``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.sources.market import AS_OF, Market

# Grades, the two subsets that drive the analytics, and career levels as closed ranges.
GRADES = {"tag": 3, "required": 2, "preferred": 1, "body": 0}
DEMAND = ("tag", "required", "preferred")
STRICT = ("tag", "required")
CAREER = {"newcomer": (0, 0), "junior": (1, 3), "mid": (4, 7), "senior": (8, 1_000)}


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@dataclass(frozen=True)
class Scope:
    """Which postings count. An explicit half-open window beats ``days``; a posting without a date is in no window."""

    field: str | None = None
    size_type: str | None = None
    career: str | None = None
    days: int | None = None
    window: tuple[str, str] | None = None
    as_of: str = AS_OF


def career_overlaps(level: str) -> Column:
    low, high = CAREER[level]
    return (F.coalesce("career_min", F.lit(0)) <= high) & (F.col("career_max").isNull() | (F.col("career_max") >= low))


def within(start: str, end: str) -> Column:
    return (F.col("posted_at") >= moment(start)) & (F.col("posted_at") < moment(end))


def postings(m: Market, scope: Scope) -> DataFrame:
    """Postings that survive the scope. Dimensions are semi-joined, so nothing multiplies."""
    out = m.posting
    if scope.window:
        out = out.where(within(*scope.window))
    elif scope.days is not None:
        out = out.where(F.col("posted_at") >= moment(scope.as_of) - F.expr(f"interval {scope.days} days"))
    if scope.career:
        out = out.where(career_overlaps(scope.career))
    if scope.field:
        out = out.join(m.field.where(F.col("code") == scope.field).select(F.col("id").alias("field_id")), "field_id", "left_semi")
    if scope.size_type:
        out = out.join(m.company.where(F.col("size_type") == scope.size_type).select(F.col("id").alias("company_id")), "company_id", "left_semi")
    return out


def active(as_of: str = AS_OF) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") >= moment(as_of))


def share(part: Column, whole: Column, places: int = 4) -> Column:
    """Ratio rounded; 0.0 where the denominator is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / F.nullif(whole, F.lit(0)), places))
