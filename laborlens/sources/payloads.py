"""Raw payloads into rows: JSON list and detail answers, HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import html
from laborlens.sources.market import Market

LIST = "source STRING, jobs ARRAY<STRUCT<id: BIGINT, title: STRING, location: STRING, career_min: INT>>"
DETAIL = "id BIGINT, location STRING, title STRING"


def listed(lists: DataFrame) -> DataFrame:
    """``(source, source_job_id, title, location, career_min)`` of list answers in column ``payload``; broken ones give no rows."""
    rows = lists.select(F.from_json("payload", LIST).alias("p")).select("p.source", F.explode("p.jobs").alias("j"))
    return rows.select("source", F.col("j.id").alias("source_job_id"), "j.title", "j.location", "j.career_min")


def with_detail(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """The detail's value where it has one, else the list's."""
    d = details.select(F.from_json("payload", DETAIL).alias("d")).select("d.*").where("id is not null")
    return jobs.alias("l").join(d.alias("d"), F.col("l.source_job_id") == F.col("d.id"), "left").select(
        "l.source", "l.source_job_id", F.coalesce("d.title", "l.title").alias("title"), F.coalesce("d.location", "l.location").alias("location"), "l.career_min"
    )


def sample_lists(m: Market) -> DataFrame:
    """List answers of 50 postings, made from the posting view."""
    jobs = m.posting.groupBy("source", F.floor(F.col("id") / 50)).agg(F.array_sort(F.collect_list(F.struct("id", "title", "location", "career_min"))).alias("jobs"))
    return jobs.select(F.to_json(F.struct("source", "jobs")).alias("payload"))


def sample_details(m: Market) -> DataFrame:
    return m.posting.where("id % 3 = 0").select(F.to_json(F.struct("id", F.concat(F.lit("D "), "location").alias("location"))).alias("payload"))


def page_text(pages: DataFrame) -> DataFrame:
    """Lines of text, trimmed, blank ones and boilerplate left out, and the images of content."""
    return pages.withColumn("p", html.text_of("html")).select("page_id", "p.text", "p.images")
