"""Queries of a board's answers, made from postings so that SQL over the postings tells what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.sources import boards, kept, payloads
from laborlens.sources.folders import fresh_folder
from laborlens.sources.market import Market, expanded

_URL = "https://board.example/jobs/{}"


def lists(m: Market) -> DataFrame:
    """List answers of up to 50 items."""
    item = m.posting.selectExpr(
        "id",
        """named_struct('id', id, 'position', title, 'company', named_struct('id', company_id, 'name', concat(' C', company_id, ' ')),
 'employment_type', CASE id % 3 WHEN 0 THEN 'regular' WHEN 1 THEN 'contract' ELSE 'odd' END, 'annual_from', career_min, 'annual_to', career_max, 'is_newbie', id % 4 = 0,
 'address', named_struct('full_location', CASE WHEN id % 2 = 0 THEN location END, 'location', split_part(location, ' ', 1), 'district', CASE WHEN id % 5 <> 0 THEN 'D' END),
 'skill_tags', array(named_struct('title', 'T', 'name', 'unused'), named_struct('title', '', 'name', concat(' N', id % 7, ' ')), named_struct('title', NULL, 'name', NULL))) AS item""",
    )
    return item.groupBy(F.floor(F.col("id") / 50)).agg(F.collect_list("item").alias("data")).select(F.to_json(F.struct("data")).alias("payload"))


def details(m: Market) -> DataFrame:
    """An answer for every third posting, one without ``job`` for the next, none for the last."""
    job = """to_json(named_struct('job', named_struct('detail', named_struct('position', CASE WHEN id % 2 = 0 THEN concat('P', id) ELSE '' END, 'main_tasks', CASE WHEN id % 5 <> 0 THEN 'tasks' ELSE '' END),
 'company', named_struct('name', concat('K', company_id)), 'annual_from', CASE WHEN id % 6 = 0 THEN 7 END, 'is_newbie', CASE WHEN id % 6 = 0 THEN false END,
 'due_time', CASE WHEN id % 2 = 0 THEN '2024-05-01T09:00:00' ELSE '2024-05-01T00:00:00Z' END, 'category_tag', named_struct('child_tags', array(named_struct('text', 'Backend'))))))"""
    return m.posting.where("id % 3 < 2").selectExpr("CAST(id AS STRING) AS source_job_id", f"CASE WHEN id % 3 = 0 THEN {job} ELSE '{{}}' END AS payload")


def jobs(m: Market) -> DataFrame:
    return boards.listed(lists(m), "site_b", _URL)


def json_list(m: Market) -> DataFrame:
    found = jobs(m)
    return found.select(*(c for c in found.columns if c not in ("tech_stacks", "locations")), F.array_join("tech_stacks", ",").alias("tech_stacks"), F.try_element_at("locations", F.lit(1)).alias("location"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select(
        "source_job_id", "title", "company_name", "career_min", "newcomer", "detail_fetched", "body_extract_failed", "responsibility",
        F.array_join("job_categories", ",").alias("job_categories"), F.unix_timestamp("closed_at").alias("closed"),
    )


def json_detail(m: Market) -> DataFrame:
    return _shown(boards.with_detail(jobs(m), details(m)))


def snapshots(m: Market) -> DataFrame:
    return m.sql("SELECT 'site_b' AS source, 'position' AS kind, CAST(user_id AS STRING) AS name, CAST(event_id AS STRING) AS payload, ts AS fetched_at FROM events")


def kept_lists(m: Market) -> DataFrame:
    """List answers kept as files and read back: those of one site from the fifth on, and what is in them."""
    ranked = payloads.sample_lists(m).withColumn("source", F.get_json_object("payload", "$.source")).withColumn("number", F.get_json_object("payload", "$.jobs[0].id").cast("long"))
    folder = fresh_folder(m.spark, "bronze")
    kept.keep(ranked.select("source", F.lit("list").alias("kind"), "number", "payload"), folder)
    return payloads.listed(kept.answers(m.spark, folder, source="site_a", kind="list", first=500))


def replay(m: Market) -> DataFrame:
    """Two kept answers of each posting, of which the newer is that of ``details``."""
    new = details(m).select(F.lit("site_b").alias("source"), F.lit("position").alias("kind"), F.col("source_job_id").alias("name"), "payload", F.lit(2).alias("fetched_at"))
    old = new.withColumn("payload", F.lit('{"job": {"detail": {"position": "old"}}}')).withColumn("fetched_at", F.lit(1))
    return _shown(boards.replayed(jobs(m), old.union(new)))


_DETAIL = """SELECT CAST(id AS VARCHAR) AS source_job_id, CASE WHEN id % 6 = 0 THEN concat('P', id) ELSE title END AS title, concat(CASE WHEN id % 3 = 0 THEN 'K' ELSE 'C' END, company_id) AS company_name,
 CASE WHEN id % 6 = 0 THEN 7 ELSE career_min END AS career_min, id % 4 = 0 AND id % 6 <> 0 AS newcomer, id % 3 = 0 AS detail_fetched, id % 3 = 0 AND id % 5 = 0 AS body_extract_failed,
 CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 'tasks' END AS responsibility, CASE WHEN id % 3 = 0 THEN 'Backend' ELSE '' END AS job_categories, CASE WHEN id % 3 = 0 THEN 1714521600 END AS closed FROM job_posting"""

TABLE = {
    "src4_json_list_by_offset": (json_list, """SELECT 'site_b' AS source, CAST(id AS VARCHAR) AS source_job_id, concat('https://board.example/jobs/', id) AS url, title, concat('C', company_id) AS company_name,
 career_min, career_max, id % 4 = 0 AS newcomer, CASE id % 3 WHEN 0 THEN '정규직' WHEN 1 THEN '계약직' ELSE 'odd' END AS employment_type, CAST(company_id AS VARCHAR) AS company_source_id,
 concat('T,N', id % 7) AS tech_stacks, CASE WHEN id % 2 = 0 AND location IS NOT NULL THEN location ELSE nullif(concat_ws(' ', split_part(location, ' ', 1), CASE WHEN id % 5 <> 0 THEN 'D' END), '') END AS location FROM job_posting"""),
    "src5_json_detail_merged": (json_detail, _DETAIL),
    "src9_latest_snapshot": (lambda m: boards.latest(snapshots(m)).select("name", "payload"), """SELECT name, payload FROM (SELECT CAST(user_id AS VARCHAR) AS name, CAST(event_id AS VARCHAR) AS payload,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM events) WHERE r = 1"""),
    "src9_kept_lists": (kept_lists, "SELECT source, id AS source_job_id, title, location, career_min FROM (SELECT *, min(id) OVER (PARTITION BY source, id // 50) AS first_of FROM job_posting) WHERE source = 'site_a' AND first_of >= 500"),
    "src10_replay": (replay, _DETAIL),
}

QUERIES = {k: (lambda f: lambda spark, sf_dir: f(Market(spark, sf_dir)))(f) for k, (f, _) in TABLE.items()}
SQL = {k: expanded(sql) for k, (_, sql) in TABLE.items()}
