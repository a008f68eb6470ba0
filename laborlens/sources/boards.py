"""A job board's JSON answers into postings: list pages by offset, details merged over them, kept answers replayed.

All of it is JSON functions and joins, so it stays on the JVM. A key that is absent
and one that holds null are the same here: the list's value stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = 20
# Types of contract by their names in the answers.
EMPLOYMENT = {"regular": "정규직", "contract": "계약직", "intern": "인턴", "freelance": "프리랜서"}
_ADDRESS = "address: STRUCT<full_location: STRING, location: STRING, district: STRING>"
_YEARS = "annual_from: INT, annual_to: INT, is_newbie: BOOLEAN"
ITEM = f"STRUCT<id: STRING, position: STRING, company: STRUCT<id: STRING, name: STRING>, employment_type: STRING, skill_tags: ARRAY<STRING>, {_ADDRESS}, {_YEARS}>"
POSTING = f"""STRUCT<job: STRUCT<detail: STRUCT<position: STRING, main_tasks: STRING, requirements: STRING, preferred_points: STRING, benefits: STRING, hire_rounds: STRING, intro: STRING>,
 company: STRUCT<id: STRING, name: STRING, industry_name: STRING, company_tags: ARRAY<STRING>>, skill_tags: ARRAY<STRING>, category_tag: STRUCT<child_tags: ARRAY<STRING>>,
 due_time: STRING, {_ADDRESS}, {_YEARS}>>"""


def filled(value: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(value, F.lit(""))


def tag_names(tags: Column) -> Column:
    """Names of tags that come as strings or as objects with title, name or text; blank ones are left out."""

    def name(tag: Column) -> Column:
        keyed = F.coalesce(*(filled(F.get_json_object(tag, f"$.{k}")) for k in ("title", "name", "text")))
        return F.trim(F.when(tag.startswith("{"), keyed).otherwise(tag))

    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), name), lambda t: F.length(t) > 0)


def place(address: Column) -> Column:
    """The full location, else its parts, as an array of at most one."""
    parts = F.concat_ws(" ", filled(address["location"]), filled(address["district"]))
    return F.array_compact(F.array(F.coalesce(filled(address["full_location"]), filled(parts))))


def moment(text: Column, offset: str = "+09:00") -> Column:
    """An ISO date or time as a timestamp; one that names no zone is in ``offset``, an unreadable one is null."""
    whole = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    return F.when(whole.rlike(r"(Z|[+-]\d\d:?\d\d)$"), whole).otherwise(F.concat(whole, F.lit(offset))).try_cast("timestamp")


def offset(page: Column, size: int = PAGE) -> Column:
    """Where page 1, 2 and so on of a list start."""
    return (page - 1) * size


def unreadable(lists: DataFrame) -> DataFrame:
    """Answers in column ``payload`` that are no objects with ``data``; a run over such has failed."""
    return lists.where(~F.coalesce(F.array_contains(F.json_object_keys("payload"), "data"), F.lit(False)))


def listed(lists: DataFrame, source: str, url: str, employment: dict[str, str] = EMPLOYMENT) -> DataFrame:
    """A posting for each item of list answers in column ``payload``; items without an id are left out.

    Items are parsed one by one, so that a broken one costs no other. ``url`` has ``{}`` for
    the id; ``employment`` names types of contract, others keep their own name.
    """
    items = lists.select(F.explode(F.from_json("payload", "data ARRAY<STRING>")["data"]).alias("item")).select(F.from_json("item", ITEM).alias("i")).where("i.id is not null")
    kind = F.col("i.employment_type")
    for known, name in employment.items():
        kind = F.when(F.col("i.employment_type") == known, F.lit(name)).otherwise(kind)
    before, after = url.split("{}")
    return items.select(
        F.lit(source).alias("source"),
        F.col("i.id").alias("source_job_id"),
        F.concat(F.lit(before), "i.id", F.lit(after)).alias("url"),
        F.coalesce("i.position", F.lit("")).alias("title"),
        F.trim(F.coalesce("i.company.name", F.lit(""))).alias("company_name"),
        tag_names(F.col("i.skill_tags")).alias("tech_stacks"),
        place(F.col("i.address")).alias("locations"),
        F.col("i.annual_from").alias("career_min"),
        F.col("i.annual_to").alias("career_max"),
        F.coalesce("i.is_newbie", F.lit(False)).alias("newcomer"),
        kind.alias("employment_type"),
        filled(F.col("i.company.id")).alias("company_source_id"),
    )


def with_detail(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """``jobs`` of ``listed`` with what ``details (source_job_id, payload)`` say, one answer a posting.

    A detail's value counts where it has one, else the list's. An answer without ``job``
    leaves the posting as it was, with ``detail_fetched`` false.
    """
    read = details.select("source_job_id", F.from_json("payload", POSTING)["job"].alias("d")).where("d is not null")
    d = lambda path: F.col(f"d.{path}")
    some = lambda new, old: F.when(F.size(new) > 0, new).otherwise(F.col(old)).alias(old)
    bodies = {"responsibility": "main_tasks", "qualifications": "requirements", "preferred_requirements": "preferred_points"}
    others = {"welfares": "detail.benefits", "recruit_process": "detail.hire_rounds", "company_service_info": "detail.intro", "company_industry": "company.industry_name"}
    got = F.col("d").isNotNull()
    return jobs.join(read, "source_job_id", "left").select(
        "source",
        "source_job_id",
        "url",
        F.coalesce(filled(d("detail.position")), "title").alias("title"),
        F.coalesce(filled(d("company.name")), "company_name").alias("company_name"),
        some(tag_names(d("skill_tags")), "tech_stacks"),
        tag_names(d("category_tag.child_tags")).alias("job_categories"),
        some(place(d("address")), "locations"),
        F.coalesce(d("annual_from"), "career_min").alias("career_min"),
        F.coalesce(d("annual_to"), "career_max").alias("career_max"),
        F.coalesce(d("is_newbie"), "newcomer").alias("newcomer"),
        "employment_type",
        F.coalesce(filled(d("company.id")), "company_source_id").alias("company_source_id"),
        moment(d("due_time")).alias("closed_at"),
        *(filled(d(f"detail.{path}")).alias(name) for name, path in bodies.items()),
        *(filled(d(path)).alias(name) for name, path in others.items()),
        tag_names(d("company.company_tags")).alias("company_tags"),
        got.alias("detail_fetched"),
        (got & F.coalesce(*(filled(d(f"detail.{path}")) for path in bodies.values())).isNull()).alias("body_extract_failed"),
    )


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest answer of each ``(source, kind, name)``; of equal times the greater payload."""
    newest = F.max(F.struct("fetched_at", "payload")).alias("x")
    return snapshots.groupBy("source", "kind", "name").agg(newest).select("source", "kind", "name", "x.payload", "x.fetched_at")


def store(snapshots: DataFrame, path: str) -> None:
    """Append raw answers ``(source, kind, name, payload, fetched_at)``; a folder for each source and kind."""
    snapshots.write.mode("append").partitionBy("source", "kind").parquet(path)


def stored(spark: SparkSession, path: str, source: str, kind: str) -> DataFrame:
    """The newest kept answers of one source and kind; no other folder is read."""
    return latest(spark.read.parquet(path).where((F.col("source") == source) & (F.col("kind") == kind)))


def replayed(jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``jobs`` with the details of the newest kept answers, whose name is the posting's id."""
    return with_detail(jobs, latest(snapshots).select(F.col("name").alias("source_job_id"), "payload"))
