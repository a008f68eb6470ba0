"""What the dictionary misses, what is still to fetch, profiles of users, and logs of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common words of posting bodies that are no skills.
STOP_WORDS = """
and the with for you our are can will not that this from have has your who its all any
data code web app apps api apis rest system systems service services server servers
software hardware platform platforms framework frameworks library libraries tool tools
engineer engineers engineering developer developers development develop team teams
experience experienced skill skills work working job jobs role roles position
company business product products project projects solution solutions
design designing architecture architectures management manage manager
support technical technology technologies application applications environment
process processes performance quality test testing analysis research
new using use used based level high low more most other than time year years
http https www com net org github google amazon microsoft apple
""".split()
# A term starts with a letter and may hold . + # / - inside.
TERM = r"[A-Za-z][A-Za-z0-9]*(?:[.+#/-][A-Za-z0-9]+)*"
# A user's history, and the career level that it stands for.
LEVELS = {"NO_EXPERIENCE": "newcomer", "ENTRY_LEVEL": "newcomer", "JUNIOR": "junior", "MIDDLE": "mid", "SENIOR": "senior"}


def unmatched_terms(bodies: Column, postings: DataFrame, known: DataFrame, min_count: int = 10, limit: int | None = 200) -> DataFrame:
    """``(term, n)``: terms of bodies that no name or alias in ``known.term`` equals.

    Terms are counted before they meet the dictionary, so that the join sees each once.
    """
    words = postings.select(F.explode(F.regexp_extract_all(bodies, F.lit(TERM), F.lit(0))).alias("w")).select(F.lower("w").alias("term"))
    counts = words.where(F.length("term").between(3, 30) & ~F.col("term").isin(STOP_WORDS)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    out = counts.join(known.select(F.lower("term").alias("term")).where("term is not null").distinct(), "term", "left_anti")
    return out if limit is None else out.orderBy(F.desc("n"), "term").limit(limit)


def unmatched_tags(tags: DataFrame, known: DataFrame) -> DataFrame:
    """``(tag, matched, n)`` of the tags of ``(id, tag)``, lower case and trimmed; matched ones equal a name or alias, the one column of ``known``."""
    counts = tags.select(F.lower(F.trim("tag")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    names = known.toDF("k").select(F.lower("k").alias("tag")).distinct().withColumn("hit", F.lit(True))
    return counts.join(names, "tag", "left").select("tag", F.col("hit").isNotNull().alias("matched"), "n")


def dictionary_recall(tags: DataFrame, known: DataFrame) -> DataFrame:
    """``(source, tags, matched, recall)`` of the tags of ``(source, tag)``."""
    counts = tags.select("source", F.lower("tag").alias("tag")).groupBy("source", "tag").agg(F.count("*").alias("n"))
    names = known.toDF("k").select(F.lower("k").alias("tag")).distinct().withColumn("hit", F.lit(True))
    matched = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))
    out = counts.join(names, "tag", "left").groupBy("source").agg(F.sum("n").alias("tags"), matched.alias("matched"))
    return out.withColumn("recall", F.round(F.col("matched") / F.col("tags"), 4))


def missing_logos(companies: DataFrame, sources: DataFrame, source: str, cutoff: str) -> DataFrame:
    """``(id, source_company_id)``: companies without logo, never checked or checked before the cutoff (ISO text); the smallest id of the source."""
    checked = F.get_json_object("raw_fields", "$.logo_checked_at")
    due = companies.where(F.col("logo_url").isNull() & (checked.isNull() | (checked < cutoff))).select("id")
    have = sources.where((F.col("source") == source) & F.col("source_company_id").isNotNull()).groupBy(F.col("company_id").alias("id")).agg(F.min("source_company_id").alias("source_company_id"))
    return due.join(have, "id")


def stamped(raw_fields: Column, name: str, at: Column) -> Column:
    """A JSON object with one more member; null counts as an empty object."""
    old = F.from_json(F.coalesce(raw_fields, F.lit("{}")), "map<string,string>")
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != name), F.create_map(F.lit(name), at)))


def profiles(users: DataFrame, majors: DataFrame, fields: DataFrame, owned: DataFrame, skills: DataFrame) -> DataFrame:
    """``(id, name, career_level, fields, skills)`` of each user: field codes in their order, skill names by name."""
    f = majors.join(fields.select(F.col("id").alias("field_id"), "code", "sort_order"), "field_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "code"))).alias("f"))
    s = owned.join(skills.select(F.col("id").alias("skill_id"), "name"), "skill_id").groupBy("user_id").agg(F.array_sort(F.collect_list("name")).alias("s"))
    level = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[F.col("history")]
    out = users.withColumnRenamed("id", "user_id").join(f, "user_id", "left").join(s, "user_id", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("user_id").alias("id"), "name", level.alias("career_level"), F.coalesce(F.col("f.code"), none).alias("fields"), F.coalesce("s", none).alias("skills"))


def run_state(log: DataFrame) -> DataFrame:
    """A log of ``(run_id, seq, status, fetched, logged_at)`` folded to the last state of each run; counters keep their last known value."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    ended = F.max(F.when(F.col("status").isin("success", "failed"), F.col("logged_at"))).alias("finished_at")
    return log.groupBy("run_id").agg(last("status"), last("fetched"), F.min("logged_at").alias("started_at"), ended)


def upsert_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Roadmap items by (roadmap_id, week_no, day_no, seq): title (200 characters) and description are replaced, is_done stays."""
    from laborlens.operators.merge import upsert

    fresh = new.withColumns({"title": F.left("title", F.lit(200)), "is_done": F.lit(False)})
    return upsert(old, fresh, ["roadmap_id", "week_no", "day_no", "seq"], ["title", "description"])


def roadmap_status(roadmaps: DataFrame, steps: DataFrame) -> DataFrame:
    """``(id, status, generated_weeks)`` after a log of ``(id, seq, step, weeks)``; steps: generating, weeks, completed, failed.

    Generating starts the count of weeks again; a step of weeks adds to it.
    """
    start = steps.where("step = 'generating'").groupBy("id").agg(F.max("seq").alias("start"))
    s = steps.join(start, "id", "left")
    again = F.col("start").isNotNull()
    folded = s.groupBy("id").agg(
        F.max_by("step", F.when(F.col("step") != "weeks", F.col("seq"))).alias("step"),
        F.sum(F.when((F.col("step") == "weeks") & (~again | (F.col("seq") > F.col("start"))), F.col("weeks")).otherwise(0)).alias("more"),
        F.bool_or(again).alias("again"),
    )
    base = F.when(F.coalesce("again", F.lit(False)), 0).otherwise(F.col("generated_weeks"))
    return roadmaps.join(folded, "id", "left").select("id", F.coalesce("step", "status").alias("status"), (base + F.coalesce("more", F.lit(0))).alias("generated_weeks"))
