"""Smaller operations of reports, chat, crawling and embedding: look-ups, limits, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.functions import embedding
from laborlens.operators.filters import DEMAND, moment, within
from laborlens.sources.market import AS_OF, Market

ACTIONS = ("inserted", "updated", "skipped", "unchanged", "failed")


# Reports


def weeks_with_missing(reports: DataFrame, since: str) -> DataFrame:
    """``(week_start_date)``: weeks from ``since`` on with a report that has no text."""
    return reports.where((F.col("week_start_date") >= F.lit(since).cast("date")) & F.col("llm_report").isNull()).select("week_start_date").distinct()


def reports_of_week(reports: DataFrame, week: str) -> DataFrame:
    return reports.where(F.col("week_start_date") == F.lit(week).cast("date")).orderBy("major_id")


def report_facts(m: Market, before: tuple[str, str], week: tuple[str, str]) -> DataFrame:
    """Skills of two adjacent windows, ranked by the later: counts, change, rate (null for new ones), trend, and which gained and lost most.

    One row a skill, so the ranks are numbered over the dictionary, not over postings.
    """
    dated = m.posting.where(within(before[0], week[1])).select(F.col("id").alias("posting_id"), "posted_at")
    asked = m.posting_skill.where(F.col("requirement").isin(*DEMAND)).select("posting_id", "skill_id")
    late = F.col("posted_at") >= moment(week[0])
    of = lambda x, name: F.countDistinct(F.when(x, F.col("posting_id"))).alias(name)
    counts = asked.join(dated, "posting_id").groupBy("skill_id").agg(of(late, "cur"), of(~late, "prev"))
    rows = counts.join(m.skill.select(F.col("id").alias("skill_id"), "name"), "skill_id").withColumn("change", F.col("cur") - F.col("prev"))
    ends = rows.agg(F.min_by("name", F.struct(-F.col("change"), "name")).alias("top"), F.min_by("name", F.struct("change", "name")).alias("low"))
    trend = F.when(F.col("prev") == 0, "new").when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("same")
    rate = F.when(F.col("prev") > 0, F.round(F.col("change") / F.col("prev"), 4))
    rank = F.row_number().over(Window.orderBy(F.desc("cur"), "name"))
    return rows.join(F.broadcast(ends)).select(rank.alias("rank"), "name", "cur", "prev", "change", rate.alias("rate"), trend.alias("trend"), (F.col("name") == F.col("top")).alias("most_gained"), (F.col("name") == F.col("low")).alias("most_lost"))


def set_report_text(reports: DataFrame, texts: DataFrame) -> DataFrame:
    """``reports`` with the text of ``texts (id, text)`` where there is one, null texts included."""
    new = texts.select("id", F.struct("text").alias("new"))
    return reports.join(new, "id", "left").withColumn("llm_report", F.when(F.col("new").isNotNull(), F.col("new.text")).otherwise(F.col("llm_report"))).select(reports.columns)


# Chat


def recent_messages(messages: DataFrame, session: str, order: str, n: int = 12, off_topic: str | None = None) -> DataFrame:
    """The last ``n`` messages of each session by users and the assistant.

    An answer that is the ``off_topic`` text goes, and the question just before it goes
    too. Messages of other roles count among the n, but are not returned.
    """
    w = Window.partitionBy(session)
    last = messages.withColumn("__r", F.row_number().over(w.orderBy(F.desc(order)))).where(f"__r <= {n}").where(F.col("role").isin("user", "assistant"))
    off = F.coalesce((F.col("role") == "assistant") & (F.col("content") == F.lit(off_topic)), F.lit(False))
    marked = last.withColumn("__off", off).withColumn("__next", F.lead("__off").over(w.orderBy(order)))
    return marked.where(~F.col("__off") & ~((F.col("role") == "user") & F.coalesce("__next", F.lit(False)))).select(messages.columns)


def add_messages(messages: DataFrame, sessions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones, and sessions whose last_message_at moves on to that of their newest."""
    latest = new.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("__at"))
    moved = sessions.join(latest, "id", "left").withColumn("last_message_at", F.greatest("last_message_at", "__at"))
    return messages.unionByName(new, allowMissingColumns=True), moved.select(sessions.columns)


def owned(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Rows that the user who asks for them owns: both the key and the user agree."""
    return rows.join(asked.select(key, "user_id"), [key, "user_id"], "left_semi")


# Look-ups


def field_ids(fields: DataFrame) -> DataFrame:
    return fields.select("code", "id")


def content_hashes(postings: DataFrame, source: str, ids: DataFrame) -> DataFrame:
    return postings.where(F.col("source") == source).join(ids.select("source_job_id").distinct(), "source_job_id", "left_semi").select("source_job_id", "content_hash")


def source_ids(postings: DataFrame, source: str) -> DataFrame:
    return postings.where(F.col("source") == source).select("source_job_id").distinct()


def chunk_state(chunks: DataFrame) -> DataFrame:
    """The hash of each chunk, empty where its vector is missing, so that it counts as changed."""
    return chunks.select("posting_id", "section", "seq", F.when(F.col("embedding").isNull(), "").otherwise(F.col("chunk_hash")).alias("state"))


def dictionary_rows(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(id, name, aliases, exact)``, both lists sorted: the name is an alias too, unless an exact alias spells it in another case."""
    listed = aliases.groupBy(F.col("skill_id").alias("id")).agg(
        F.collect_list(F.when(~F.col("case_sensitive"), F.col("alias"))).alias("folded"), F.array_sort(F.collect_list(F.when(F.col("case_sensitive"), F.col("alias")))).alias("exact")
    )
    none = F.array().cast("array<string>")
    rows = skills.join(listed, "id", "left").select("id", "name", F.coalesce("folded", none).alias("folded"), F.coalesce("exact", none).alias("exact"))
    spelled = F.exists("exact", lambda a: F.lower(a) == F.lower("name"))
    return rows.select("id", "name", F.array_sort(F.when(spelled, F.col("folded")).otherwise(F.concat("folded", F.array("name")))).alias("aliases"), "exact")


def roadmap_facts(m: Market, field_id: int, skill_ids: Sequence[int], as_of: str = AS_OF, days: int = 90) -> DataFrame:
    """One row: the field's name or ``all``, the skills' names, and the postings of the last days."""
    total = m.posting.where(F.col("posted_at") >= moment(as_of) - F.expr(f"INTERVAL {days} DAYS")).agg(F.count("*").alias("total"))
    field = m.field.where(F.col("id") == field_id).agg(F.coalesce(F.max("name"), F.lit("all")).alias("field"))
    names = m.skill.where(F.col("id").isin(*skill_ids)).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("skills"))
    return field.join(F.broadcast(names)).join(F.broadcast(total))


# Embedding


def embeddable() -> Column:
    return F.col("description").isNotNull() & F.col("body_is_image").eqNullSafe(False) & F.col("body_extract_failed").eqNullSafe(False)


def needs_embedding() -> Column:
    return F.col("embed_hash").isNull() | ~F.col("embed_hash").eqNullSafe(F.col("content_hash"))


def postings_to_embed(postings: DataFrame) -> DataFrame:
    """``(id, description, content_hash)`` of postings whose vectors are missing or old; without text or hash there is nothing to embed."""
    return postings.where(embeddable() & needs_embedding() & (F.col("description") != "") & (F.col("content_hash") != "")).select("id", "description", "content_hash")


def company_text() -> Column:
    """The parts of a company's profile that are not blank, a line each; null without any."""
    parts = (F.nullif(F.trim(c), F.lit("")) for c in ("description", "business_content", "industry"))
    return F.nullif(F.concat_ws("\n", *parts), F.lit(""))


def companies_to_embed(companies: DataFrame) -> DataFrame:
    """``(id, text, hash)`` of companies with a text whose hash is not the stored one."""
    rows = companies.withColumn("text", company_text()).where("text is not null").withColumn("hash", F.sha2("text", 256))
    return rows.where(~F.col("hash").eqNullSafe(F.col("embed_hash"))).select("id", "text", "hash")


def valid_vectors(vectors: DataFrame, dims: int, expected: DataFrame, key: str = "id") -> DataFrame:
    """``vectors`` as they are; the job fails if one has another size, or if ``expected`` has a key without one."""
    checked = F.assert_true(F.size("embedding") == dims, F.concat(F.lit("a vector has not the right size: "), F.col(key).cast("string")))
    rows = expected.select(key).join(vectors, key, "left").where(checked.isNull())
    missing = F.assert_true(F.col("embedding").isNotNull(), F.concat(F.lit("no vector for "), F.col(key).cast("string")))
    return rows.where(missing.isNull()).select(vectors.columns)


def weak_vectors(vectors: DataFrame, dims: int, least_norm: float = 0.5, key: str = "id") -> DataFrame:
    """``(key, fault)`` of stored vectors that no search should meet: ``missing``, of another ``size``, or with too small a ``norm``."""
    fault = F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != dims, "size").when(~F.coalesce(embedding.norm(F.col("embedding")) >= least_norm, F.lit(False)), "norm")
    return vectors.select(key, fault.alias("fault")).where("fault is not null")


# Crawling


def reparse_targets(postings: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Postings to parse again, of one source or all, by id; the limit is the caller's."""
    rows = postings if source is None else postings.where(F.col("source") == source)
    rows = rows.orderBy("id")
    return rows if limit is None else rows.limit(limit)


def older_than(rows: DataFrame, at: str, as_of: str, age: str) -> DataFrame:
    return rows.where(F.col(at) < moment(as_of) - F.expr(f"INTERVAL {age}"))


def job_fan_out(sites: DataFrame, keywords: DataFrame, on: list[str], site: str, keyword: str) -> DataFrame:
    """``(site, keyword, job)``: one job for each site and each keyword that its group has."""
    return sites.join(keywords, on).select(F.col(site).alias("site"), F.col(keyword).alias("keyword"), F.concat(site, F.lit(":"), keyword).alias("job"))


def run_counters(steps: DataFrame) -> DataFrame:
    """What each run did: rows fetched, and how many of each action."""
    return steps.groupBy("run_id").agg(F.count("*").alias("fetched"), *(F.count_if(F.col("action") == a).alias(a) for a in ACTIONS))


def backfill_stop(rows: DataFrame, page: str, at: str, cutoff: str) -> DataFrame:
    """``(page, stop)``: a page stops the back-fill if its newest date is before the cutoff; pages without dates never do."""
    return rows.groupBy(page).agg(F.coalesce(F.max(at) < moment(cutoff), F.lit(False)).alias("stop"))


def page_outcome(pages: DataFrame, run: str, page: str, jobs: str) -> DataFrame:
    """``(run, page, outcome)``: an empty first page means that the run failed, a later empty one that the list has ended."""
    first = F.min(page).over(Window.partitionBy(run)) == F.col(page)
    return pages.select(run, page, F.when(F.col(jobs) > 0, "read").when(first, "failed").otherwise("end").alias("outcome"))


def progress(pages: DataFrame, run: str, page: str, counters: Sequence[str]) -> DataFrame:
    """The counters of a run up to each page, as it would be stored after the page."""
    up_to = Window.partitionBy(run).orderBy(page).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.select(run, page, *(F.sum(c).over(up_to).alias(c) for c in counters))


def retry_delay(tries: Column, unit: int, most: int) -> Column:
    """Units to wait after so many tries: doubled with each, null when no further try is due."""
    return F.when(tries < most, (F.lit(unit) * F.pow(F.lit(2), tries - 1)).cast("long"))


def sliding_minute(rows: DataFrame, by: str, at: str, tokens: str) -> DataFrame:
    """Requests and tokens of the 60 seconds up to each row; a row exactly 60 seconds old has left."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    minute = Window.partitionBy(by).orderBy(micros).rangeBetween(-59_999_999, 0)
    return rows.select("*", F.count("*").over(minute).alias("requests"), F.sum(tokens).over(minute).alias("tokens_in_minute"))


# Ranks


def percent_rank(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``percent_rank``: smaller values over n - 1, 0 for a single row; equal values share it.

    Ranks are running counts over the distinct values of each group, so that a window
    holds one row a value; rows with a null value come first, as the least.
    """
    by = list(by)
    counts = rows.groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    below = F.sum("__n").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("__n").over(Window.partitionBy(*by))
    ranks = counts.select(*(F.col(b).alias(f"__{b}") for b in by), "__v", F.when(total > 1, F.coalesce(below, F.lit(0)) / (total - 1)).otherwise(0.0).alias("percent_rank"))
    on = F.col(value).eqNullSafe(F.col("__v"))
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return rows.join(ranks, on).select(*rows.columns, "percent_rank")


# Calendar windows in Seoul (UTC+9 all year); moments are in UTC


def _local(at: Column) -> Column:
    return at + F.expr("INTERVAL 9 HOURS")


def _back(local: Column) -> Column:
    return local - F.expr("INTERVAL 9 HOURS")


def week_before(at: Column, weeks: int = 1) -> tuple[Column, Column]:
    """The full week, Monday to Monday, so many weeks before that of ``at``."""
    monday = F.date_trunc("week", _local(at))
    return _back(monday - F.expr(f"INTERVAL {7 * weeks} DAYS")), _back(monday - F.expr(f"INTERVAL {7 * (weeks - 1)} DAYS"))


def month_before(at: Column, months: int = 1) -> tuple[Column, Column]:
    """The full month so many months before that of ``at``."""
    first = F.date_trunc("month", _local(at))
    return _back(first - F.expr(f"INTERVAL {months} MONTHS")), _back(first - F.expr(f"INTERVAL {months - 1} MONTHS"))


def span_label(start: Column, end: Column) -> Column:
    """First and last day of a window as ``mm/dd~mm/dd``."""
    return F.concat(F.date_format(_local(start), "MM/dd"), F.lit("~"), F.date_format(_local(end) - F.expr("INTERVAL 1 DAY"), "MM/dd"))


def calendar_columns(at: Column) -> dict[str, Column]:
    (w1, w2), (m1, m2) = week_before(at), month_before(at)
    return {"week_start": w1, "week_end": w2, "month_start": m1, "month_end": m2}
