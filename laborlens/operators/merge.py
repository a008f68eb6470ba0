"""Merges as joins of the stored table with the new rows; the result is written beside the old table, never over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a posting that a new version overwrites, nulls included, and those that keep the old value instead of a null.
POSTING_OVERWRITE = ("title", "company_name_raw", "tags_raw", "career_min", "career_max", "salary_type", "body_is_image", "body_extract_failed", "content_hash", "collected_at", "raw_fields")
POSTING_FILL = ("description", "welfare", "salary_raw", "salary_min", "salary_max", "location", "education", "employment_type", "salary_period", "posted_at", "expires_at", "company_id", "field_id")
POSTING_KEY = ("source", "source_job_id")
COMPANY_FILL = ("description", "homepage", "logo_url", "founded", "industry", "employee_count", "revenue")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = (), fill: Sequence[str] = (), rules: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """``old`` with ``new`` merged in by ``keys``, which are unique in ``new``.

    ``overwrite`` columns take the new value, ``fill`` columns the new value unless
    it is null, ``rules`` columns what the rule makes of (new, old); other columns
    keep the old value. Columns that ``new`` lacks are null in inserted rows.
    """
    a = old.withColumn("__old", F.lit(True)).alias("a")
    b = new.withColumn("__new", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    has, got = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(c: str) -> Column:
        was = F.col(f"a.{c}")
        if c not in new.columns:
            return was
        now = F.col(f"b.{c}")
        if c in keys or c in fill:
            return F.coalesce(now, was)
        if c in overwrite:
            return F.when(got, now).otherwise(was)
        if rules and c in rules:
            return F.when(has & got, rules[c](now, was)).when(got, now).otherwise(was)
        return F.when(has, was).otherwise(now)

    return a.join(b, on, "full").select(*(value(c).alias(c) for c in old.columns))


def upsert_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, POSTING_KEY, POSTING_OVERWRITE, POSTING_FILL)


def upsert_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """The size keeps its old value where the new one is unknown."""
    size = lambda now, was: F.coalesce(F.nullif(now, F.lit("unknown")), was)
    return upsert(old, new, ["name_key"], ["name"], COMPANY_FILL, {"size_type": size})


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti").select(old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str, keys: Sequence[str]) -> DataFrame:
    """The children of every parent in ``new`` are replaced by those in ``new``, each key once."""
    kept = old.join(new.select(parent).distinct(), parent, "left_anti")
    return kept.select(old.columns).unionByName(new.dropDuplicates(list(keys)).select(old.columns))


def reap_stale(runs: DataFrame, cutoff: Column, as_of: Column) -> DataFrame:
    """Runs that still run and started before the cutoff have failed."""
    stale = (F.col("status") == "running") & (F.col("started_at") < cutoff)
    return runs.withColumns({"finished_at": F.when(stale, as_of).otherwise(F.col("finished_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def change_class(new: DataFrame, hashes: DataFrame, keys: Sequence[str], forced: bool = False) -> DataFrame:
    """``new`` with ``action``: unchanged, reextracted (forced), inserted or updated, by the stored content hash."""
    was = hashes.select(*keys, F.col("content_hash").alias("__was"))
    same = F.col("content_hash").eqNullSafe(F.col("__was"))
    action = F.when(F.col("__was").isNull(), "inserted").when(same, "reextracted" if forced else "unchanged").otherwise("updated")
    return new.join(was, list(keys), "left").withColumn("action", action).drop("__was")


def not_in(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is none of the others, by the rules of SQL: a null among the others leaves none, and a null key stays only if there are no others."""
    has_null = others.agg(F.count("*").alias("__n"), F.count_if(F.col(other_key).isNull()).alias("__nulls"))
    kept = rows.join(others.select(F.col(other_key).alias(key)).distinct(), key, "left_anti").select(rows.columns)
    return kept.join(F.broadcast(has_null)).where("__nulls = 0").where(F.col(key).isNotNull() | (F.col("__n") == 0)).select(rows.columns)


def stale_chunks(stored: DataFrame, keep: DataFrame, keys: Sequence[str] = ("posting_id", "section", "seq")) -> DataFrame:
    """Chunks that are stored and not among those to keep, by all their keys."""
    return stored.join(keep.select(*keys), list(keys), "left_anti").select(stored.columns)


def upsert_company_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["source", "source_company_id"], ["company_id", "url"])


def upsert_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["code"], ["name", "sort_order"])


def upsert_skills(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["name"], ["category", "is_ambiguous", "is_common"])


def updated(rows: DataFrame, changes: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """``rows`` with the columns of ``changes`` put in, nulls included, where the keys agree and ``where`` holds; nothing is inserted.

    ``changes`` has each key once. Serves touched postings, new bodies and flags, fields, hashes and vectors.
    """
    names = [x for x in changes.columns if x not in keys]
    new = changes.select(*keys, F.struct(*names).alias("__new"))
    hit = F.col("__new").isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    out = rows.join(new, list(keys), "left")
    return out.select(*(F.when(hit, F.col(f"__new.{x}")).otherwise(F.col(x)).alias(x) if x in names else F.col(x) for x in rows.columns))
