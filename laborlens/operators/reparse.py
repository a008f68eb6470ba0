"""Parse stored postings again with the dictionary and rules of today: one scan, five outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from laborlens.functions import html, text
from laborlens.functions.skills import with_links
from laborlens.operators import chunks, lookups, merge
from laborlens.sources.folders import kept


@dataclass(frozen=True)
class Reparsed:
    """Changes by output; each is empty if nothing has changed.

    ``skills`` has the links of every posting that was read, ``fields`` (id, field_id)
    where the field differs, ``failed`` (id) of postings whose body is none and no
    image, ``stale`` (id) of postings whose chunks differ from the stored ones, and
    ``reembed`` (id) of the stale ones whose hash is to be cleared. ``counters`` are those of the scan.
    """

    skills: DataFrame
    fields: DataFrame
    failed: DataFrame
    stale: DataFrame
    reembed: DataFrame
    parsed: DataFrame
    counters: dict[str, int]


def reparse(postings: DataFrame, matcher: Broadcast, fields: DataFrame, stored: DataFrame, path: str, source: str | None = None) -> Reparsed:
    """Outputs for ``postings (id, source, title, description, tags, categories, field_id, body_is_image, body_extract_failed, embed_hash)``.

    ``fields`` has (code, id), ``stored`` (posting_id, section, seq, chunk_hash). The scan
    is written to ``path`` once and all outputs read it, each its own columns. Null
    descriptions have no skills, no chunks and no body.
    """
    if source is not None:
        postings = postings.where(F.col("source") == source)
    code = text.tech_field(F.col("categories"), F.coalesce("title", F.lit("")))
    rows = with_links(postings.select("id", "description", "field_id", "body_is_image", "body_extract_failed", "embed_hash", "tags", code.alias("code")), matcher).drop("tags")
    rows = rows.join(F.broadcast(fields.select("code", F.col("id").alias("new_field_id"))), "code", "left").drop("code")
    rows = rows.withColumn("valid", html.valid_body(F.col("description"), F.col("named"))).drop("named")
    moved, no_body = ~F.col("field_id").eqNullSafe(F.col("new_field_id")), ~F.col("valid") & F.col("body_is_image").eqNullSafe(False)
    seen = Observation("reparse")
    parsed = kept(rows.observe(seen, F.count("*").alias("postings"), F.coalesce(F.sum(F.size("links")), F.lit(0)).alias("skills_linked"), F.count_if(F.size("links") == 0).alias("without_skills"), F.count_if(moved).alias("field_updated"), F.count_if(no_body).alias("body_failed")), path)

    fresh = chunks.chunks(parsed).select("posting_id", "section", "seq", F.col("chunk_hash").alias("now"))
    was = stored.join(parsed.select(F.col("id").alias("posting_id")), "posting_id", "left_semi").select("posting_id", "section", "seq", F.col("chunk_hash").alias("was"))
    differ = fresh.join(was, ["posting_id", "section", "seq"], "full").where(~F.col("now").eqNullSafe(F.col("was")))
    stale = differ.select(F.col("posting_id").alias("id")).distinct()
    after = parsed.withColumn("body_extract_failed", F.when(no_body, True).otherwise(F.col("body_extract_failed")))
    reembed = after.where(lookups.embeddable() & F.col("embed_hash").isNotNull()).join(stale, "id", "left_semi").select("id")
    return Reparsed(
        skills=parsed.select(F.col("id").alias("posting_id"), F.inline("links")),
        fields=parsed.where(moved).select("id", F.col("new_field_id").alias("field_id")),
        failed=parsed.where(no_body & ~F.col("body_extract_failed").eqNullSafe(True)).select("id"),
        stale=stale,
        reembed=reembed,
        parsed=parsed,
        counters=dict(seen.get),
    )


def applied(postings: DataFrame, links: DataFrame, done: Reparsed) -> tuple[DataFrame, DataFrame]:
    """The postings and the table of links with all changes in; postings that were not read keep theirs."""
    changed = merge.updated(postings, done.fields, ["id"])
    changed = merge.updated(changed, done.failed.withColumn("body_extract_failed", F.lit(True)), ["id"])
    changed = merge.updated(changed, done.reembed.withColumn("embed_hash", F.lit(None).cast("string")), ["id"])
    others = links.join(done.parsed.select(F.col("id").alias("posting_id")), "posting_id", "left_anti").select(links.columns)
    return changed, others.unionByName(done.skills)
