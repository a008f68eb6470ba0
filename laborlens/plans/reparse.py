"""Queries of the dictionary and of parsing stored postings again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import skills
from laborlens.operators import chunks, dictionary, reparse
from laborlens.plans.text import _CATEGORIES, _FIELDS, _case, bodies
from laborlens.sources.folders import fresh_folder
from laborlens.sources.market import Market, expanded

c = F.col
SEEDS = 165


def names_in_documents(m: Market) -> DataFrame:
    """Mentions of a dictionary of the corpus's most frequent words, loaded from a Parquet dimension, over all documents."""
    docs = m.view("documents")
    path = fresh_folder(m.spark, "dictionary")
    dictionary.loaded(dictionary.frequent_names(docs, "text", SEEDS)).write.parquet(path)
    kept = m.spark.read.parquet(path)
    hits = docs.select("doc_id", F.explode(skills.scanned(dictionary.matcher(kept), c("text"))).alias("h")).groupBy(c("h.skill_id").alias("id")).agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents"))
    return kept.join(hits, "id", "left").select(c("id").cast("long").alias("id"), "name", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("documents", F.lit(0)).alias("documents"))


# Every seventh body is a text without headers and skills; every third chunk state is old; fields are voted from two categories.
_BODY = "CASE WHEN id % 7 = 0 THEN 'nothing to see' ELSE description END"


def _stored(m: Market) -> DataFrame:
    names = F.array(*(F.lit(x) for x in _CATEGORIES))
    one, two = (F.element_at(names, (c("id") % n + 1).cast("int")) for n in (6, 5))
    p = m.posting.drop("title").join(bodies(m), "id", "left")
    return p.select("id", "source", F.lit("Engineer").alias("title"), F.expr(_BODY).alias("description"), "tags", F.array(one, two).alias("categories"), "field_id", "body_is_image", "body_extract_failed", F.concat(F.lit("e"), c("id").cast("string")).alias("embed_hash"))


def _links(m: Market) -> DataFrame:
    return m.posting_skill.select(c("posting_id"), c("skill_id"), F.lit("old").alias("requirement"), c("mentions"))


def _job(m: Market) -> tuple[DataFrame, reparse.Reparsed]:
    posts = _stored(m)
    known = [skills.Skill(r["id"], aliases=(r["name"],), ambiguous=r["id"] % 2 == 0) for r in m.skill.orderBy("id").limit(dictionary.MOST_SKILLS).collect()]
    fresh = chunks.chunks(posts).select("posting_id", "section", "seq", "chunk_hash")
    state = fresh.withColumn("chunk_hash", F.when(c("posting_id") % 3 == 0, "old").otherwise(c("chunk_hash")))
    fields = m.spark.createDataFrame([(i, f) for i, f in enumerate(_FIELDS) if f], "id int, code string")
    return posts, reparse.reparse(posts, skills.sent(m.spark, known), fields, state, fresh_folder(m.spark, "reparse"), "site_a")


def links_after(m: Market) -> DataFrame:
    posts, done = _job(m)
    return reparse.applied(posts, _links(m), done)[1].select("posting_id", "skill_id", "requirement", "mentions")


def postings_after(m: Market) -> DataFrame:
    posts, done = _job(m)
    return reparse.applied(posts, _links(m), done)[0].select("id", "field_id", "body_extract_failed", "embed_hash")


def stale(m: Market) -> DataFrame:
    return _job(m)[1].stale


def counters(m: Market) -> DataFrame:
    done = _job(m)[1].counters
    return m.spark.createDataFrame([(k, v) for k, v in done.items()], "counter string, n long")


_NUMBER = tuple(None if f is None else i for i, f in enumerate(_FIELDS))


def _number(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else str(v)) for i, v in enumerate(values)) + " END"


# A tie between two fields has no winner, for the title votes for none; no vote at all leaves the field empty.
_FIELD = f"(SELECT id, CAST(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a = b THEN a END AS INT) AS new_field FROM (SELECT id, {_number('id % 6', _NUMBER)} AS a, {_number('id % 5', _NUMBER[:5])} AS b FROM job_posting))"
_ALL = f"SELECT p.*, f.new_field, p.source = 'site_a' AS mine, p.id % 7 = 0 OR h.id IS NOT NULL AS has_text, p.id % 7 = 0 OR h.id IS NULL AS bad, (p.id % 7 = 0 OR h.id IS NULL) AND NOT p.body_is_image AS no_body FROM job_posting p JOIN {_FIELD} f ON f.id = p.id LEFT JOIN (SELECT DISTINCT posting_id AS id FROM posting_skill) h ON h.id = p.id"

TABLE = {
    "src13_dictionary": (
        names_in_documents,
        f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS name FROM documents), n AS (SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM w WHERE length(name) >= 4 GROUP BY 1)
 SELECT row_number() OVER (ORDER BY mentions DESC, name) AS id, name, mentions, documents FROM n ORDER BY mentions DESC, name LIMIT {SEEDS}""",
    ),
    "mrg16_reparsed_skills": (
        links_after,
        "SELECT s.posting_id, s.skill_id, CASE WHEN p.source = 'site_a' THEN s.requirement ELSE 'old' END AS requirement, s.mentions FROM posting_skill s JOIN job_posting p ON p.id = s.posting_id WHERE p.source <> 'site_a' OR p.id % 7 > 0 OR s.requirement = 'tag'",
    ),
    "mrg16_reparsed_postings": (
        postings_after,
        f"SELECT id, CASE WHEN mine THEN new_field ELSE field_id END AS field_id, body_extract_failed OR (mine AND no_body) AS body_extract_failed, CASE WHEN mine AND id % 3 = 0 AND has_text AND NOT body_is_image AND NOT (body_extract_failed OR no_body) THEN NULL ELSE concat('e', id) END AS embed_hash FROM ({_ALL})",
    ),
    "mrg16_stale_chunks": (stale, f"SELECT id FROM ({_ALL}) WHERE mine AND id % 3 = 0 AND has_text"),
    "mrg16_counters": (
        counters,
        f"""WITH a AS ({_ALL}), s AS (SELECT a.id, count(x.skill_id) AS n FROM a LEFT JOIN posting_skill x ON x.posting_id = a.id AND (NOT a.bad OR x.requirement = 'tag') WHERE mine GROUP BY 1)
 SELECT unnest(['postings', 'skills_linked', 'without_skills', 'field_updated', 'body_failed']) AS counter, unnest([(SELECT count(*) FROM s), (SELECT CAST(sum(n) AS BIGINT) FROM s), (SELECT count(*) FROM s WHERE n = 0), (SELECT count(*) FROM a WHERE mine AND new_field IS DISTINCT FROM field_id), (SELECT count(*) FROM a WHERE mine AND no_body)]) AS n""",
    ),
}

QUERIES = {k: (lambda f: lambda spark, sf_dir: f(Market(spark, sf_dir)))(f) for k, (f, _) in TABLE.items()}
SQL = {k: expanded(sql) for k, (_, sql) in TABLE.items()}
