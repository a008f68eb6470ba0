"""Queries of merges, conditional updates, hashes, bodies of pages and progress, on rows made from numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import charts, html, skills, text
from laborlens.functions.spread import spread
from laborlens.operators import chunks, lookups, merge
from laborlens.sources.market import Market, expanded

c = F.col
_FILL = "우리는 매일 서비스를 만들고 고칩니다. "


def company_sources(m: Market) -> DataFrame:
    row = "SELECT 'site_a' AS source, o_orderkey AS source_company_id, o_custkey AS company_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS url FROM orders"
    new = m.sql(f"{row} WHERE o_orderkey % 3 < 2").withColumn("company_id", c("company_id") + 1000).withColumn("url", F.when(c("source_company_id") % 2 == 0, F.lit("new")))
    return merge.upsert_company_sources(m.sql(f"{row} WHERE o_orderkey % 3 > 0"), new)


def fields_and_skills(m: Market) -> DataFrame:
    fields = merge.upsert_fields(m.field, m.field.where("id > 2").select((c("id") + 100).alias("id"), "code", F.upper("code").alias("name"), (c("sort_order") + 50).alias("sort_order")))
    old = m.skill.select("id", "name", "category", F.lit(True).alias("is_ambiguous"), "is_common")
    skills = merge.upsert_skills(old, old.where("id % 2 = 0").withColumns({"category": F.lit(None).cast("string"), "is_ambiguous": F.lit(False)}))
    return fields.select(c("code").alias("key"), c("id").cast("long").alias("id"), "name", c("sort_order").cast("string").alias("value")).union(skills.select("name", c("id").cast("long"), "name", F.concat(F.coalesce("category", F.lit("-")), c("is_ambiguous").cast("string"))))


def bodies_updated(m: Market) -> DataFrame:
    """New bodies; then a failed extraction marks those that are no images."""
    p = m.posting.select("id", "title", "body_is_image", "body_extract_failed", "field_id")
    body = p.where("id % 4 = 0").select("id", F.lit(None).cast("string").alias("title"), (c("id") % 3 == 0).alias("body_is_image"))
    failed = p.where("id % 6 = 0").select("id", F.lit(True).alias("body_extract_failed"))
    return merge.updated(merge.updated(p, body, ["id"]), failed, ["id"], ~c("body_is_image"))


def report_texts(m: Market) -> DataFrame:
    reports = m.sql("SELECT id, 'old' AS llm_report FROM job_posting")
    return lookups.set_report_text(reports, reports.where("id % 2 = 0").select("id", F.when(c("id") % 4 == 0, "new").alias("text")))


def sessions(m: Market) -> DataFrame:
    old = m.sql("SELECT event_id AS id, user_id AS session_id, ts AS created_at FROM events WHERE event_id % 2 = 0")
    new = m.sql("SELECT event_id AS id, user_id AS session_id, ts AS created_at FROM events WHERE event_id % 10 = 1")
    known = old.groupBy(c("session_id").alias("id")).agg(F.max("created_at").alias("last_message_at"))
    messages, moved = lookups.add_messages(old, known, new)
    counts = messages.groupBy(c("session_id").alias("id")).agg(F.count("*").alias("messages"))
    return moved.join(counts, "id").select("id", F.date_format("last_message_at", "yyyy-MM-dd HH:mm:ss").alias("last"), "messages")


def hashes(m: Market) -> DataFrame:
    p = m.posting
    body = text.description(F.lit(" work "), F.when(c("id") % 2 == 0, c("title")), F.lit(" "))
    lists = F.array(F.lit("b"), F.lit("a"))
    digest = text.content_hash(c("title"), c("source"), lists, F.lit(None).cast("array<string>"), F.array("source"), c("career_min"), c("career_max"), body, F.lit(None).cast("string"), F.lit("2001"))
    return p.select("id", body.alias("body"), digest.alias("hash"))


def vectors(m: Market) -> DataFrame:
    return lookups.valid_vectors(m.vectors.select(c("vec_id").alias("id"), "embedding"), 64, m.vectors.where("vec_id % 3 = 0").select(c("vec_id").alias("id"))).select("id", F.size("embedding").alias("dims"))


def weak(m: Market) -> DataFrame:
    v = F.when(c("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * F.lit(0.1).cast("float"))).when(c("vec_id") % 11 == 0, F.slice("embedding", 1, 10)).when(c("vec_id") % 13 > 0, c("embedding"))
    return lookups.weak_vectors(m.vectors.select(c("vec_id").alias("id"), v.alias("embedding")), 64)


def crawled(m: Market) -> DataFrame:
    pages = m.sql("SELECT user_id AS run_id, event_id % 20 AS page, count(*) AS fetched, sum(event_id % 3) AS inserted FROM events GROUP BY 1, 2")
    return lookups.progress(pages, "run_id", "page", ["fetched", "inserted"])


def closed(m: Market) -> DataFrame:
    postings = m.posting.select("id", "content_hash")
    plan = postings.select(c("id").alias("posting_id"), F.explode(F.array(F.lit("required"), F.lit("preferred"))).alias("section"), F.lit(0).alias("seq")).where("posting_id % 3 > 0")
    plan = plan.withColumn("action", F.when(c("section") == "required", "embed").otherwise("reuse"))
    return chunks.closing_hashes(postings, plan, plan.where("posting_id % 2 = 0"))


def bodies(m: Market) -> DataFrame:
    """Pages with a body of two headers, with one that only names a skill, with pictures, or with nothing; navigation and labels round them."""
    fill = F.lit(_FILL * 25)
    block = (
        F.when(c("id") % 4 == 0, F.concat(F.lit("<div id='main'><h2>주요업무</h2><p>"), c("title"), F.lit(" "), fill, F.lit("</p><h2>자격요건</h2></div>")))
        .when(c("id") % 4 == 1, F.concat(F.lit("<div id='main'><p>Kotlin "), fill, F.lit("</p></div>")))
        .when(c("id") % 4 == 2, F.concat(F.lit("<div id='main'><p>"), fill, F.lit("</p></div>")))
        .otherwise(F.lit("<div>empty</div>"))
    )
    head = F.concat(F.lit("<html><nav>자격요건 로그인</nav><dl><dt>급여 :</dt><dd>"), c("id").cast("string"), F.lit("만원</dd></dl><span class='tit'>근무지역</span><b>"), F.coalesce("location", F.lit("")), F.lit("</b>"))
    pages = spread(m.posting.select("id", "title", "location"), "id").select("id", F.concat(head, block, F.lit("<div class='related'>주요업무</div></html>")).alias("page"))
    pages = skills.with_links(pages.select("id", html.body_of("page").alias("b")).withColumn("text", c("b.text")), skills.sent(m.spark, [skills.Skill(1, ("kotlin",))]), "text", None)
    return pages.select("id", html.verdict(c("b.text"), c("b.images"), c("named")).alias("verdict"), html.picked(c("b.labels"), "salary").alias("salary"), html.picked(c("b.labels"), "location").alias("location"), F.substring_index("b.text", "\n", 1).alias("first_line"))


_ROW = "SELECT id, title, source, career_min, career_max, CASE WHEN id % 2 = 0 THEN concat('[주요업무]', chr(10), 'work', chr(10), chr(10), '[자격요건]', chr(10), title) ELSE concat('[주요업무]', chr(10), 'work') END AS body FROM job_posting"

TABLE = {
    "mrg3_company_source": (company_sources, "SELECT 'site_a' AS source, o_orderkey AS source_company_id, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey + 1000 ELSE o_custkey END AS company_id, CASE WHEN o_orderkey % 3 < 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'new' END WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS url FROM orders"),
    "mrg5_field_and_skill": (
        fields_and_skills,
        "SELECT code AS key, CAST(id AS BIGINT) AS id, CASE WHEN id > 2 THEN upper(code) ELSE name END AS name, CAST(CASE WHEN id > 2 THEN sort_order + 50 ELSE sort_order END AS VARCHAR) AS value FROM tech_field UNION ALL SELECT name, CAST(id AS BIGINT), name, CASE WHEN id % 2 = 0 THEN '-false' ELSE concat(coalesce(category, '-'), 'true') END FROM skill",
    ),
    "mrg8_conditional_updates": (
        bodies_updated,
        "SELECT id, CASE WHEN id % 4 > 0 THEN title END AS title, image AS body_is_image, CASE WHEN id % 6 = 0 AND NOT image THEN true ELSE body_extract_failed END AS body_extract_failed, field_id FROM (SELECT *, CASE WHEN id % 4 = 0 THEN id % 3 = 0 ELSE body_is_image END AS image FROM job_posting)",
    ),
    "mrg13_report_text": (report_texts, "SELECT id, CASE WHEN id % 4 = 0 THEN 'new' WHEN id % 2 = 1 THEN 'old' END AS llm_report FROM job_posting"),
    "mrg13_messages": (
        sessions,
        "SELECT user_id AS id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS messages FROM events WHERE event_id % 2 = 0 OR event_id % 10 = 1 GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 2 = 0) > 0",
    ),
    "tx24_tx25_description_and_hash": (
        hashes,
        f"SELECT id, body, sha256(concat_ws('␟', title, source, 'a,b', '', source, coalesce(CAST(career_min AS VARCHAR), 'None'), coalesce(CAST(career_max AS VARCHAR), 'None'), body, '', '2001')) AS hash FROM ({_ROW})",
    ),
    "tx34_valid_vectors": (vectors, "SELECT vec_id AS id, CAST(len(embedding) AS INT) AS dims FROM embeddings WHERE vec_id % 3 = 0"),
    "vec2_weak_vectors": (weak, "SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'norm' WHEN vec_id % 11 = 0 THEN 'size' ELSE 'missing' END AS fault FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0"),
    "st14_progress": (
        crawled,
        "WITH p AS (SELECT user_id AS run_id, event_id % 20 AS page, count(*) AS f, sum(event_id % 3) AS i FROM events GROUP BY 1, 2) SELECT run_id, page, CAST(sum(f) OVER w AS BIGINT) AS fetched, CAST(sum(i) OVER w AS BIGINT) AS inserted FROM p WINDOW w AS (PARTITION BY run_id ORDER BY page)",
    ),
    "st6_closing_hashes": (closed, "SELECT id, content_hash AS embed_hash FROM job_posting WHERE content_hash IS NOT NULL AND (id % 3 = 0 OR id % 2 = 0)"),
    "tx16_tx18_tx20_bodies": (
        bodies,
        f"SELECT id, CASE id % 4 WHEN 2 THEN 'failed' WHEN 3 THEN 'failed' ELSE 'valid' END AS verdict, concat(CAST(id AS VARCHAR), '만원') AS salary, location, CASE id % 4 WHEN 0 THEN '주요업무' WHEN 1 THEN trim(concat('Kotlin ', repeat('{_FILL}', 25))) WHEN 2 THEN trim(repeat('{_FILL}', 25)) END AS first_line FROM job_posting",
    ),
    "snk3_grouped_bar_chart": (
        lambda m: charts.grouped_bar_chart(m.sql("SELECT source, requirement, count(*) AS n FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id GROUP BY 1, 2"), "skills", "source", "requirement", "n"),
        """SELECT concat('{"type":"grouped_bar","title":"skills","data":[', string_agg(concat('{"group":"', source, '","label":"', requirement, '","value":', CAST(n AS VARCHAR), '}'), ',' ORDER BY source, requirement), ']}') AS payload FROM (SELECT source, requirement, count(*) AS n FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id GROUP BY 1, 2)""",
    ),
    "snk3_table_chart": (
        lambda m: charts.table_chart(m.field.select("id", "code"), "fields"),
        """SELECT concat('{"type":"table","title":"fields","data":[', string_agg(concat('{"id":', CAST(id AS VARCHAR), ',"code":"', code, '"}'), ',' ORDER BY id), ']}') AS payload FROM tech_field""",
    ),
}

QUERIES = {k: (lambda f: lambda spark, sf_dir: f(Market(spark, sf_dir)))(f) for k, (f, _) in TABLE.items()}
SQL = {k: expanded(sql) for k, (_, sql) in TABLE.items()}
