"""Relational constructs as DataFrame plans, each beside the SQL statement that has to give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborlens.operators import backlog, filters, lookups, merge, report
from laborlens.operators.filters import moment
from laborlens.sources import payloads
from laborlens.sources.market import AS_OF, Market, expanded

_D = "('tag', 'required', 'preferred')"
c = F.col
n_rows = lambda name="n": F.count("*").alias(name)


def _number(*order, by=(), name="r") -> F.Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias(name)


def _tags(m: Market) -> DataFrame:
    return m.view("part").select((c("p_size") % 2).alias("source"), c("p_partkey").alias("id"), F.explode(F.array("p_brand", "p_type")).alias("tag"))


def _missing_weeks(m: Market) -> DataFrame:
    reports = m.sql("SELECT CAST(date_trunc('week', posted_at) AS DATE) AS week_start_date, field_id AS major_id, CASE WHEN field_id % 2 = 0 OR id % 40 > 0 THEN 'text' END AS llm_report FROM job_posting WHERE posted_at IS NOT NULL")
    return lookups.weeks_with_missing(reports, "1996-01-01")


def _new_skills(m: Market) -> DataFrame:
    return m.view("part").select((c("p_size") + 900).alias("id"), F.concat(F.lit("new"), c("p_size").cast("string")).alias("name")).union(m.skill.select("id", "name"))


def _known_pages(m: Market) -> DataFrame:
    """Longest run of pages of which every row is known, for each user."""
    pages = m.view("events").groupBy("user_id", F.floor(c("event_id") / 50).alias("page")).agg(F.min(F.when(c("event_type") == "click", 1).otherwise(0)).alias("known"))
    island = F.sum(1 - c("known")).over(Window.partitionBy("user_id").orderBy("page"))
    return pages.withColumn("island", island).groupBy("user_id", "island").agg(F.sum("known").alias("run")).groupBy("user_id").agg(F.max("run").alias("longest"))


def _daily(m: Market) -> DataFrame:
    return m.view("events").select("event_type", (c("user_id") % 10).alias("keyword"), c("ts").cast("date").alias("day")).distinct()


def _detail_wins(m: Market) -> DataFrame:
    listed = m.posting.select("source", c("id").alias("source_job_id"), "title", c("source").alias("location"), "career_min")
    details = m.posting.where("id % 3 = 0").select(F.to_json(F.struct("id", "location", F.concat(F.lit("D"), "title").alias("title"))).alias("payload"))
    return payloads.with_detail(listed, details).select(c("source_job_id").alias("id"), "location", "title")


def _run_counters(m: Market) -> DataFrame:
    runs = m.sql("SELECT user_id AS run_id, CASE event_id % 6 WHEN 0 THEN 'inserted' WHEN 1 THEN 'updated' WHEN 2 THEN 'skipped' WHEN 3 THEN 'unchanged' WHEN 4 THEN 'failed' END AS action FROM events")
    return lookups.run_counters(runs)


def _report_facts(m: Market) -> DataFrame:
    return lookups.report_facts(m, ("2001-06-11 00:00:00", "2001-06-18 00:00:00"), ("2001-06-18 00:00:00", "2001-06-25 00:00:00"))


def _messages(m: Market) -> DataFrame:
    rows = m.view("conversations").select("conv_id", "turn", "role", F.when((c("role") == "assistant") & (c("turn") % 3 == 0), "off topic").otherwise(F.coalesce("text", F.lit(""))).alias("content"))
    return lookups.recent_messages(rows, "conv_id", "turn", off_topic="off topic").select("conv_id", "turn", "role")


def _companies_to_embed(m: Market) -> DataFrame:
    rows = m.company.withColumn("industry", F.lit(None).cast("string"))
    text = lookups.company_text()
    old = F.when(c("id") % 5 == 0, F.sha2(text, 256)).when(c("id") % 5 == 1, F.lit("stale"))
    return lookups.companies_to_embed(rows.withColumn("embed_hash", old)).select("id", "text")


def _dictionary(m: Market) -> DataFrame:
    rows = lookups.dictionary_rows(m.skill, m.alias.union(m.skill.where("id % 3 = 0").select("id", F.upper("name"), F.lit(True))))
    return rows.select("id", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("exact", ",").alias("exact"))


def _chunk_state(m: Market) -> DataFrame:
    chunks = m.vectors.select(c("vec_id").alias("posting_id"), (c("label") % 3).alias("section"), c("label").alias("seq"), F.concat(F.lit("h"), c("vec_id").cast("string")).alias("chunk_hash"), F.when(c("vec_id") % 7 > 0, c("embedding")).alias("embedding"))
    return lookups.chunk_state(chunks)


def _skill_pairs(m: Market) -> DataFrame:
    tags = m.posting_skill.where("requirement = 'tag'")
    both = tags.select("posting_id", c("skill_id").alias("a")).join(tags.select("posting_id", c("skill_id").alias("b")), "posting_id")
    return both.where("a < b").groupBy("a", "b").agg(F.countDistinct("posting_id").alias("n"))


def _retry(m: Market) -> DataFrame:
    """Delay before each further try of a failed run."""
    return m.view("events").select("event_id", lookups.retry_delay((c("event_id") % 7 + 1).cast("int"), 5, 8).alias("minutes"))


def _jobs(m: Market) -> DataFrame:
    sites = m.view("nation").select("n_name", c("n_regionkey").alias("region"))
    keywords = m.view("region").select("r_regionkey", F.explode(F.array(F.lit("backend"), F.lit("data"), F.lit("ai"))).alias("keyword"))
    return lookups.job_fan_out(sites, keywords.withColumnRenamed("r_regionkey", "region"), ["region"], "n_name", "keyword")


def _limiter(m: Market) -> DataFrame:
    events = m.view("events").select("user_id", "event_id", "ts", (c("event_id") % 50).cast("long").alias("tokens"))
    return lookups.sliding_minute(events, "user_id", "ts", "tokens").select("event_id", "requests", "tokens_in_minute")


#: name -> (plan, SQL)
FORMS = {
    "src1_table_scan": (lambda m: m.company.select("id", "name", "size_type", "employee_count", "nation_id"), "SELECT id, name, size_type, employee_count, nation_id FROM company"),
    "src14_job_fan_out": (_jobs, "SELECT n.n_name AS site, k.keyword, concat(n.n_name, ':', k.keyword) AS job FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey CROSS JOIN (VALUES ('backend'), ('data'), ('ai')) AS k(keyword)"),
    "ana24_unmatched_tags": (
        lambda m: backlog.unmatched_tags(_tags(m).select("id", "tag"), m.skill.select("name").union(m.alias.select("alias"))),
        "WITH t AS (SELECT p_partkey AS id, lower(trim(x)) AS tag FROM (SELECT p_partkey, p_brand AS x FROM part UNION ALL SELECT p_partkey, p_type FROM part)), k AS (SELECT lower(name) AS tag FROM skill UNION SELECT lower(alias) FROM skill_alias) SELECT t.tag, k.tag IS NOT NULL AS matched, count(*) AS n FROM t LEFT JOIN k ON k.tag = t.tag GROUP BY 1, 2",
    ),
    "ana26_dictionary_recall": (
        lambda m: backlog.dictionary_recall(_tags(m), m.skill.select("name")),
        "WITH t AS (SELECT p_size % 2 AS source, lower(p_brand) AS tag FROM part UNION ALL SELECT p_size % 2, lower(p_type) FROM part) SELECT source, count(*) AS tags, count(*) FILTER (WHERE tag IN (SELECT lower(name) FROM skill)) AS matched, round(count(*) FILTER (WHERE tag IN (SELECT lower(name) FROM skill)) / CAST(count(*) AS DOUBLE), 4) AS recall FROM t GROUP BY source",
    ),
    "ana27_chunks_by_section": (lambda m: m.vectors.groupBy((c("label") % 3).alias("section")).agg(n_rows()), "SELECT label % 3 AS section, count(*) AS n FROM embeddings GROUP BY 1"),
    "ana31_missing_weeks": (_missing_weeks, "SELECT DISTINCT CAST(date_trunc('week', posted_at) AS DATE) AS week_start_date FROM job_posting WHERE posted_at IS NOT NULL AND date_trunc('week', posted_at) >= DATE '1996-01-01' AND NOT coalesce(field_id % 2 = 0, false) AND id % 40 = 0"),
    "ana32_report_facts": (
        _report_facts,
        f"WITH c AS (SELECT s.name, count(DISTINCT CASE WHEN p.posted_at >= TIMESTAMP '2001-06-18 00:00:00' THEN p.id END) AS cur, count(DISTINCT CASE WHEN p.posted_at < TIMESTAMP '2001-06-18 00:00:00' THEN p.id END) AS prev FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id JOIN skill s ON s.id = ps.skill_id WHERE ps.requirement IN {_D} AND p.posted_at >= TIMESTAMP '2001-06-11 00:00:00' AND p.posted_at < TIMESTAMP '2001-06-25 00:00:00' GROUP BY 1) SELECT row_number() OVER (ORDER BY cur DESC, name) AS rank, name, cur, prev, cur - prev AS change, CASE WHEN prev > 0 THEN round((cur - prev) / CAST(prev AS DOUBLE), 4) END AS rate, CASE WHEN prev = 0 THEN 'new' WHEN cur > prev THEN 'up' WHEN cur < prev THEN 'down' ELSE 'same' END AS trend, name = (SELECT name FROM c ORDER BY cur - prev DESC, name LIMIT 1) AS most_gained, name = (SELECT name FROM c ORDER BY cur - prev, name LIMIT 1) AS most_lost FROM c",
    ),
    "ana32_report_text": (
        lambda m: report.facts_text(_report_facts(m), "2001-06-18", postings=m.posting.agg(n_rows())),
        f"""WITH f AS (WITH c AS (SELECT s.name, count(DISTINCT CASE WHEN p.posted_at >= TIMESTAMP '2001-06-18 00:00:00' THEN p.id END) AS cur, count(DISTINCT CASE WHEN p.posted_at < TIMESTAMP '2001-06-18 00:00:00' THEN p.id END) AS prev FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id JOIN skill s ON s.id = ps.skill_id WHERE ps.requirement IN {_D} AND p.posted_at >= TIMESTAMP '2001-06-11 00:00:00' AND p.posted_at < TIMESTAMP '2001-06-25 00:00:00' GROUP BY 1) SELECT row_number() OVER (ORDER BY cur DESC, name) AS rank, name, cur, prev, cur - prev AS change, CASE WHEN prev > 0 THEN round((cur - prev) / CAST(prev AS DOUBLE), 4) END AS rate, CASE WHEN prev = 0 THEN 'new' WHEN cur > prev THEN 'up' WHEN cur < prev THEN 'down' ELSE 'same' END AS trend, name = (SELECT name FROM c ORDER BY cur - prev DESC, name LIMIT 1) AS most_gained, name = (SELECT name FROM c ORDER BY cur - prev, name LIMIT 1) AS most_lost FROM c), x AS (SELECT *, CASE WHEN rate IS NULL THEN format('{{:,}}건 (신규)', cur) ELSE concat(format('{{:,}} → {{:,}}건 (', prev, cur), printf('%+.1f', round(rate * 100, 1)), '%)') END AS t FROM f)
 SELECT concat_ws(chr(10), '주차: 2001-06-18 시작', '분야: 전체', format('이번 주 수집 공고: {{:,}}건', (SELECT count(*) FROM job_posting)), chr(10) || '가장 많이 찾은 기술 스택', string_agg(concat('  ', rank, '. ', name, ' ', t), chr(10) ORDER BY rank) FILTER (WHERE rank <= 10),
 max(CASE WHEN most_gained THEN concat(chr(10), '최대 상승: ', name, ' ', t) END), max(CASE WHEN most_lost THEN concat('최대 하락: ', name, ' ', t) END), chr(10) || '주요 기술 언급량', string_agg(concat('  ', name, ' ', format('{{:,}} → {{:,}}', prev, cur)), chr(10) ORDER BY rank) FILTER (WHERE rank <= 10)) AS text FROM x""",
    ),
    "ana34_recent_messages": (
        _messages,
        """WITH last AS (SELECT conv_id, turn, role, role = 'assistant' AND turn % 3 = 0 AS off, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
 kept AS (SELECT *, lead(off) OVER (PARTITION BY conv_id ORDER BY turn) AS next_off FROM last WHERE r <= 12 AND role IN ('user', 'assistant')) SELECT conv_id, turn, role FROM kept WHERE NOT off AND NOT (role = 'user' AND coalesce(next_off, false))""",
    ),
    "ana35_reparse_targets": (lambda m: lookups.reparse_targets(m.posting, "site_a", 500).select("id", "source", "title"), "SELECT id, source, title FROM job_posting WHERE source = 'site_a' ORDER BY id LIMIT 500"),
    "ana36_embed_targets": (lambda m: lookups.postings_to_embed(_described(m)).select("id"), "SELECT id FROM job_posting WHERE id % 6 > 0 AND NOT body_is_image AND NOT body_extract_failed AND embed_hash IS DISTINCT FROM content_hash AND content_hash IS NOT NULL"),
    "ana36_embed_backlog": (lambda m: _described(m).where(lookups.embeddable() & lookups.needs_embedding()).agg(n_rows()), "SELECT count(*) AS n FROM job_posting WHERE id % 6 > 0 AND NOT body_is_image AND NOT body_extract_failed AND (embed_hash IS NULL OR embed_hash IS DISTINCT FROM content_hash)"),
    "ana37_companies_to_embed": (
        _companies_to_embed,
        "SELECT id, text FROM (SELECT id, nullif(concat_ws(chr(10), nullif(trim(description), ''), nullif(trim(business_content), '')), '') AS text FROM company) WHERE text IS NOT NULL AND id % 5 > 0",
    ),
    "ana39_dictionary_rows": (
        _dictionary,
        "SELECT s.id, s.name, concat_ws(',', CASE WHEN id % 3 > 0 THEN name END, lower(replace(name, '#', ' ')), concat('group', CAST(id % 10 AS VARCHAR))) AS aliases, concat_ws(',', concat('B', CAST(id AS VARCHAR)), CASE WHEN id % 3 = 0 THEN upper(name) END) AS exact FROM skill s",
    ),
    "ana40_alias_collisions": (lambda m: m.alias.groupBy(F.lower("alias").alias("alias")).agg(F.countDistinct("skill_id").alias("skills")).where("skills > 1"), "SELECT lower(alias) AS alias, count(DISTINCT skill_id) AS skills FROM skill_alias GROUP BY 1 HAVING count(DISTINCT skill_id) > 1"),
    "ana40_catalog_stats": (lambda m: m.skill_field.join(m.field.select(c("id").alias("field_id"), "code"), "field_id").groupBy("code").agg(n_rows("skills")), "SELECT f.code, count(*) AS skills FROM skill_field sf JOIN tech_field f ON f.id = sf.field_id GROUP BY f.code"),
    "ana41_chunk_state": (_chunk_state, "SELECT vec_id AS posting_id, label % 3 AS section, label AS seq, CASE WHEN vec_id % 7 = 0 THEN '' ELSE concat('h', CAST(vec_id AS VARCHAR(20))) END AS state FROM embeddings"),
    "ana41_field_ids": (lambda m: lookups.field_ids(m.field), "SELECT code, id FROM tech_field"),
    "ana41_content_hashes": (lambda m: lookups.content_hashes(m.posting.withColumnRenamed("id", "source_job_id"), "site_b", m.posting.where("id % 4 = 1").select(c("id").alias("source_job_id"))), "SELECT id AS source_job_id, content_hash FROM job_posting WHERE source = 'site_b' AND id % 4 = 1"),
    "ana41_source_ids": (lambda m: lookups.source_ids(m.posting.withColumnRenamed("id", "source_job_id"), "site_a"), "SELECT id AS source_job_id FROM job_posting WHERE source = 'site_a'"),
    "ana42_roadmap_lookups": (
        lambda m: lookups.roadmap_facts(m, 99, [11, 22], AS_OF),
        f"SELECT coalesce((SELECT name FROM tech_field WHERE id = 99), 'all') AS field, (SELECT string_agg(name, ',' ORDER BY name) FROM skill WHERE id IN (11, 22)) AS skills, (SELECT count(*) FROM job_posting p WHERE p.posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS total",
    ),
    "jn1_inner_equi": (
        lambda m: m.posting_skill.join(m.posting.select(c("id").alias("posting_id"), "source"), "posting_id").join(m.skill.select(c("id").alias("skill_id"), "name"), "skill_id").groupBy("name", "source").agg(n_rows()),
        "SELECT s.name, p.source, count(*) AS n FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id JOIN skill s ON s.id = ps.skill_id GROUP BY 1, 2",
    ),
    "jn2_left_outer": (lambda m: m.company.select("id").join(m.posting.groupBy(c("company_id").alias("id")).agg(n_rows()), "id", "left").na.fill(0, ["n"]), "SELECT c.id, count(p.id) AS n FROM company c LEFT JOIN job_posting p ON p.company_id = c.id GROUP BY c.id"),
    "jn3_semi_in": (lambda m: filters.postings(m, filters.Scope(size_type="large")).select("id"), "SELECT id FROM job_posting WHERE company_id IN (SELECT id FROM company WHERE size_type = 'large')"),
    "jn4_not_in_null_aware": (
        lambda m: merge.not_in(m.company.select("id"), "id", m.posting.select(F.when(c("id") % 2 == 0, c("company_id")).alias("x")), "x"),
        "SELECT id FROM company WHERE id NOT IN (SELECT CASE WHEN id % 2 = 0 THEN company_id END FROM job_posting)",
    ),
    "jn4_not_in_without_null": (
        lambda m: merge.not_in(m.company.select("id"), "id", m.posting.where("salary_type = 'negotiable' AND company_id IS NOT NULL"), "company_id"),
        "SELECT id FROM company WHERE id NOT IN (SELECT company_id FROM job_posting WHERE salary_type = 'negotiable' AND company_id IS NOT NULL)",
    ),
    "jn5_tuple_not_in": (
        lambda m: merge.stale_chunks(m.vectors.selectExpr("vec_id AS posting_id", "label % 3 AS section", "label AS seq"), m.vectors.where("label % 2 = 0").selectExpr("vec_id AS posting_id", "label % 3 AS section", "label AS seq")),
        "SELECT vec_id AS posting_id, label % 3 AS section, label AS seq FROM embeddings WHERE (vec_id, label % 3, label) NOT IN (SELECT (vec_id, label % 3, label) FROM embeddings WHERE label % 2 = 0)",
    ),
    "jn6_anti_filter": (lambda m: m.posting_skill.where(~c("skill_id").isin(11, 22, 33) & (c("requirement") != "body")).groupBy("skill_id").agg(n_rows()), "SELECT skill_id, count(*) AS n FROM posting_skill WHERE skill_id NOT IN (11, 22, 33) AND requirement <> 'body' GROUP BY 1"),
    "jn7_mark_join": (
        lambda m: m.skill.select("name").join(m.alias.select(c("alias").alias("name")).union(m.skill.where("is_common").select("name")).distinct().withColumn("hit", F.lit(True)), "name", "left").select("name", c("hit").isNotNull().alias("matched")),
        "SELECT name, EXISTS (SELECT 1 FROM (SELECT alias AS x FROM skill_alias UNION ALL SELECT name FROM skill WHERE is_common) d WHERE d.x = s.name) AS matched FROM skill s",
    ),
    "jn8_correlated_scalar": (lambda m: m.company.select("id").join(m.posting.groupBy(c("company_id").alias("id")).agg(n_rows()), "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "SELECT c.id, (SELECT count(*) FROM job_posting p WHERE p.company_id = c.id) AS n FROM company c"),
    "jn9_uncorrelated_scalar": (lambda m: filters.postings(m, filters.Scope(field="asia")).select("id"), "SELECT id FROM job_posting WHERE field_id = (SELECT id FROM tech_field WHERE code = 'asia')"),
    "jn10_self_join_pairs": (_skill_pairs, "SELECT a.skill_id AS a, b.skill_id AS b, count(DISTINCT a.posting_id) AS n FROM posting_skill a JOIN posting_skill b ON b.posting_id = a.posting_id AND a.skill_id < b.skill_id WHERE a.requirement = 'tag' AND b.requirement = 'tag' GROUP BY 1, 2"),
    "jn12_compound_on": (lambda m: m.skill.select("id").join(m.skill_field.where("field_id = 2").select(c("skill_id").alias("id"), "field_id"), "id", "left"), "SELECT s.id, sf.field_id FROM skill s LEFT JOIN skill_field sf ON sf.skill_id = s.id AND sf.field_id = 2"),
    "jn14_or_predicate": (
        lambda m: m.skill.join(m.alias, c("id") == c("skill_id")).where((F.lower("name") == "brand#13") | (~c("case_sensitive") & (c("alias") == "brand 22")) | (c("case_sensitive") & (c("alias") == "B31"))).select("id", "alias"),
        "SELECT s.id, a.alias FROM skill s JOIN skill_alias a ON a.skill_id = s.id WHERE lower(s.name) = 'brand#13' OR (NOT a.case_sensitive AND a.alias = 'brand 22') OR (a.case_sensitive AND a.alias = 'B31')",
    ),
    "jn15_range_overlap": (
        lambda m: m.posting.select(F.explode(F.array(*(F.when(filters.career_overlaps(x), F.lit(x)) for x in filters.CAREER))).alias("level")).where("level is not null").groupBy("level").agg(n_rows()),
        "SELECT lv.level, count(*) AS n FROM job_posting p JOIN (VALUES ('newcomer', 0, 0), ('junior', 1, 3), ('mid', 4, 7), ('senior', 8, 1000)) AS lv(level, low, high) ON coalesce(p.career_min, 0) <= lv.high AND (p.career_max IS NULL OR p.career_max >= lv.low) GROUP BY 1",
    ),
    "jn17_merged_results": (
        lambda m: m.posting_skill.where("requirement = 'tag'").groupBy(c("skill_id").alias("id")).agg(n_rows("tags")).join(m.posting_skill.where("requirement = 'body' AND skill_id % 2 = 0").groupBy(c("skill_id").alias("id")).agg(n_rows("bodies")), "id", "full"),
        "SELECT coalesce(a.id, b.id) AS id, a.n AS tags, b.n AS bodies FROM (SELECT skill_id AS id, count(*) AS n FROM posting_skill WHERE requirement = 'tag' GROUP BY 1) a FULL JOIN (SELECT skill_id AS id, count(*) AS n FROM posting_skill WHERE requirement = 'body' AND skill_id % 2 = 0 GROUP BY 1) b ON a.id = b.id",
    ),
    "jn18_latest_wins": (_detail_wins, "SELECT id, CASE WHEN id % 3 = 0 THEN coalesce(location, source) ELSE source END AS location, CASE WHEN id % 3 = 0 THEN concat('D', title) ELSE title END AS title FROM job_posting"),
    "flt1_half_open_window": (lambda m: filters.postings(m, filters.Scope(window=("2001-01-01 00:00:00", "2001-02-01 00:00:00"), days=1)).select("id"), "SELECT id FROM job_posting WHERE posted_at >= TIMESTAMP '2001-01-01 00:00:00' AND posted_at < TIMESTAMP '2001-02-01 00:00:00'"),
    "flt2_career_overlap": (lambda m: m.posting.where(filters.career_overlaps("junior")).select("id"), "SELECT id FROM job_posting WHERE coalesce(career_min, 0) <= 3 AND (career_max IS NULL OR career_max >= 1)"),
    "flt3_active": (lambda m: m.posting.where(filters.active()).select("id"), f"SELECT id FROM job_posting WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}'"),
    "flt5_is_true": (lambda m: m.posting.select("id", (c("career_min") > 3).eqNullSafe(True).alias("t"), (~(c("career_min") > 3).eqNullSafe(True)).alias("nt"), c("career_min").isNull().alias("n")), "SELECT id, (career_min > 3) IS TRUE AS t, (career_min > 3) IS NOT TRUE AS nt, career_min IS NULL AS n FROM job_posting"),
    "flt6_is_distinct": (lambda m: m.posting.where(lookups.needs_embedding()).select("id"), "SELECT id FROM job_posting WHERE embed_hash IS NULL OR embed_hash IS DISTINCT FROM content_hash"),
    "flt7_ilike": (lambda m: m.company.where(c("name").ilike("%CUSTOMER#00000001%")).select("id", "name"), "SELECT id, name FROM company WHERE name ILIKE '%CUSTOMER#00000001%'"),
    "flt8_length_and_lists": (
        lambda m: m.alias.where(F.length("alias").between(3, 30) & ~c("alias").isin("group1", "group2") & ~c("alias").rlike("^[0-9]|7$")).select("skill_id", "alias"),
        "SELECT skill_id, alias FROM skill_alias WHERE length(alias) BETWEEN 3 AND 30 AND alias <> ALL (SELECT * FROM (VALUES ('group1'), ('group2')) AS v(x)) AND NOT regexp_matches(alias, '^[0-9]|7$')",
    ),
    "flt9_constant_false": (lambda m: m.company.where(F.lit(False)).select("id"), "SELECT id FROM company WHERE 1 = 0"),
    "flt12_age_cutoff": (lambda m: lookups.older_than(m.view("crawl_run").where("status = 'running'"), "started_at", "2024-01-31 00:00:00", "6 hours").select("id"), "SELECT id FROM crawl_run WHERE status = 'running' AND started_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 6 HOUR"),
    "flt14_ownership": (
        lambda m: lookups.owned(m.view("events").select("event_id", "user_id"), "event_id", m.view("events").selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS user_id").where("event_id % 2 = 0")).select("event_id"),
        "SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 > 0",
    ),
    "agg1_count": (lambda m: m.posting.agg(n_rows("rows_"), F.count("career_min").alias("known")), "SELECT count(*) AS rows_, count(career_min) AS known FROM job_posting"),
    "agg2_count_distinct": (lambda m: m.posting_skill.groupBy("requirement").agg(F.countDistinct("posting_id").alias("n")), "SELECT requirement, count(DISTINCT posting_id) AS n FROM posting_skill GROUP BY 1"),
    "agg3_filter": (
        lambda m: m.posting.agg(
            F.count_if(c("career_min") > 3).alias("n"),
            F.countDistinct(F.when(c("field_id") == 1, c("company_id"))).alias("d"),
            F.min(F.when(c("salary_type") == "range", c("salary_min"))).alias("lo"),
            F.max(F.when(c("salary_type") == "range", c("salary_min"))).alias("hi"),
            F.round(F.percentile(F.when(c("salary_type") == "range", c("salary_min")), F.lit(0.75)), 4).alias("q3"),
        ),
        "SELECT count(*) FILTER (WHERE career_min > 3) AS n, count(DISTINCT company_id) FILTER (WHERE field_id = 1) AS d, min(salary_min) FILTER (WHERE salary_type = 'range') AS lo, max(salary_min) FILTER (WHERE salary_type = 'range') AS hi, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY salary_min) FILTER (WHERE salary_type = 'range'), 4) AS q3 FROM job_posting",
    ),
    "agg5_percentile": (
        lambda m: m.posting.groupBy("source").agg(*(F.round(F.percentile("salary_min", F.lit(p)), 4).alias(k) for k, p in (("median", 0.5), ("q1", 0.25)))),
        "SELECT source, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY salary_min), 4) AS median, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY salary_min), 4) AS q1 FROM job_posting GROUP BY 1",
    ),
    "agg7_having": (lambda m: m.posting.groupBy("company_id").agg(n_rows()).where("n >= 12"), "SELECT company_id, count(*) AS n FROM job_posting GROUP BY 1 HAVING count(*) >= 12"),
    "agg8_group_expression": (lambda m: m.posting.where("location is not null").groupBy(F.split_part("location", F.lit(" "), F.lit(1)).alias("region")).agg(n_rows()), "SELECT split_part(location, ' ', 1) AS region, count(*) AS n FROM job_posting WHERE location IS NOT NULL GROUP BY split_part(location, ' ', 1)"),
    "agg9_global": (lambda m: m.posting.agg(F.min("salary_min").alias("lo"), F.max("salary_min").alias("hi"), F.sum("salary_min").alias("total")), "SELECT min(salary_min) AS lo, max(salary_min) AS hi, CAST(sum(CAST(salary_min AS BIGINT)) AS BIGINT) AS total FROM job_posting"),
    "agg10_distinct_on": (lambda m: m.posting.groupBy("company_id").agg(F.min("id").alias("id")), "SELECT company_id, id FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY id) AS r FROM job_posting) WHERE r = 1"),
    "agg12_majority_vote": (
        lambda m: m.posting_skill.groupBy("posting_id", (c("skill_id") % 3).alias("vote")).agg(n_rows()).groupBy("posting_id").agg(F.max(F.struct("n", "vote")).alias("a"), F.max(F.struct("n", (-c("vote")).alias("v"))).alias("b")).select("posting_id", F.when(c("a.vote") == -c("b.v"), c("a.vote")).alias("vote")),
        "SELECT posting_id, CASE WHEN count(*) = 1 THEN min(vote) END AS vote FROM (SELECT posting_id, vote, n, max(n) OVER (PARTITION BY posting_id) AS top FROM (SELECT posting_id, skill_id % 3 AS vote, count(*) AS n FROM posting_skill GROUP BY 1, 2)) WHERE n = top GROUP BY 1",
    ),
    "agg13_max_grade": (
        lambda m: m.posting_skill.groupBy("skill_id").agg(F.max(F.create_map(*(F.lit(x) for p in filters.GRADES.items() for x in p))[c("requirement")]).alias("grade"), F.sum("mentions").alias("mentions")),
        "SELECT skill_id, max(CASE requirement WHEN 'tag' THEN 3 WHEN 'required' THEN 2 WHEN 'preferred' THEN 1 ELSE 0 END) AS grade, CAST(sum(mentions) AS BIGINT) AS mentions FROM posting_skill GROUP BY 1",
    ),
    "agg15_run_counters": (_run_counters, "SELECT user_id AS run_id, count(*) AS fetched, count(*) FILTER (WHERE event_id % 6 = 0) AS inserted, count(*) FILTER (WHERE event_id % 6 = 1) AS updated, count(*) FILTER (WHERE event_id % 6 = 2) AS skipped, count(*) FILTER (WHERE event_id % 6 = 3) AS unchanged, count(*) FILTER (WHERE event_id % 6 = 4) AS failed FROM events GROUP BY 1"),
    "win1_rank": (lambda m: m.posting.select("id", _number(F.desc_nulls_last("salary_min"), "id", by=["company_id"], name="rank")), "SELECT id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY salary_min DESC NULLS LAST, id) AS INT) AS rank FROM job_posting"),
    "win2_top_per_group": (lambda m: m.posting.select("company_id", "id", _number(F.desc_nulls_last("salary_min"), "id", by=["company_id"])).where("r <= 3"), "SELECT company_id, id, r FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY salary_min DESC NULLS LAST, id) AS r FROM job_posting) WHERE r <= 3"),
    "win3_percent_rank": (
        lambda m: lookups.percent_rank(m.company.select("id", "size_type", F.coalesce("employee_count", F.lit(0)).alias("v")), "v", by=["size_type"]).select("id", F.round("percent_rank", 6).alias("p")),
        "SELECT id, round(percent_rank() OVER (PARTITION BY size_type ORDER BY coalesce(employee_count, 0)), 6) AS p FROM company",
    ),
    "win4_first_per_key": (lambda m: m.posting.groupBy("company_id", "title").agg(F.min("id").alias("id")), "SELECT company_id, title, id FROM (SELECT company_id, title, id, row_number() OVER (PARTITION BY company_id, title ORDER BY id) AS r FROM job_posting) WHERE r = 1"),
    "win5_known_page_run": (_known_pages, "WITH p AS (SELECT user_id, floor(event_id / 50) AS page, min(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS known FROM events GROUP BY 1, 2), g AS (SELECT *, sum(1 - known) OVER (PARTITION BY user_id ORDER BY page) AS island FROM p) SELECT user_id, CAST(max(run) AS BIGINT) AS longest FROM (SELECT user_id, island, sum(known) AS run FROM g GROUP BY 1, 2) GROUP BY 1"),
    "srt1_multi_key": (lambda m: m.posting.select("id", _number(F.desc(F.coalesce("career_min", F.lit(0))), "title", "id", by=["company_id"], name="pos")), "SELECT id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY coalesce(career_min, 0) DESC, title, id) AS INT) AS pos FROM job_posting"),
    "srt2_top_k": (lambda m: m.posting.select("id", "salary_min").orderBy(F.desc_nulls_last("salary_min"), "id").limit(25), "SELECT id, salary_min FROM job_posting ORDER BY salary_min DESC NULLS LAST, id LIMIT 25"),
    "srt4_last_n_ascending": (lambda m: m.posting.orderBy(F.desc("id")).limit(20).select("id", c("posted_at").cast("date").alias("posted_day"), _number("id", name="pos")), "SELECT id, posted_day, row_number() OVER (ORDER BY id) AS pos FROM (SELECT id, CAST(posted_at AS DATE) AS posted_day FROM job_posting ORDER BY id DESC LIMIT 20)"),
    "set1_union_all": (lambda m: m.alias.select(F.lit("alias").alias("src")).union(m.skill.select(F.lit("name"))).groupBy("src").agg(n_rows()), "SELECT src, count(*) AS n FROM (SELECT 'alias' AS src FROM skill_alias UNION ALL SELECT 'name' FROM skill) GROUP BY 1"),
    "set2_union": (lambda m: m.company.where("size_type = 'small'").select("id").union(m.posting.where("source = 'site_a'").select("company_id")).distinct(), "SELECT id FROM company WHERE size_type = 'small' UNION SELECT company_id FROM job_posting WHERE source = 'site_a'"),
    "set3_intersect": (lambda m: m.posting_skill.where("requirement = 'tag'").select("skill_id").intersect(m.posting_skill.where("requirement = 'body'").select("skill_id")), "SELECT skill_id FROM posting_skill WHERE requirement = 'tag' INTERSECT SELECT skill_id FROM posting_skill WHERE requirement = 'body'"),
    "set4_except": (lambda m: m.posting.where("salary_type = 'range'").select("company_id").subtract(m.posting.where("salary_type = 'negotiable'").select("company_id")), "SELECT company_id FROM job_posting WHERE salary_type = 'range' EXCEPT SELECT company_id FROM job_posting WHERE salary_type = 'negotiable'"),
    "cte1_chain": (lambda m: m.posting_skill.groupBy("posting_id").agg(n_rows()).groupBy("n").agg(n_rows("postings")).where("postings > 5"), "WITH a AS (SELECT posting_id, count(*) AS n FROM posting_skill GROUP BY 1), b AS (SELECT n, count(*) AS postings FROM a GROUP BY 1) SELECT n, postings FROM b WHERE postings > 5"),
    "sc1_text_functions": (
        lambda m: m.company.select("id", F.coalesce(F.nullif(F.trim("description"), F.lit("")), "business_content", F.lit("-")).alias("text"), F.lower("name").alias("low"), F.length("name").alias("len"), F.left("name", F.lit(5)).alias("head")),
        "SELECT id, coalesce(nullif(trim(description), ''), business_content, '-') AS text, lower(name) AS low, length(name) AS len, left(name, 5) AS head FROM company",
    ),
    "sc2_split_part": (lambda m: m.posting.where("location is not null").select("id", *(F.split_part("location", F.lit(" "), F.lit(i)).alias(k) for i, k in ((1, "a"), (2, "b")))), "SELECT id, split_part(location, ' ', 1) AS a, split_part(location, ' ', 2) AS b FROM job_posting WHERE location IS NOT NULL"),
    "sc4_arithmetic": (lambda m: m.company.where("employee_count > 0").select("id", *(F.round(f("employee_count"), 6).alias(k) for f, k in ((F.sqrt, "s"), (F.ln, "l"), (F.log10, "d")))), "SELECT id, round(sqrt(employee_count), 6) AS s, round(ln(employee_count), 6) AS l, round(log10(employee_count), 6) AS d FROM company WHERE employee_count > 0"),
    "mrg4_insert_ignore": (lambda m: merge.insert_ignore(m.skill.select("id", "name"), _new_skills(m), ["name"]), "SELECT id, name FROM skill UNION ALL SELECT DISTINCT 900 + p_size AS id, concat('new', CAST(p_size AS VARCHAR(4))) AS name FROM part"),
    "mrg10_stale_runs": (
        lambda m: merge.reap_stale(m.view("crawl_run"), moment("2024-01-15 00:00:00"), moment(AS_OF)).select("id", "status", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at")),
        f"SELECT id, CASE WHEN stale THEN 'failed' ELSE status END AS status, strftime(CASE WHEN stale THEN TIMESTAMP '{AS_OF}' ELSE finished_at END, '%Y-%m-%d %H:%M:%S') AS finished_at FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '2024-01-15 00:00:00' AS stale FROM crawl_run)",
    ),
    "mrg14_change_class": (
        lambda m: merge.change_class(m.posting.select("id", F.coalesce("content_hash", F.lit("none")).alias("content_hash")), m.posting.where("embed_hash is not null").select("id", c("embed_hash").alias("content_hash")), ["id"]).select("id", "action"),
        "SELECT id, CASE WHEN embed_hash IS NULL THEN 'inserted' WHEN embed_hash = coalesce(content_hash, 'none') THEN 'unchanged' ELSE 'updated' END AS action FROM job_posting",
    ),
    "mrg15_prune": (lambda m: m.skill.where("category is not null").select("id", "name"), "SELECT id, name FROM skill WHERE category IS NOT NULL"),
    "st3_backfill_stop": (
        lambda m: lookups.backfill_stop(m.posting.select(F.floor(c("id") / 100).alias("page"), "posted_at"), "page", "posted_at", "1998-01-01 00:00:00"),
        "SELECT CAST(floor(id / 100) AS BIGINT) AS page, coalesce(max(posted_at) < TIMESTAMP '1998-01-01 00:00:00', false) AS stop FROM job_posting GROUP BY 1",
    ),
    "st4_page_outcome": (
        lambda m: lookups.page_outcome(m.view("events").select(c("user_id").alias("run"), (c("event_id") % 4).alias("page"), F.when(c("event_id") % 5 == 0, 0).otherwise(c("event_id") % 3).alias("jobs")).groupBy("run", "page").agg(F.min("jobs").alias("jobs")), "run", "page", "jobs"),
        "WITH p AS (SELECT user_id AS run, event_id % 4 AS page, min(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 3 END) AS jobs FROM events GROUP BY 1, 2) SELECT run, page, CASE WHEN jobs > 0 THEN 'read' WHEN page = (SELECT min(page) FROM p q WHERE q.run = p.run) THEN 'failed' ELSE 'end' END AS outcome FROM p",
    ),
    "st8_sliding_minute": (_limiter, "SELECT event_id, count(*) OVER w AS requests, CAST(sum(event_id % 50) OVER w AS BIGINT) AS tokens_in_minute FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999' SECOND PRECEDING AND CURRENT ROW)"),
    "st9_minute_counter": (lambda m: m.view("events").groupBy("user_id", F.date_format(F.window("ts", "1 minute")["start"], "yyyy-MM-dd HH:mm:ss").alias("minute_")).agg(n_rows()), "SELECT user_id, CAST(date_trunc('minute', ts) AS VARCHAR(19)) AS minute_, count(*) AS n FROM events GROUP BY 1, 2"),
    "st10_daily_budget": (lambda m: m.view("events").groupBy("user_id", (c("ts") + F.expr("INTERVAL 9 HOURS")).cast("date").alias("day")).agg(F.round(F.sum("value"), 4).alias("spent")), "SELECT user_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, round(sum(value), 4) AS spent FROM events GROUP BY 1, 2"),
    "st11_daily_job_dedup": (_daily, "SELECT DISTINCT event_type, user_id % 10 AS keyword, CAST(ts AS DATE) AS day FROM events"),
    "st12_retry_backoff": (_retry, "SELECT event_id, CASE WHEN event_id % 7 + 1 < 8 THEN 5 * CAST(power(2, event_id % 7) AS BIGINT) END AS minutes FROM events"),
    "sc7_calendar_windows": (
        lambda m: m.posting.where("posted_at is not null").select("id", *(F.date_format(f, "yyyy-MM-dd HH:mm:ss").alias(k) for k, f in lookups.calendar_columns(c("posted_at")).items()), lookups.span_label(*lookups.week_before(c("posted_at"))).alias("label")),
        """SELECT id, strftime(w - INTERVAL 7 DAY - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS week_start, strftime(w - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS week_end, strftime(mo - INTERVAL 1 MONTH - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS month_start, strftime(mo - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS month_end,
 concat(strftime(w - INTERVAL 7 DAY, '%m/%d'), '~', strftime(w - INTERVAL 1 DAY, '%m/%d')) AS label FROM (SELECT id, date_trunc('week', posted_at + INTERVAL 9 HOUR) AS w, date_trunc('month', posted_at + INTERVAL 9 HOUR) AS mo FROM job_posting WHERE posted_at IS NOT NULL)""",
    ),
}


def _described(m: Market) -> DataFrame:
    return m.posting.withColumn("description", F.when(c("id") % 6 > 0, F.lit("text")))


QUERIES = {k: (lambda f: lambda spark, sf_dir: f(Market(spark, sf_dir)))(f) for k, (f, _) in FORMS.items()}
SQL = {k: expanded(sql) for k, (_, sql) in FORMS.items()}
