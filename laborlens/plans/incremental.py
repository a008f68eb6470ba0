"""Queries of backlogs, run logs, dates, structured data and windowed counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import dates, html, jsonld
from laborlens.functions.spread import spread
from laborlens.operators import backlog
from laborlens.sources.market import Market, expanded
from laborlens.streaming import crawl, windows

_STOP = ", ".join(f"'{w}'" for w in backlog.STOP_WORDS)
_LEVEL = "CASE id % 6 WHEN 0 THEN 'NO_EXPERIENCE' WHEN 1 THEN 'ENTRY_LEVEL' WHEN 2 THEN 'JUNIOR' WHEN 3 THEN 'MIDDLE' WHEN 4 THEN 'SENIOR' END"
_MAJORS = "SELECT id AS user_id, id % 5 AS field_id FROM company UNION SELECT id, nation_id % 5 FROM company WHERE id % 3 = 0"
_OWNED = "SELECT c.id AS user_id, s.id AS skill_id FROM company c JOIN skill s ON s.id % 9 = c.id % 9 WHERE c.id % 4 > 0"
_LOG = "SELECT user_id AS run_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' END AS status, CASE WHEN event_id % 3 > 0 THEN event_id % 100 END AS fetched, ts AS logged_at FROM events"
_STEPS = "SELECT user_id AS id, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'generating' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'weeks' END AS step, CAST(event_id % 4 AS BIGINT) AS weeks FROM events"


def terms(m: Market) -> DataFrame:
    known = m.alias.select(F.col("alias").alias("term")).union(m.skill.select("name"))
    return backlog.unmatched_terms(F.col("text"), m.view("documents"), known)


def logos(m: Market) -> DataFrame:
    companies = m.sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'x' END AS logo_url, CASE id % 4 WHEN 1 THEN '{}' WHEN 2 THEN '{\"logo_checked_at\": \"2001-05-01T00:00:00\"}' WHEN 3 THEN '{\"logo_checked_at\": \"2001-06-30T00:00:00\"}' END AS raw_fields FROM company")
    sources = m.sql("SELECT company_id, source, CASE WHEN id % 8 > 0 THEN id END AS source_company_id FROM job_posting")
    return backlog.missing_logos(companies, sources, "site_a", "2001-06-01T00:00:00")


def users(m: Market) -> DataFrame:
    who = m.sql(f"SELECT id, name, {_LEVEL} AS history FROM company")
    out = backlog.profiles(who, m.sql(_MAJORS), m.field, m.sql(_OWNED), m.skill)
    return out.select("id", "name", "career_level", F.array_join("fields", ",").alias("fields"), F.array_join("skills", ",").alias("skills"))


def runs(m: Market) -> DataFrame:
    return _shown(backlog.run_state(m.sql(_LOG)), "started_at", "finished_at")


def items(m: Market) -> DataFrame:
    row = "SELECT o_custkey AS roadmap_id, 1 AS week_no, 1 AS day_no, o_orderkey AS seq, o_orderpriority AS title, 'd' AS description, o_orderkey % 2 = 0 AS is_done FROM orders"
    old = m.sql(f"{row} WHERE o_orderkey % 3 > 0")
    new = m.sql(f"{row} WHERE o_orderkey % 3 < 2").select("roadmap_id", "week_no", "day_no", "seq", F.repeat("title", F.lit(40)).alias("title"), F.lit("e").alias("description"))
    return backlog.upsert_items(old, new).drop("week_no", "day_no")


def statuses(m: Market) -> DataFrame:
    maps = m.sql("SELECT id, 'pending' AS status, CAST(10 AS BIGINT) AS generated_weeks FROM company")
    return backlog.roadmap_status(maps, m.sql(_STEPS))


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def date_texts(m: Market) -> DataFrame:
    rows = m.sql("SELECT o_orderkey AS id, o_orderdate AS d FROM orders")
    as_of = F.lit("2001-12-01 03:00:00").cast("timestamp")
    text = lambda f: F.date_format("d", f)
    noted = F.concat(F.when(F.col("id") % 3 == 0, "수정일 ").otherwise("등록일 "), text("yy/MM/dd"))
    at = dates.date_time(F.when(F.col("id") % 2 == 0, text("yyyy.MM.dd HH:mm")).otherwise(text("yyyy-M-d")))
    out = rows.select("id", dates.deadline(F.concat(F.lit("~"), text("MM/dd"), F.lit("(금)")), as_of).alias("deadline"), F.when(F.year("d") >= 2000, dates.registered(noted)).alias("registered"), at.alias("at"), dates.not_future(F.col("d"), as_of).alias("known"))
    return _shown(out, "deadline", "registered", "at", "known")


def job_pages(m: Market) -> DataFrame:
    """Pages made from postings: the job object inside a graph, its salary by month or year, and two labelled values."""
    job = "concat('{\"@graph\": [{\"@type\": \"Thing\"}, {\"@type\": [\"JobPosting\"], \"title\": \"', title, '\", \"baseSalary\": {\"currency\": \"', CASE WHEN id % 10 = 0 THEN 'USD' ELSE 'KRW' END, '\", \"value\": {\"value\": ', coalesce(CAST(salary_min * 1000 AS STRING), '\"ask\"'), CASE WHEN id % 2 = 0 THEN ', \"unitText\": \"MONTH\"' ELSE '' END, '}}}]}')"
    return spread(m.posting.select("id", "title", "location", "salary_min"), "id").selectExpr("id", f"concat('<html><script type=\"application/ld+json\">', {job}, '</script><dl><dt>지역 :</dt><dd>', coalesce(location, ''), '</dd><dt>제목</dt><dd><b>', title, '</b></dd></dl></html>') AS html")


def structured(m: Market) -> DataFrame:
    rows = job_pages(m).select("id", html.body_of("html").alias("b"))
    return rows.select("id", F.get_json_object("b.job", "$.title").alias("title"), jsonld.salary_text(F.col("b.job")).alias("salary"), F.element_at("b.labels", "지역").alias("location"), F.element_at("b.labels", "제목").alias("label_title"))


def unseen(m: Market) -> DataFrame:
    listed = m.sql("SELECT source, id FROM job_posting WHERE id % 2 = 0")
    seen = m.sql("SELECT source, id, posted_at AS seen_at FROM job_posting WHERE id % 4 = 0")
    return crawl.unseen(listed, seen, ["source", "id"], "seen_at", F.lit("2000-01-01 00:00:00").cast("timestamp"))


_S = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
_BEGIN = "time_bucket(INTERVAL 1 HOUR, ts)"

TABLE = {
    "ana25_unmatched_body_terms": (terms, f"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '{backlog.TERM}'))) AS term FROM documents)
 SELECT term, count(*) AS n FROM w WHERE length(term) BETWEEN 3 AND 30 AND term NOT IN ({_STOP}) AND term NOT IN (SELECT lower(alias) FROM skill_alias) AND term NOT IN (SELECT lower(name) FROM skill) GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2 DESC, 1 LIMIT 200"""),
    "ana33_user_profile": (users, f"""SELECT c.id, c.name, CASE c.id % 6 WHEN 0 THEN 'newcomer' WHEN 1 THEN 'newcomer' WHEN 2 THEN 'junior' WHEN 3 THEN 'mid' WHEN 4 THEN 'senior' END AS career_level, coalesce(f.fields, '') AS fields, coalesce(s.skills, '') AS skills FROM company c
 LEFT JOIN (SELECT user_id, string_agg(code, ',' ORDER BY sort_order) AS fields FROM ({_MAJORS}) u JOIN tech_field t ON t.id = u.field_id GROUP BY 1) f ON f.user_id = c.id
 LEFT JOIN (SELECT user_id, string_agg(name, ',' ORDER BY name) AS skills FROM ({_OWNED}) o JOIN skill k ON k.id = o.skill_id GROUP BY 1) s ON s.user_id = c.id"""),
    "ana38_missing_logos": (logos, "SELECT c.id, min(p.id) AS source_company_id FROM company c JOIN job_posting p ON p.company_id = c.id WHERE c.id % 3 > 0 AND c.id % 4 < 3 AND p.source = 'site_a' AND p.id % 8 > 0 GROUP BY 1"),
    "mrg9_run_state": (runs, f"SELECT run_id, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status, arg_max(fetched, seq) FILTER (WHERE fetched IS NOT NULL) AS fetched, {_S('min(logged_at)')} AS started_at, {_S("max(logged_at) FILTER (WHERE status IN ('success', 'failed'))")} AS finished_at FROM ({_LOG}) GROUP BY 1"),
    "mrg12_roadmap_items": (items, "SELECT o_custkey AS roadmap_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 < 2 THEN left(repeat(o_orderpriority, 40), 200) ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 3 < 2 THEN 'e' ELSE 'd' END AS description, CASE WHEN o_orderkey % 3 = 0 THEN false ELSE o_orderkey % 2 = 0 END AS is_done FROM orders"),
    "mrg12_roadmap_status": (statuses, f"""WITH s AS ({_STEPS}), g AS (SELECT s.*, max(CASE WHEN step = 'generating' THEN seq END) OVER (PARTITION BY id) AS st FROM s)
 SELECT c.id, coalesce(arg_max(g.step, g.seq) FILTER (WHERE g.step <> 'weeks'), 'pending') AS status, CAST(CASE WHEN max(g.st) IS NULL THEN 10 ELSE 0 END + coalesce(sum(g.weeks) FILTER (WHERE g.step = 'weeks' AND (g.st IS NULL OR g.seq > g.st)), 0) AS BIGINT) AS generated_weeks FROM company c LEFT JOIN g ON g.id = c.id GROUP BY c.id"""),
    "tx22_dates": (date_texts, f"""SELECT o_orderkey AS id, {_S("CASE WHEN strftime(o_orderdate, '%m%d') = '0229' THEN NULL ELSE make_timestamp(CASE WHEN make_timestamp(2001, month(o_orderdate), day(o_orderdate), 14, 59, 59.0) < TIMESTAMP '2001-06-04 03:00:00' THEN 2002 ELSE 2001 END, month(o_orderdate), day(o_orderdate), 14, 59, 59.0) END")} AS deadline,
 CASE WHEN year(o_orderdate) >= 2000 AND o_orderkey % 3 > 0 THEN {_S("date_trunc('day', o_orderdate) - INTERVAL 9 HOUR")} END AS registered,
 {_S("CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('minute', o_orderdate) ELSE date_trunc('day', o_orderdate) END - INTERVAL 9 HOUR")} AS at, {_S("CASE WHEN o_orderdate <= TIMESTAMP '2001-12-01 03:00:00' THEN o_orderdate END")} AS known FROM orders"""),
    "tx17_tx19_tx23_structured": (structured, "SELECT id, title, CASE WHEN id % 10 > 0 AND salary_min * 1000 >= 10000 THEN concat(CASE WHEN id % 2 = 0 THEN '월 ' ELSE '' END, format('{:,}', salary_min * 1000 // 10000), '만원') END AS salary, location, title AS label_title FROM job_posting"),
    "st1_unseen": (unseen, "SELECT source, id FROM job_posting WHERE id % 2 = 0 AND NOT (id % 4 = 0 AND coalesce(posted_at >= TIMESTAMP '2000-01-01 00:00:00', false))"),
    "st16_tumbling": (lambda m: _shown(windows.tumbling(m.view("events"), "1 hour", ["event_type"]), "start", "end"), f"SELECT {_S(_BEGIN)} AS start, {_S(_BEGIN + ' + INTERVAL 1 HOUR')} AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL"),
    "st16_sliding": (lambda m: _shown(windows.sliding(m.view("events"), "1 hour", "30 minutes", ["event_type"]), "start", "end"), f"WITH b AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) SELECT {_S('s')} AS start, {_S('s + INTERVAL 1 HOUR')} AS \"end\", event_type, count(*) AS n FROM b GROUP BY ALL"),
    "st16_sessions": (lambda m: _shown(windows.sessions(m.view("events"), "6 hours", ["user_id"]), "start", "end"), f"WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT {_S('min(ts)')} AS start, {_S('max(ts) + INTERVAL 6 HOUR')} AS \"end\", user_id, count(*) AS n FROM b GROUP BY user_id, k"),
    "st10_seoul_days": (lambda m: _shown(windows.within_limit(windows.tumbling(m.view("events"), "1 day", ["user_id"], offset="15 hours"), 3), "start", "end"), f"SELECT {_S('d - INTERVAL 9 HOUR')} AS start, {_S('d + INTERVAL 15 HOUR')} AS \"end\", user_id, n, n <= 3 AS allowed FROM (SELECT date_trunc('day', ts + INTERVAL 9 HOUR) AS d, user_id, count(*) AS n FROM events GROUP BY ALL)"),
}

QUERIES = {k: (lambda f: lambda spark, sf_dir: f(Market(spark, sf_dir)))(f) for k, (f, _) in TABLE.items()}
SQL = {k: expanded(sql) for k, (_, sql) in TABLE.items()}
