"""Analytic queries with the parameters they are checked at, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators import analytics as A
from laborlens.operators import tools
from laborlens.operators.filters import Scope
from laborlens.operators.lookups import percent_rank
from laborlens.sources.market import AS_OF, Market, expanded

RECENT, PREVIOUS = ("2001-06-01 00:00:00", "2001-07-01 00:00:00"), ("2001-05-02 00:00:00", "2001-06-01 00:00:00")
SKILL = "brand#13"
COMPANY, OTHERS = 2, [2, 4, 7]
ASKED = ("customer#000000012", " Customer#00000001 ", "#000000099", "nobody", "  ")
# The last full week and the last two full months of Seoul before AS_OF, in UTC.
WEEK = ("2001-06-17 15:00:00", "2001-06-24 15:00:00")
MONTHS = (("2001-05-31 15:00:00", "2001-06-30 15:00:00"), ("2001-04-30 15:00:00", "2001-05-31 15:00:00"))
_RUNS = "SELECT finished_at, CASE WHEN id % 3 = 0 THEN 'crawl' ELSE 'embed' END AS kind FROM crawl_run"

_DEMAND = "('tag', 'required', 'preferred')"
_STRICT = "('tag', 'required')"
_CAREER = "(VALUES ('newcomer', 0, 0), ('junior', 1, 3), ('mid', 4, 7), ('senior', 8, 1000)) AS lv(level, low, high)"
_OVER = "coalesce(p.career_min, 0) <= lv.high AND (p.career_max IS NULL OR p.career_max >= lv.low)"


def _since(days: int, p: str = "p") -> str:
    return f"{p}.posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"


def _in(w: tuple[str, str], p: str = "p") -> str:
    return f"{p}.posted_at >= TIMESTAMP '{w[0]}' AND {p}.posted_at < TIMESTAMP '{w[1]}'"


def _asked(where: str, grades: str = _DEMAND, extra: str = "") -> str:
    return f"SELECT ps.posting_id, ps.skill_id, s.name, p.* FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id JOIN skill s ON s.id = ps.skill_id {extra} WHERE ps.requirement IN {grades} AND NOT s.is_common AND {where}"


_COUNTS = f"""SELECT a.name, count(DISTINCT CASE WHEN {_in(RECENT, 'a')} THEN a.posting_id END) AS recent,
 count(DISTINCT CASE WHEN {_in(PREVIOUS, 'a')} THEN a.posting_id END) AS previous FROM ({_asked(_in((PREVIOUS[0], RECENT[1])))}) a GROUP BY a.name"""


def _segments(segment: str, extra: str = "", where: str = "TRUE") -> str:
    return f"""SELECT *, max(postings) OVER (PARTITION BY segment) AS posting_count, CAST(0 AS DOUBLE) AS share FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY postings DESC, name) AS rank
 FROM (SELECT {segment} AS segment, s.name, count(DISTINCT ps.posting_id) AS postings FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id JOIN skill s ON s.id = ps.skill_id {extra}
 WHERE ps.requirement IN {_DEMAND} AND NOT s.is_common AND {_since(30)} AND {where} GROUP BY 1, 2) WHERE segment IS NOT NULL) WHERE rank <= 10"""


def _top_skills(ids: str, grades: str) -> str:
    return f"""SELECT company_id, rank, name, postings, round(postings / CAST(whole AS DOUBLE), 4) AS share FROM (SELECT t.*, w.whole, row_number() OVER (PARTITION BY t.company_id ORDER BY postings DESC, name) AS rank FROM
 (SELECT p.company_id, s.name, count(DISTINCT ps.posting_id) AS postings FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id JOIN skill s ON s.id = ps.skill_id
 WHERE p.company_id IN {ids} AND ps.requirement IN {grades} GROUP BY 1, 2) t JOIN (SELECT company_id, count(*) AS whole FROM job_posting GROUP BY 1) w ON w.company_id = t.company_id) WHERE rank <= 10"""


_STACK = f"""n AS (SELECT p.company_id, s.name, count(DISTINCT ps.posting_id) AS n FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id JOIN skill s ON s.id = ps.skill_id
 WHERE ps.requirement IN {_DEMAND} AND NOT s.is_common GROUP BY 1, 2), norms AS (SELECT company_id, sqrt(sum(n * n)) AS norm FROM n GROUP BY 1),
 stack AS (SELECT o.company_id, round(sum(o.n * t.n) / (min(a.norm) * min(b.norm)), 4) AS stack, array_to_string(list_slice(list(o.name ORDER BY o.n * t.n DESC, o.name), 1, 5), ',') AS shared
 FROM n o JOIN n t ON t.name = o.name AND t.company_id = {COMPANY} JOIN norms a ON a.company_id = o.company_id JOIN norms b ON b.company_id = {COMPANY} WHERE o.company_id <> {COMPANY} GROUP BY 1)"""
_SIM = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), {places})"
_TEXT = "coalesce(nullif(trim(c.description), ''), nullif(trim(c.business_content), ''), '')"
_NAMED = "lower(s.name) = 'brand#13' OR (NOT a.case_sensitive AND lower(a.alias) = 'brand#13') OR (a.case_sensitive AND a.alias = 'brand#13')"

# name: (Spark, SQL over the views)
TABLE = {
    "ana1_data_coverage": (lambda m: A.data_coverage(m), f"""SELECT CAST(CAST(min(posted_at) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(posted_at) AS DATE) AS VARCHAR) AS last_day, count(*) AS total,
 count(*) FILTER (WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}') AS active, round(count(*) FILTER (WHERE body_is_image) / CAST(count(*) AS DOUBLE), 4) AS image_share,
 round(count(*) FILTER (WHERE salary_type IN ('range', 'min_only', 'max_only')) / CAST(count(*) AS DOUBLE), 4) AS disclosure, count(*) FILTER (WHERE field_id IS NULL) AS unclassified, count(DISTINCT company_id) AS companies FROM job_posting"""),
    "ana1_coverage_breakdown": (lambda m: A.coverage_breakdown(m), "SELECT 'field' AS kind, f.code AS key, count(*) AS n FROM job_posting p JOIN tech_field f ON f.id = p.field_id GROUP BY 2 UNION ALL SELECT 'requirement', requirement, count(*) FROM posting_skill GROUP BY 2"),
    "ana1_last_crawl": (lambda m: A.data_coverage(m, runs=m.sql(_RUNS)).select("total", "last_crawl"), f"SELECT (SELECT count(*) FROM job_posting) AS total, strftime(max(finished_at), '%Y-%m-%d %H:%M:%S') AS last_crawl FROM ({_RUNS}) WHERE kind = 'crawl'"),
    "ana2_popular_skills": (lambda m: A.popular_skills(m), f"""WITH a AS ({_asked(_since(30))}), c AS (SELECT name, count(DISTINCT posting_id) AS postings FROM a GROUP BY 1), w AS (SELECT count(DISTINCT posting_id) AS analyzed FROM a),
 t AS (SELECT count(*) AS total FROM job_posting p WHERE {_since(30)}) SELECT CAST(row_number() OVER (ORDER BY postings DESC, name) AS INT) AS rank, name, postings, round(postings / CAST(analyzed AS DOUBLE), 4) AS share, analyzed, total FROM c, w, t ORDER BY postings DESC, name LIMIT 20"""),
    "ana2_popular_skills_scoped": (lambda m: A.popular_skills(m, Scope(field="asia", size_type="small", career="mid", days=365), top=5), f"""WITH f AS (SELECT p.* FROM job_posting p JOIN (SELECT * FROM {_CAREER}) lv ON lv.level = 'mid' AND {_OVER} WHERE {_since(365)}
 AND p.field_id IN (SELECT id FROM tech_field WHERE code = 'asia') AND p.company_id IN (SELECT id FROM company WHERE size_type = 'small')),
 a AS (SELECT ps.posting_id, s.name FROM posting_skill ps JOIN f ON f.id = ps.posting_id JOIN skill s ON s.id = ps.skill_id WHERE ps.requirement IN {_DEMAND} AND NOT s.is_common), c AS (SELECT name, count(DISTINCT posting_id) AS postings FROM a GROUP BY 1),
 w AS (SELECT count(DISTINCT posting_id) AS analyzed FROM a), t AS (SELECT count(*) AS total FROM f) SELECT CAST(row_number() OVER (ORDER BY postings DESC, name) AS INT) AS rank, name, postings, round(postings / CAST(analyzed AS DOUBLE), 4) AS share, analyzed, total FROM c, w, t ORDER BY postings DESC, name LIMIT 5"""),
    "ana3_resolve_skill_name": (lambda m: A.resolve_skill_name(m, SKILL), f"SELECT DISTINCT s.id, s.name FROM skill s LEFT JOIN skill_alias a ON a.skill_id = s.id WHERE {_NAMED} ORDER BY s.id LIMIT 1"),
    "ana4_resolve_skill": (lambda m: A.resolve_skill(m, 13), f"SELECT s.id, s.name, {_SIM.format(places=4)} AS similarity FROM embeddings e JOIN skill s ON s.id = e.vec_id, embeddings q WHERE q.vec_id = 13 ORDER BY similarity DESC, s.id LIMIT 5"),
    "ana5_skill_demand": (lambda m: A.skill_demand(m, SKILL), f"""WITH x AS (SELECT ps.posting_id, ps.requirement, p.* FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id WHERE ps.requirement IN {_DEMAND} AND ps.skill_id = 13)
 SELECT 'total' AS kind, '' AS key, count(DISTINCT posting_id) AS n FROM x UNION ALL SELECT 'field', f.code, count(DISTINCT posting_id) FROM x JOIN tech_field f ON f.id = x.field_id GROUP BY 2
 UNION ALL SELECT 'size', c.size_type, count(DISTINCT posting_id) FROM x JOIN company c ON c.id = x.company_id GROUP BY 2 UNION ALL SELECT 'career', lv.level, count(DISTINCT p.posting_id) FROM x p JOIN {_CAREER} ON {_OVER} GROUP BY 2
 UNION ALL SELECT 'grade', requirement, count(*) FROM x GROUP BY 2"""),
    "ana6_rising_skills": (lambda m: A.rising_skills(m, RECENT, PREVIOUS), f"""SELECT CAST(row_number() OVER (ORDER BY score DESC, name) AS INT) AS rank, name, recent, previous, growth FROM (SELECT *, (recent + 20) / CAST(previous + 20 AS DOUBLE) AS score, round(recent / CAST(previous AS DOUBLE) - 1, 4) AS growth
 FROM ({_COUNTS}) WHERE recent >= 5 AND previous > 0 AND recent + previous >= 20) ORDER BY score DESC, name LIMIT 10"""),
    "ana7_new_skills": (lambda m: A.new_skills(m, ("2001-06-30 00:00:00", "2001-07-01 00:00:00"), ("2001-06-29 00:00:00", "2001-06-30 00:00:00")), f"""WITH c AS (SELECT a.name, count(DISTINCT CASE WHEN a.posted_at >= TIMESTAMP '2001-06-30 00:00:00' THEN a.posting_id END) AS recent,
 count(DISTINCT CASE WHEN a.posted_at < TIMESTAMP '2001-06-30 00:00:00' THEN a.posting_id END) AS previous FROM ({_asked(_in(('2001-06-29 00:00:00', '2001-07-01 00:00:00')))}) a GROUP BY 1),
 w AS (SELECT count(*) AS whole FROM job_posting p WHERE {_in(('2001-06-30 00:00:00', '2001-07-01 00:00:00'))}) SELECT CAST(row_number() OVER (ORDER BY recent DESC, name) AS INT) AS rank, name, recent, round(recent / CAST(whole AS DOUBLE), 4) AS share FROM c, w WHERE recent >= 1 AND previous = 0 ORDER BY recent DESC, name LIMIT 10"""),
    "ana8_rising_totals": (lambda m: A.rising_totals(m, RECENT, PREVIOUS), f"SELECT recent, previous, least(recent, previous) < 100 AS low_confidence FROM (SELECT count(*) FILTER (WHERE {_in(RECENT)}) AS recent, count(*) FILTER (WHERE {_in(PREVIOUS)}) AS previous FROM job_posting p)"),
    "ana9_stacks_by_size": (lambda m: A.stacks_by_segment(m, "size"), _segments("c.size_type", "JOIN company c ON c.id = p.company_id")),
    "ana9_stacks_by_location": (lambda m: A.stacks_by_segment(m, "location"), _segments("split_part(p.location, ' ', 1)", where="p.location IS NOT NULL")),
    "ana10_stacks_by_career": (lambda m: A.stacks_by_segment(m, "career"), _segments("lv.level", f"JOIN {_CAREER} ON {_OVER}")),
    "ana11_salary_stats": (lambda m: A.salary_stats(m, Scope(career="junior"), SKILL), f"""WITH f AS (SELECT CASE WHEN p.salary_type IN ('range', 'min_only') THEN coalesce(p.salary_min, p.salary_max) END AS amount FROM job_posting p JOIN {_CAREER} ON lv.level = 'junior' AND {_OVER} WHERE p.id IN (SELECT posting_id FROM posting_skill WHERE skill_id = 13))
 SELECT CAST(trunc(quantile_cont(amount, 0.5)) AS INT) AS median, CAST(trunc(quantile_cont(amount, 0.25)) AS INT) AS q1, CAST(trunc(quantile_cont(amount, 0.75)) AS INT) AS q3, min(amount) AS low, max(amount) AS high, count(amount) AS sample, round(count(amount) / CAST(count(*) AS DOUBLE), 4) AS disclosure, count(amount) < 10 AS low_confidence FROM f"""),
    "ana12_related_skills": (lambda m: A.related_skills(m, SKILL, Scope(days=365)), f"""WITH a AS (SELECT * FROM posting_skill WHERE requirement IN {_DEMAND}), b AS (SELECT DISTINCT posting_id FROM a WHERE skill_id = 13), u AS (SELECT count(*) AS universe FROM a JOIN job_posting p ON p.id = a.posting_id WHERE {_since(365)}), bm AS (SELECT count(*) AS mine FROM b),
 bo AS (SELECT skill_id, count(DISTINCT posting_id) AS both_ FROM a WHERE skill_id <> 13 AND posting_id IN (SELECT posting_id FROM b) GROUP BY 1 HAVING count(DISTINCT posting_id) >= 3), t AS (SELECT skill_id, count(DISTINCT posting_id) AS theirs FROM a GROUP BY 1),
 x AS (SELECT s.name, both_, round(ln((both_ / CAST(universe AS DOUBLE)) / ((mine / CAST(universe AS DOUBLE)) * (theirs / CAST(universe AS DOUBLE)))) / -ln(both_ / CAST(universe AS DOUBLE)), 4) AS npmi FROM bo JOIN t ON t.skill_id = bo.skill_id JOIN skill s ON s.id = bo.skill_id, u, bm)
 SELECT CAST(row_number() OVER (ORDER BY npmi DESC, both_ DESC, name) AS INT) AS rank, name, both_ AS "both", npmi FROM x ORDER BY npmi DESC, both_ DESC, name LIMIT 10"""),
    "ana13_company_top_skills": (lambda m: A.company_top_skills(m, OTHERS, ("tag", "required", "preferred", "body")), _top_skills("(2, 4, 7)", "('tag', 'required', 'preferred', 'body')")),
    "ana14_company_lookup": (lambda m: A.company_lookup(m, " CUSTOMER#00000000 "), "SELECT c.id, c.name, coalesce(n, 0) AS postings FROM company c LEFT JOIN (SELECT company_id, count(*) AS n FROM job_posting GROUP BY 1) p ON p.company_id = c.id WHERE c.name ILIKE '%CUSTOMER#00000000%' ORDER BY postings DESC, c.name LIMIT 20"),
    "ana14_company_verdicts": (lambda m: _verdicts(m), f"""WITH q(asked) AS (VALUES {", ".join(f"('{x}')" for x in ASKED)}), n AS (SELECT company_id, count(*) AS n FROM job_posting GROUP BY 1),
 h AS (SELECT asked, c.id, c.name, coalesce(n.n, 0) AS postings, row_number() OVER (PARTITION BY asked ORDER BY coalesce(n.n, 0) DESC, c.name) AS r, lower(trim(c.name)) = lower(trim(asked)) AS whole FROM q JOIN company c ON trim(asked) <> '' AND c.name ILIKE '%' || trim(asked) || '%' LEFT JOIN n ON n.company_id = c.id),
 t AS (SELECT *, count(*) OVER (PARTITION BY asked) AS n, min(CASE WHEN whole THEN r END) OVER (PARTITION BY asked) AS one FROM h WHERE r <= 20)
 SELECT q.asked, CASE WHEN t.id IS NULL THEN 'not_found' WHEN one IS NOT NULL OR n = 1 THEN 'found' ELSE 'ambiguous' END AS status, t.id AS company_id, t.name, t.postings FROM q LEFT JOIN t ON t.asked = q.asked AND (one IS NULL OR one = r)"""),
    "ana15_company_profile": (lambda m: A.company_profile(m, COMPANY), f"""SELECT 'career' AS kind, lv.level AS key, count(p.id) AS n FROM {_CAREER} LEFT JOIN job_posting p ON p.company_id = {COMPANY} AND {_OVER} GROUP BY 2
 UNION ALL SELECT 'region', split_part(location, ' ', 1), count(*) FROM job_posting WHERE company_id = {COMPANY} AND location IS NOT NULL GROUP BY 2 UNION ALL SELECT 'text', coalesce(nullif(trim(description), ''), nullif(trim(business_content), '')), 1 FROM company WHERE id = {COMPANY}"""),
    "ana16_compare_companies": (lambda m: A.compare_companies(m, [2, 4]), f"SELECT name FROM ({_top_skills('(2, 4)', _STRICT)}) GROUP BY name HAVING count(DISTINCT company_id) = 2"),
    "ana17_similar_companies": (lambda m: A.similar_companies(m, COMPANY), f"""WITH {_STACK}, near AS (SELECT e.vec_id AS company_id, {_SIM.format(places=6)} AS likeness FROM embeddings e JOIN company c ON c.id = e.vec_id, embeddings q WHERE q.vec_id = {COMPANY} AND e.vec_id <> {COMPANY}), d AS (SELECT company_id, percent_rank() OVER (ORDER BY likeness) AS description FROM near),
 x AS (SELECT c.id AS company_id, c.name, coalesce(s.stack, 0.0) AS stack, coalesce(d.description, 0.5) AS description, CASE WHEN coalesce(c.employee_count, 0) > 0 AND coalesce(t.employee_count, 0) > 0 THEN greatest(0.0, 1 - abs(log10(c.employee_count) - log10(t.employee_count)) / 3)
 ELSE 1 - abs(list_position(['startup', 'small', 'medium', 'large', 'enterprise'], c.size_type) - list_position(['startup', 'small', 'medium', 'large', 'enterprise'], t.size_type)) / 4.0 END AS size FROM company c LEFT JOIN stack s ON s.company_id = c.id LEFT JOIN d ON d.company_id = c.id, (SELECT * FROM company WHERE id = {COMPANY}) t WHERE s.company_id IS NOT NULL OR d.company_id IS NOT NULL),
 y AS (SELECT company_id, name, round((CAST(0.5 AS DOUBLE) * stack + CAST(0.35 AS DOUBLE) * description + CAST(0.15 AS DOUBLE) * size) / (CAST(0.5 AS DOUBLE) + CAST(0.35 AS DOUBLE) + CAST(0.15 AS DOUBLE)), 4) AS score, CAST(stack AS DOUBLE) AS stack FROM x)
 SELECT *, CAST(row_number() OVER (ORDER BY score DESC, stack DESC, name) AS INT) AS rank FROM y ORDER BY score DESC, stack DESC, name LIMIT 5"""),
    "ana18_stack_cosine": (lambda m: A.stack_cosine(m, COMPANY), f"WITH {_STACK} SELECT * FROM stack"),
    "ana19_percentile_rank": (lambda m: _percentiles(m), "SELECT c_custkey AS id, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 500)), 6) AS pr FROM customer"),
    "ana20_size_proximity": (lambda m: _proximity(m), f"""SELECT c.id, round(CASE WHEN coalesce(c.employee_count, 0) > 0 AND coalesce(t.employee_count, 0) > 0 THEN greatest(0.0, 1 - abs(log10(c.employee_count) - log10(t.employee_count)) / 3)
 ELSE 1 - abs(list_position(['startup', 'small', 'medium', 'large', 'enterprise'], c.size_type) - list_position(['startup', 'small', 'medium', 'large', 'enterprise'], t.size_type)) / 4.0 END, 6) AS near FROM company c, company t WHERE t.id = {COMPANY}"""),
    "ana21_search_companies": (lambda m: A.search_companies(m, 5, "small"), f"""SELECT c.id, c.name, left({_TEXT}, 200) AS evidence, {_SIM.format(places=4)} AS similarity, (SELECT count(*) FROM job_posting p WHERE p.company_id = c.id) AS postings FROM company c JOIN embeddings e ON e.vec_id = c.id, embeddings q WHERE q.vec_id = 5 AND c.size_type = 'small' ORDER BY similarity DESC, c.id LIMIT 10"""),
    "ana21_search_companies_of_field": (lambda m: A.search_companies(m, 9, top=15, field="europe"), f"""SELECT c.id, c.name, left({_TEXT}, 200) AS evidence, {_SIM.format(places=4)} AS similarity, (SELECT count(*) FROM job_posting p WHERE p.company_id = c.id) AS postings FROM company c JOIN embeddings e ON e.vec_id = c.id, embeddings q
 WHERE q.vec_id = 9 AND c.id IN (SELECT p.company_id FROM job_posting p JOIN tech_field f ON f.id = p.field_id WHERE f.code = 'europe') ORDER BY similarity DESC, c.id LIMIT 15"""),
    "ana22_search_postings_filtered": (lambda m: A.search_postings(m, 7, top=5, active_only=False, field="asia", career_max=3), f"""WITH h AS (SELECT p.id, p.company_id, trim(p.title) AS title, CAST(e.label % 3 AS INT) AS section, {_SIM.format(places=4)} AS similarity FROM embeddings e JOIN job_posting p ON p.id = e.vec_id JOIN tech_field f ON f.id = p.field_id AND f.code = 'asia', embeddings q
 WHERE q.vec_id = 7 AND coalesce(p.career_min, 0) <= 3 ORDER BY similarity DESC, p.id LIMIT 20) SELECT id, company_id, title, section, similarity FROM (SELECT *, row_number() OVER (PARTITION BY company_id, title ORDER BY similarity DESC, id) AS r FROM h) WHERE r = 1 ORDER BY similarity DESC, id LIMIT 5"""),
    "ana22_search_postings": (lambda m: A.search_postings(m, 7), f"""WITH h AS (SELECT p.id, p.company_id, trim(p.title) AS title, CAST(e.label % 3 AS INT) AS section, {_SIM.format(places=4)} AS similarity FROM embeddings e JOIN job_posting p ON p.id = e.vec_id, embeddings q WHERE q.vec_id = 7 AND (p.expires_at IS NULL OR p.expires_at >= TIMESTAMP '{AS_OF}') ORDER BY similarity DESC, p.id LIMIT 40)
 SELECT id, company_id, title, section, similarity FROM (SELECT *, row_number() OVER (PARTITION BY company_id, title ORDER BY similarity DESC, id) AS r FROM h) WHERE r = 1 ORDER BY similarity DESC, id LIMIT 10"""),
    "ana23_skill_gap": (lambda m: A.skill_gap(m, ["Brand#11", "brand#22", "Brand#35"], top=12), f"""WITH c AS (SELECT skill_id, name, count(DISTINCT posting_id) AS postings FROM ({_asked(_since(90), _STRICT)}) GROUP BY 1, 2 ORDER BY postings DESC, name LIMIT (12 + (SELECT count(*) FROM skill WHERE lower(name) IN ('brand#11', 'brand#22', 'brand#35')))), o AS (SELECT *, lower(name) IN ('brand#11', 'brand#22', 'brand#35') AS owned FROM c)
 SELECT name, postings, owned, round((SELECT sum(postings) FROM o WHERE owned) / CAST((SELECT sum(postings) FROM o) AS DOUBLE), 4) AS coverage FROM o ORDER BY owned, postings DESC, name LIMIT 12"""),
    "ana23_missing_skills": (lambda m: tools.analyze_skill_gap(m, ["Brand#13", "brand 14", "B16", "nobody knows"], career="mid", top=6).rows, f"""WITH a AS ({_asked(_since(90), _STRICT, f"JOIN {_CAREER} ON lv.level = 'mid' AND {_OVER}")}), c AS (SELECT skill_id, name, count(DISTINCT posting_id) AS postings FROM a GROUP BY 1, 2 ORDER BY postings DESC, name LIMIT 9), o AS (SELECT *, skill_id IN (13, 14, 16) AS owned FROM c), n AS (SELECT count(DISTINCT posting_id) AS analyzed FROM a)
 SELECT CAST(row_number() OVER (ORDER BY postings DESC, name) AS INT) AS rank, name, postings, round(postings / CAST(analyzed AS DOUBLE), 4) AS share, analyzed, coalesce(round((SELECT sum(postings) FROM o WHERE owned) / CAST((SELECT sum(postings) FROM o) AS DOUBLE), 4), 0) AS coverage FROM o, n WHERE NOT owned ORDER BY postings DESC, name LIMIT 6"""),
    "ana23_missing_at_companies": (lambda m: A.missing_skills(m, ["Brand#11"], Scope(), 10, [2, 4, 7]), f"""WITH a AS ({_asked("p.company_id IN (2, 4, 7)", _STRICT)}), c AS (SELECT skill_id, name, count(DISTINCT posting_id) AS postings FROM a GROUP BY 1, 2 ORDER BY postings DESC, name LIMIT 11), o AS (SELECT *, skill_id = 11 AS owned FROM c), n AS (SELECT count(DISTINCT posting_id) AS analyzed FROM a)
 SELECT CAST(row_number() OVER (ORDER BY postings DESC, name) AS INT) AS rank, name, postings, round(postings / CAST(analyzed AS DOUBLE), 4) AS share, analyzed, coalesce(round((SELECT sum(postings) FROM o WHERE owned) / CAST((SELECT sum(postings) FROM o) AS DOUBLE), 4), 0) AS coverage FROM o, n WHERE NOT owned ORDER BY postings DESC, name LIMIT 10"""),
    "tool_popular_skills_of_week": (lambda m: tools.popular_skills(m, period="week"), f"""WITH a AS ({_asked(_in(WEEK))}), c AS (SELECT name, count(DISTINCT posting_id) AS postings FROM a GROUP BY 1), w AS (SELECT count(DISTINCT posting_id) AS analyzed FROM a),
 t AS (SELECT count(*) AS total FROM job_posting p WHERE {_in(WEEK)}) SELECT CAST(row_number() OVER (ORDER BY postings DESC, name) AS INT) AS rank, name, postings, round(postings / CAST(analyzed AS DOUBLE), 4) AS share, analyzed, total FROM c, w, t ORDER BY postings DESC, name LIMIT 10"""),
    "tool_rising_totals_of_month": (lambda m: tools.rising_skills(m, period="month")["totals"], f"SELECT recent, previous, least(recent, previous) < 100 AS low_confidence FROM (SELECT count(*) FILTER (WHERE {_in(MONTHS[0])}) AS recent, count(*) FILTER (WHERE {_in(MONTHS[1])}) AS previous FROM job_posting p)"),
    "tool_compare_companies": (lambda m: tools.compare_companies(m, ["customer#000000002", "nobody", " Customer#000000004 "]).rows, f"SELECT company_id, CAST(rank AS INT) AS rank, name, postings, share, count(*) OVER (PARTITION BY name) = 2 AS shared FROM ({_top_skills('(2, 4)', _STRICT)}) t"),
    "ana28_roadmap_demand": (lambda m: A.roadmap_demand(m, "asia"), f"""WITH p AS (SELECT p.* FROM job_posting p JOIN tech_field f ON f.id = p.field_id WHERE f.code = 'asia' AND {_since(90)}), w AS (SELECT count(*) AS whole FROM p), c AS (SELECT ps.skill_id, s.name, count(DISTINCT ps.posting_id) AS postings FROM posting_skill ps JOIN p ON p.id = ps.posting_id
 JOIN skill s ON s.id = ps.skill_id JOIN skill_field sf ON sf.skill_id = s.id JOIN tech_field f ON f.id = sf.field_id AND f.code = 'asia' WHERE ps.requirement IN {_DEMAND} AND NOT s.is_common GROUP BY 1, 2)
 SELECT CAST(row_number() OVER (ORDER BY postings DESC, name) AS INT) AS rank, skill_id, name, postings, round(postings / CAST(whole AS DOUBLE), 4) AS share FROM c, w ORDER BY postings DESC, name LIMIT 15"""),
    "ana29_roadmap_companions": (lambda m: A.roadmap_companions(m, [11, 22]), f"""WITH a AS ({_asked(_since(90))}), m AS (SELECT ps.posting_id, ps.skill_id AS anchor FROM posting_skill ps JOIN job_posting p ON p.id = ps.posting_id WHERE ps.requirement IN {_DEMAND} AND ps.skill_id IN (11, 22) AND {_since(90)}),
 c AS (SELECT m.anchor, a.name, count(DISTINCT a.posting_id) AS postings FROM m JOIN a ON a.posting_id = m.posting_id AND a.skill_id NOT IN (11, 22) GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY anchor ORDER BY postings DESC, name) AS INT) AS rank FROM c) WHERE rank <= 5"""),
    "ana30_roadmap_gaps": (lambda m: A.roadmap_gaps(m, [11, 22, 33]), f"""WITH c AS (SELECT skill_id, name, count(DISTINCT posting_id) AS postings FROM ({_asked(_since(90))}) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (ORDER BY postings DESC, name) AS INT) AS rank FROM c) SELECT rank, name, postings FROM r WHERE rank <= 15 AND skill_id NOT IN (11, 22, 33) ORDER BY rank LIMIT 10"""),
}


def _percentiles(m: Market):
    rows = m.sql("SELECT c_custkey AS id, c_nationkey, floor(c_acctbal / 500) AS v FROM customer")
    return percent_rank(rows, "v", ["c_nationkey"]).select("id", F.round("percent_rank", 6).alias("pr"))


def _verdicts(m: Market):
    return reduce(DataFrame.union, (A.company_verdict(m, x).select(F.lit(x).alias("asked"), "status", "company_id", "name", "postings") for x in ASKED))


def _proximity(m: Market):
    target = m.company.where(F.col("id") == COMPANY).select(F.col("employee_count").alias("e"), F.col("size_type").alias("s"))
    near = A.size_proximity(F.col("employee_count"), F.col("e"), F.col("size_type"), F.col("s"))
    return m.company.join(F.broadcast(target)).select("id", F.round(near, 6).alias("near"))


QUERIES = {k: (lambda f: lambda spark, sf_dir: f(Market(spark, sf_dir)))(f) for k, (f, _) in TABLE.items()}
SQL = {k: expanded(sql) for k, (_, sql) in TABLE.items()}
