"""Text, merge and chunk queries: texts are made from numbers, so that SQL over the numbers tells what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import charts, skills, text
from laborlens.functions.spread import spread
from laborlens.operators import chunks, merge
from laborlens.sources import payloads
from laborlens.sources.market import Market, expanded

_PAY = "SELECT o_orderkey AS id, CAST(o_orderkey % 6 AS INT) AS k, CAST(1000 + o_orderkey % 5000 AS INT) AS n FROM orders"
_YEARS = "SELECT o_orderkey AS id, CAST(o_orderkey % 6 AS INT) AS k, CAST(1 + o_orderkey % 9 AS INT) AS n FROM orders"
_CATEGORIES = ("백엔드 개발자", "게임 서버 개발자", "인공지능 연구", "안드로이드", "정보보안", "개발 PM")
_FIELDS = ("backend", "game", "data_ai", "mobile", "security", None)


def _case(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


def salary(m: Market) -> DataFrame:
    raw = "CASE k WHEN 0 THEN concat(n, '~', n + 500, '만원') WHEN 1 THEN concat(n, '만원 이상') WHEN 2 THEN concat(n, '만 원 이하') WHEN 3 THEN concat('월 ', n, '만원') WHEN 4 THEN '회사내규에 따름' ELSE '$80,000' END"
    return m.sql(_PAY).withColumn("s", text.salary(F.expr(raw))).select("id", "s.*")


def career(m: Market) -> DataFrame:
    raw = "CASE k WHEN 0 THEN '경력 무관' WHEN 1 THEN concat('경력 ', n, '~', n + 3, '년') WHEN 2 THEN concat(n, '년 이상') WHEN 3 THEN '신입' WHEN 4 THEN concat(n + 4, '-', n, '년') ELSE concat('경력 ', n, '년') END"
    return m.sql(_YEARS).withColumn("c", text.career(F.expr(raw))).select("id", F.col("c.low").alias("low"), F.col("c.high").alias("high"))


def numbers(m: Market) -> DataFrame:
    made = m.sql("SELECT o_orderkey AS id, o_orderkey % 3 AS k, o_orderkey % 70000 AS n FROM orders").withColumn("e", F.concat("n", F.lit(" 명")))
    made = made.withColumn("r", F.expr("CASE k WHEN 0 THEN concat('매출 ', n, '억 원') WHEN 1 THEN concat('2조 ', n, '억 5만원') ELSE '비공개' END"))
    return made.select("id", text.employee_count(F.col("e")).alias("employees"), text.revenue(F.col("r")).alias("revenue"))


def company_keys(m: Market) -> DataFrame:
    name = F.expr("CASE id % 3 WHEN 0 THEN concat('(주)', name, ' (Alias)') WHEN 1 THEN concat('주식회사 ', name) ELSE concat(name, '㈜') END")
    return m.company.select("id", text.company_key(name).alias("key"), text.company_size(F.col("employee_count"), F.array(F.lit(" 스타트업 "))).alias("size"))


def fields(m: Market) -> DataFrame:
    names = F.array(*(F.lit(c) for c in _CATEGORIES))
    one, two = (F.element_at(names, (F.col("id") % n + 1).cast("int")) for n in (6, 5))
    p = m.posting.select("id")
    return p.select("id", text.tech_field(F.array(one, two), F.lit("Python 백엔드 개발자")).alias("field"))


def bodies(m: Market) -> DataFrame:
    """A posting for each of posting_skill: its tags, and a body with one header for each grade below."""
    line = F.array_repeat(F.concat(F.col("name"), F.lit(" 개발 경험")), F.col("mentions").cast("int"))
    rows = spread(m.posting_skill.join(m.skill.select(F.col("id").alias("skill_id"), "name"), "skill_id"), "posting_id")
    of = lambda g: F.array_sort(F.flatten(F.collect_list(F.when(F.col("requirement") == g, line))))
    tags = F.flatten(F.collect_list(F.when(F.col("requirement") == "tag", F.array_repeat("name", F.col("mentions").cast("int")))))
    rows = rows.groupBy(F.col("posting_id").alias("id")).agg(tags.alias("tags"), *(of(g).alias(g) for g in ("body", "required", "preferred")))
    block = lambda h, g: F.concat(F.lit(h + "\n"), F.array_join(g, "\n"), F.lit("\n"))
    return rows.select("id", "tags", F.concat(block("소개", "body"), block("[자격요건]", "required"), block("[우대사항]", "preferred"), F.lit("[복리후생]\nBrand#11 개발")).alias("description"))


def round_trip(m: Market) -> DataFrame:
    """Skills from texts that were made from posting_skill."""
    known = m.skill.select("id", "name").orderBy("id").collect()
    words = [skills.Skill(r["id"], aliases=(r["name"],), ambiguous=r["id"] % 2 == 0) for r in known]
    return skills.graded(bodies(m), words).select("posting_id", "skill_id", "requirement", "mentions")


def chunk_rows(m: Market) -> DataFrame:
    return chunks.chunks(bodies(m)).groupBy("posting_id", "section").agg(F.count("*").alias("chunks"), F.min("seq").alias("first_seq"))


def long_chunks(m: Market) -> DataFrame:
    """Sections of up to 39 lines of 100 characters, of which eleven fit a chunk."""
    rows = spread(m.posting.select("id"), "id").select("id", F.concat(F.lit("[자격요건]\n"), F.repeat(F.lit("x" * 100 + "\n"), (F.col("id") % 40).cast("int"))).alias("description"))
    first = F.min(F.when(F.col("seq") == 0, F.col("chunk_hash")))
    return chunks.chunks(rows).groupBy("posting_id").agg(F.count("*").alias("chunks"), F.max("seq").alias("last_seq"), F.sum("token_count").alias("tokens"), first.alias("first_hash"))


def posting_merge(m: Market) -> DataFrame:
    p = m.posting.select("source", F.col("id").alias("source_job_id"), "title", "salary_min", "location", "content_hash", "embed_hash")
    new = p.where("source_job_id % 2 = 0").select("source", "source_job_id", F.concat("title", F.lit("!")).alias("title"), F.lit(None).cast("int").alias("salary_min"), F.lit("X").alias("location"), F.lit("n").alias("content_hash"))
    fresh = p.where("source_job_id % 10 = 1").select("source", (F.col("source_job_id") + 10_000_000).alias("source_job_id"), "title", "salary_min", "location", "content_hash")
    return merge.upsert_postings(p, new.unionByName(fresh))


def company_merge(m: Market) -> DataFrame:
    old = m.company.select(F.lower("name").alias("name_key"), "name", "employee_count", "size_type")
    new = old.where("length(name) > 0").select("name_key", F.concat("name", F.lit(" Inc")).alias("name"), F.lit(None).cast("int").alias("employee_count"), F.when(F.col("employee_count") > 5000, "large").otherwise("unknown").alias("size_type"))
    return merge.upsert_companies(old, new)


def children(m: Market) -> DataFrame:
    new = m.skill.where("id % 2 = 0").select(F.col("id").alias("skill_id"), F.concat(F.lit("new "), F.col("id").cast("string")).alias("alias"), F.lit(False).alias("case_sensitive"))
    return merge.replace_children(m.alias, new, "skill_id", ["skill_id", "alias"])


def embed_actions(m: Market) -> DataFrame:
    stored = m.vectors.where("vec_id % 5 <> 0").selectExpr("vec_id AS posting_id", "'required' AS section", "label AS seq", "concat('h', vec_id) AS chunk_hash", "vec_id % 7 <> 0 AS has_vector")
    fresh = m.vectors.where("vec_id % 4 <> 0").selectExpr("vec_id AS posting_id", "'required' AS section", "label AS seq", "CASE WHEN vec_id % 3 = 0 THEN 'changed' ELSE concat('h', vec_id) END AS chunk_hash")
    return chunks.embed_plan(stored, fresh).groupBy("action").agg(F.count("*").alias("n"))


# Every tag, but those inside a line too, begins a line; what stands in boilerplate goes. No class or id of these pages is boilerplate's.
_LINES = """regexp_split_to_array(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<footer.*$|<!--.*?-->', chr(10), 'gis'), '<[a-zA-Z/!][^>]*>', chr(10), 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[\\n\\r\\x0b\\x0c]')"""
_PAGE_TEXT = f"""SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> ''), '') AS text, CAST(0 AS INT) AS images
 FROM (SELECT page_id, i, trim(regexp_replace(line, '[ \\t\\x{{A0}}\\x{{200B}}]+', ' ', 'g')) AS line FROM (SELECT page_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM pages)) GROUP BY page_id"""

TABLE = {
    "tx10_salary": (salary, f"""SELECT id, CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 3 THEN CASE WHEN n <= 10000 THEN n * 12 END END AS low, CASE k WHEN 0 THEN n + 500 WHEN 2 THEN n WHEN 3 THEN CASE WHEN n <= 10000 THEN n * 12 END END AS high,
 CASE k WHEN 0 THEN 'range' WHEN 1 THEN 'min_only' WHEN 2 THEN 'max_only' WHEN 3 THEN 'range' WHEN 4 THEN 'negotiable' ELSE 'unknown' END AS kind, CASE WHEN k <= 2 THEN 'annual' WHEN k = 3 THEN 'monthly' END AS period FROM ({_PAY})"""),
    "tx12_career": (career, f"SELECT id, CASE k WHEN 3 THEN 0 WHEN 0 THEN NULL ELSE n END AS low, CASE k WHEN 1 THEN n + 3 WHEN 3 THEN 0 WHEN 4 THEN n + 4 END AS high FROM ({_YEARS})"),
    "tx13_tx14_numbers": (numbers, "SELECT id, CASE WHEN n BETWEEN 1 AND 50000 THEN CAST(n AS INT) END AS employees, CASE k WHEN 0 THEN nullif(n * 100000000, 0) WHEN 1 THEN 2000000000000 + n * 100000000 + 50000 END AS revenue FROM (SELECT o_orderkey AS id, o_orderkey % 3 AS k, o_orderkey % 70000 AS n FROM orders)"),
    "tx7_tx9_company_key_and_size": (company_keys, "SELECT id, lower(name) AS key, CASE WHEN employee_count >= 1000 THEN 'enterprise' WHEN employee_count >= 300 THEN 'large' WHEN employee_count >= 100 THEN 'medium' WHEN employee_count >= 30 THEN 'small' ELSE 'startup' END AS size FROM company"),
    "tx8_tech_field": (fields, f"SELECT id, CASE WHEN a IS NULL THEN coalesce(b, 'backend') WHEN b IS NULL THEN a WHEN a = b THEN a WHEN 'backend' IN (a, b) THEN 'backend' END AS field FROM (SELECT id, {_case('id % 6', _FIELDS)} AS a, {_case('id % 5', _FIELDS[:5])} AS b FROM job_posting)"),
    "tx6_skill_round_trip": (round_trip, "SELECT posting_id, skill_id, requirement, mentions FROM posting_skill"),
    "tx28_chunks": (chunk_rows, None),
    "tx28_long_chunks": (
        long_chunks,
        """SELECT id AS posting_id, n AS chunks, CAST(n - 1 AS INT) AS last_seq, 101 * k - n AS tokens, sha256(concat('required', chr(31), rtrim(repeat(concat(repeat('x', 100), ' '), CASE WHEN k < 12 THEN k ELSE 11 END)))) AS first_hash
 FROM (SELECT id, k, CASE WHEN k < 12 THEN 1 ELSE (k + 10) // 11 END AS n FROM (SELECT id, id % 40 AS k FROM job_posting) WHERE k > 0)""",
    ),
    "mrg1_posting_upsert": (posting_merge, """SELECT source, id AS source_job_id, CASE WHEN id % 2 = 0 THEN concat(title, '!') ELSE title END AS title, salary_min, CASE WHEN id % 2 = 0 THEN 'X' ELSE location END AS location,
 CASE WHEN id % 2 = 0 THEN 'n' ELSE content_hash END AS content_hash, embed_hash FROM job_posting UNION ALL SELECT source, id + 10000000, title, salary_min, location, content_hash, NULL FROM job_posting WHERE id % 10 = 1"""),
    "mrg2_company_upsert": (company_merge, "SELECT lower(name) AS name_key, concat(name, ' Inc') AS name, employee_count, CASE WHEN employee_count > 5000 THEN 'large' ELSE size_type END AS size_type FROM company"),
    "mrg6_replace_children": (children, "SELECT skill_id, alias, case_sensitive FROM skill_alias WHERE skill_id % 2 = 1 UNION ALL SELECT id, concat('new ', CAST(id AS VARCHAR)), false FROM skill WHERE id % 2 = 0"),
    "mrg7_st6_embed_plan": (embed_actions, """SELECT action, count(*) AS n FROM (SELECT CASE WHEN vec_id % 4 = 0 THEN 'delete' WHEN vec_id % 5 <> 0 AND vec_id % 3 <> 0 AND vec_id % 7 <> 0 THEN 'reuse' ELSE 'embed' END AS action
 FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 4 <> 0) GROUP BY 1"""),
    "src2_json_list": (lambda m: payloads.listed(payloads.sample_lists(m)), "SELECT source, id AS source_job_id, title, location, career_min FROM job_posting"),
    "src3_json_detail": (lambda m: payloads.with_detail(payloads.listed(payloads.sample_lists(m)), payloads.sample_details(m)), "SELECT source, id AS source_job_id, title, CASE WHEN id % 3 = 0 THEN coalesce('D ' || location, location) ELSE location END AS location, career_min FROM job_posting"),
    "tx15_page_text": (lambda m: payloads.page_text(m.view("pages")).selectExpr("page_id", "text", "size(images) AS images"), _PAGE_TEXT),
    "snk3_bar_chart": (
        lambda m: charts.bar_chart(m.sql("SELECT requirement AS label, count(*) AS n FROM posting_skill GROUP BY 1"), "skills", "label", "n"),
        """SELECT concat('{"type":"bar","title":"skills","data":[', string_agg(concat('{"label":"', label, '","value":', CAST(n AS VARCHAR), '}'), ',' ORDER BY label), ']}') AS payload FROM (SELECT requirement AS label, count(*) AS n FROM posting_skill GROUP BY 1)""",
    ),
}

QUERIES = {k: (lambda f: lambda spark, sf_dir: f(Market(spark, sf_dir)))(f) for k, (f, _) in TABLE.items()}
SQL = {k: expanded(sql) for k, (_, sql) in TABLE.items() if sql}
