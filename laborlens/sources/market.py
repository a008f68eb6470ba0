"""The market's tables as views over the Parquet tables of a folder.

Each view is one portable SELECT, so that the same text defines it for Spark and
for the SQL that checks Spark. Only the views that a statement names are expanded.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")
AS_OF = "2001-07-01 00:00:00"

VIEWS = {
    "company": """SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'MACHINERY' THEN 'startup' WHEN 'BUILDING' THEN 'small'
        WHEN 'AUTOMOBILE' THEN 'medium' WHEN 'FURNITURE' THEN 'large' ELSE 'enterprise' END AS size_type,
        CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS INT) END AS employee_count, c_nationkey AS nation_id,
        CASE WHEN c_custkey % 3 = 0 THEN concat(' ', c_mktsegment) WHEN c_custkey % 3 = 1 THEN '  ' END AS description,
        CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS business_content FROM customer""",
    "tech_field": "SELECT r_regionkey AS id, lower(r_name) AS code, r_name AS name, r_regionkey AS sort_order FROM region",
    "job_posting": """SELECT o.o_orderkey AS id, o.o_custkey AS company_id, CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE n.n_regionkey END AS field_id,
        CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE o.o_orderdate END AS posted_at,
        CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_orderdate END AS expires_at,
        CASE WHEN o.o_orderkey % 11 > 8 THEN NULL ELSE CAST(o.o_orderkey % 11 AS INT) END AS career_min,
        CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(o.o_orderkey % 11 + o.o_orderkey % 5 AS INT) END AS career_max,
        CASE o.o_orderstatus WHEN 'F' THEN 'range' WHEN 'O' THEN 'min_only' ELSE 'negotiable' END AS salary_type,
        CASE WHEN o.o_orderstatus <> 'P' THEN CAST(floor(o.o_totalprice / 20) AS INT) END AS salary_min, CAST(NULL AS INT) AS salary_max,
        CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE concat(r.r_name, ' ', n.n_name) END AS location, o.o_orderkey % 23 = 0 AS body_is_image,
        o.o_orderkey % 29 = 0 AS body_extract_failed, concat('Engineer ', CAST(o.o_orderkey % 7 AS VARCHAR(8))) AS title,
        CASE WHEN o.o_orderkey % 2 = 0 THEN 'site_a' ELSE 'site_b' END AS source,
        CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE concat('h', CAST(o.o_orderkey AS VARCHAR(20))) END AS content_hash,
        CASE WHEN o.o_orderkey % 3 = 0 THEN NULL WHEN o.o_orderkey % 3 = 1 THEN concat('h', CAST(o.o_orderkey AS VARCHAR(20))) ELSE 'old' END AS embed_hash
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "skill": "SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS id, p_brand AS name, CAST(substr(p_brand, 7) AS INT) % 10 = 0 AS is_common, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 4 > 0 THEN 'language' END AS category FROM part",
    "skill_alias": "SELECT id AS skill_id, lower(replace(name, '#', ' ')) AS alias, false AS case_sensitive FROM skill UNION ALL SELECT id, concat('B', CAST(id AS VARCHAR(8))), true FROM skill UNION ALL SELECT id, concat('group', CAST(id % 10 AS VARCHAR(8))), false FROM skill",
    "skill_field": "SELECT id AS skill_id, id % 5 AS field_id FROM skill",
    "posting_skill": """SELECT l.l_orderkey AS posting_id, CAST(substr(p.p_brand, 7) AS INT) AS skill_id, CASE max(CASE l.l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1
        ELSE CASE l.l_linestatus WHEN 'O' THEN 3 ELSE 0 END END) WHEN 3 THEN 'tag' WHEN 2 THEN 'required' WHEN 1 THEN 'preferred' ELSE 'body' END AS requirement,
        count(*) AS mentions FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey, CAST(substr(p.p_brand, 7) AS INT)""",
    "crawl_run": "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'running' ELSE 'success' END AS status, CAST(user_id AS BIGINT) AS user_id, ts AS started_at, CASE WHEN event_id % 4 <> 0 THEN ts END AS finished_at FROM events",
}


def expanded(sql: str, files: str | None = None) -> str:
    """``sql`` with the views it needs as common table expressions; base tables come from ``files`` if given."""
    needed: list[str] = []

    def need(text: str, but: str = "") -> None:
        for name in (*VIEWS, *(BASE if files else ())):
            if name != but and name not in needed and re.search(rf"(?i)\b(from|join)\s+{name}\b", text):
                if name in VIEWS:
                    need(VIEWS[name], name)
                needed.append(name)

    need(sql)
    body = lambda n: VIEWS[n] if n in VIEWS else f"SELECT * FROM parquet.`{files}/{n}.parquet`"
    views = ", ".join(f"{n} AS ({body(n)})" for n in needed)
    rest = sql.strip()
    if not views:
        return rest
    return f"WITH {views}, {rest[5:]}" if rest[:5].upper() == "WITH " else f"WITH {views} {rest}"


class Market:
    """The tables of one folder; ``market.posting`` and so on are DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(expanded(text, self.sf_dir))

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    company = property(lambda self: self.view("company"))
    field = property(lambda self: self.view("tech_field"))
    posting = property(lambda self: self.view("job_posting"))
    skill = property(lambda self: self.view("skill"))
    alias = property(lambda self: self.view("skill_alias"))
    skill_field = property(lambda self: self.view("skill_field"))
    posting_skill = property(lambda self: self.view("posting_skill"))
    vectors = property(lambda self: self.view("embeddings"))
