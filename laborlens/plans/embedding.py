"""Queries of what goes to and comes from an embedding model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import embedding
from laborlens.operators import backlog, batching
from laborlens.sources.market import Market, expanded

_DIM = 20
#: Ratios often end in 5 exactly; this takes ties of rounding one way however they were summed.
_TIE = 1e-9
_HOST = "https://img.example.com/"
_SEEN = "SELECT user_id, event_id, event_id % 50 AS chars, event_id % 41 AS tokens FROM events"
_SIZED = "SELECT o_custkey AS lane, o_orderkey AS seq, o_orderkey % 60 AS size FROM orders"
_PAGE = f"""CASE id % 5 WHEN 0 THEN concat('<meta content="{_HOST}', name, '" property="og:image">') WHEN 1 THEN concat('<meta property="og:image" content=" "><img src="{_HOST}i', name, '" alt="x 기업로고">')
 WHEN 2 THEN '<meta property="og:image" content="https://cdn.example.org/share.png">' WHEN 3 THEN '<p>no picture</p>' END"""


def vectors(m: Market) -> DataFrame:
    v = m.skill.select("id", embedding.hash_vector(F.col("name"), _DIM).alias("v"))
    return v.select("id", F.size("v").alias("dim"), F.round(embedding.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[_DIM - 1], 6).alias("last"))


def aliases(m: Market) -> DataFrame:
    a = m.skill.select("id", "name", F.array(F.concat(F.lit(" "), F.upper("name")), F.concat(F.lit("Al"), "id"), F.concat(F.lit("C"), "id"), F.lit(" ")).alias("a"), F.array(F.concat(F.lit("C"), "id"), F.concat(F.lit("C"), "id")).alias("c"))
    plain = embedding.plain_aliases(F.col("name"), F.col("a"), F.col("c"))
    return a.select("id", F.array_join(plain, "|").alias("plain"), F.array_join(embedding.cased_aliases(F.col("c")), "|").alias("cased"), embedding.skill_text(F.col("name"), plain).alias("embed_text"))


def companies(m: Market) -> DataFrame:
    text = embedding.company_text(F.col("description"), F.concat(F.lit("a  \t b "), "business_content"), F.col("size_type"))
    return m.company.select("id", text.alias("embed_text"), F.sha2(text, 256).alias("embed_hash"))


def clamps(m: Market) -> DataFrame:
    return m.view("documents").select("doc_id", F.length(embedding.clamped(F.col("text"))).cast("long").alias("chars"))


def packs(m: Market, most_size: int, most_rows: int | None) -> DataFrame:
    return batching.packed(m.sql(_SIZED), "lane", "seq", "size", most_size, most_rows)


def stamps(m: Market) -> DataFrame:
    raw = F.when(F.col("id") % 3 > 0, F.lit('{"a": "1", "logo_checked_at": "old"}'))
    out = backlog.stamped(raw, "logo_checked_at", F.lit("2001-06-01"))
    return m.company.select("id", F.get_json_object(out, "$.a").alias("a"), F.get_json_object(out, "$.logo_checked_at").alias("checked"))


def _packing(most_size: int, most_rows: int) -> str:
    return f"""WITH RECURSIVE s AS (SELECT CAST(lane AS VARCHAR) AS lane, seq, size, row_number() OVER (PARTITION BY lane ORDER BY seq) AS i FROM ({_SIZED})),
 g AS (SELECT lane, seq, size, i, 0::BIGINT AS batch, size AS total, 1 AS n FROM s WHERE i = 1
 UNION ALL SELECT s.lane, s.seq, s.size, s.i, CASE WHEN g.total + s.size > {most_size} OR g.n >= {most_rows} THEN g.batch + 1 ELSE g.batch END,
 CASE WHEN g.total + s.size > {most_size} OR g.n >= {most_rows} THEN s.size ELSE g.total + s.size END, CASE WHEN g.total + s.size > {most_size} OR g.n >= {most_rows} THEN 1 ELSE g.n + 1 END
 FROM g JOIN s ON s.lane = g.lane AND s.i = g.i + 1) SELECT lane, seq, size, batch FROM g"""


_WORD = "CAST(CAST(concat('0x', substr(h, {}, 8)) AS BIGINT) AS DOUBLE) / 2147483648 - 1"
_HASHES = " || ".join(f"sha256(encode(name) || '\\x00\\x00\\x00\\x{i:02X}'::BLOB)" for i in range(3))

TABLE = {
    "tx31_hash_vectors": (vectors, f"""SELECT id, CAST({_DIM} AS INTEGER) AS dim, 1.0::DOUBLE AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[{_DIM}] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last
 FROM (SELECT id, [{', '.join(_WORD.format(1 + 8 * j) for j in range(_DIM))}] AS v FROM (SELECT id, {_HASHES} AS h FROM skill))"""),
    "tx32_token_ratio": (lambda m: batching.token_ratio(m.sql(_SEEN), ["user_id"], ["event_id"]).withColumn("ratio", F.round(F.col("ratio") + _TIE, 6)), f"""WITH RECURSIVE s AS (SELECT user_id, tokens / chars * 1.1 AS seen, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ({_SEEN}) WHERE chars > 0 AND tokens > 0),
 g AS (SELECT user_id, i, CASE WHEN seen > 0.85 THEN CAST(seen AS DOUBLE) ELSE greatest(0.85 * 0.95::DOUBLE, seen, 0.45) END AS ratio FROM s WHERE i = 1
 UNION ALL SELECT s.user_id, s.i, CASE WHEN s.seen > g.ratio THEN s.seen ELSE greatest(g.ratio * 0.95, s.seen, 0.45) END FROM g JOIN s ON s.user_id = g.user_id AND s.i = g.i + 1)
 SELECT user_id, max(i) AS samples, round(arg_max(ratio, i) + {_TIE}, 6) AS ratio FROM g GROUP BY 1"""),
    "tx30_company_text": (companies, """SELECT id, t AS embed_text, sha256(t) AS embed_hash FROM (SELECT id, concat_ws(chr(10), CASE WHEN trim(description) <> '' THEN trim(description) END, CASE WHEN business_content IS NOT NULL THEN concat('a b ', business_content) END, size_type) AS t FROM company)"""),
    "tx35_seed_aliases": (aliases, "SELECT id, concat(lower(name), '|al', id) AS plain, concat('C', id) AS cased, concat(name, ', ', lower(name), ', al', id) AS embed_text FROM skill"),
    "tx33_clamp": (clamps, f"SELECT doc_id, least(length(text), {embedding.MOST_CHARS}) AS chars FROM documents"),
    "tx33_batches": (lambda m: packs(m, 100, 3), _packing(100, 3)),
    "st7_batches": (lambda m: packs(m, 96, None), _packing(96, 1_000_000)),
    "src12_logo": (lambda m: m.sql(f"SELECT id, {_PAGE} AS html FROM company").select("id", embedding.logo_url(F.col("html"), _HOST).alias("logo_url")), f"SELECT id, CASE id % 5 WHEN 0 THEN concat('{_HOST}', name) WHEN 1 THEN concat('{_HOST}i', name) END AS logo_url FROM company"),
    "mrg11_stamp": (stamps, "SELECT id, CASE WHEN id % 3 > 0 THEN '1' END AS a, '2001-06-01' AS checked FROM company"),
}

QUERIES = {k: (lambda f: lambda spark, sf_dir: f(Market(spark, sf_dir)))(f) for k, (f, _) in TABLE.items()}
SQL = {k: expanded(sql) for k, (_, sql) in TABLE.items()}
