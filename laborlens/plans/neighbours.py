"""Queries of nearest neighbours for every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame

from laborlens.operators import knn
from laborlens.sources.market import Market

TOP = 10


def neighbours(m: Market) -> DataFrame:
    return knn.knn_join(m.vectors, TOP).drop("computed")


_COSINE = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
TABLE = {
    "jn16_knn_join": (
        neighbours,
        f"SELECT * FROM (SELECT a.vec_id AS q, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) AS INT) AS rank, b.vec_id AS id, {_COSINE} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= {TOP}",
    ),
}

QUERIES = {k: (lambda f: lambda spark, sf_dir: f(Market(spark, sf_dir)))(f) for k, (f, _) in TABLE.items()}
SQL = {k: sql for k, (_, sql) in TABLE.items()}
