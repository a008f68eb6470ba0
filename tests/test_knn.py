"""Neighbours against all pairs: clustered, random, repeated, null and zero vectors."""

import numpy as np
import pandas as pd
import pytest

from laborlens.operators import knn


def every(vectors, top):
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if v is not None and np.linalg.norm(v) > 1e-9}
    ids = sorted(ok)
    x = np.stack([ok[i] for i in ids])
    s = np.round(x @ x.T, 6)
    return {i: [(ids[j], s[n, j]) for j in sorted(range(len(ids)), key=lambda j: (-s[n, j], ids[j])) if j != n][:top] for n, i in enumerate(ids)}


def got(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append((r.id, r.similarity))
    return out


def clustered(seed, groups, n, dim, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dim))
    return [(i, (middles[i % groups] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("rows", "block"), [(clustered(1, 12, 400, 16, 0.1), 2048), (clustered(2, 1, 150, 8, 5.0), 16), (clustered(3, 2, 40, 4, 0.3), 7)])
def test_all_pairs(spark, rows, block):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(knn.knn_join(df, 10, block=block))
    want = every(rows, 10)
    assert found.keys() == want.keys()
    for q, hits in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in hits] or np.allclose([s for _, s in found[q]], [s for _, s in hits], atol=2e-6)


def test_clusters_rule_out_most_pairs(spark):
    rows = clustered(4, 20, 1000, 24, 0.05)
    df = knn.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10).select("q", "computed").distinct()
    assert sum(r.computed for r in df.collect()) < 0.25 * len(rows) ** 2


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(knn.knn_join(df, 2)) == {1: [(2, 1.0), (6, 1.0)], 2: [(1, 1.0), (6, 1.0)], 5: [(1, -1.0), (2, -1.0)], 6: [(1, 1.0), (2, 1.0)]}
    assert knn.knn_join(df.limit(0), 2).isEmpty()
    assert got(knn.knn_join(df.where("vec_id = 1"), 2)) == {}


def test_a_batch_of_queries_asks_for_some_cells_at_a_time():
    b = pd.DataFrame({"id": range(50), "v": [[1.0, 0.0]] * 50, "tau": [2.0] * 50})
    d = np.arange(2000.0).reshape(50, 40)
    frames = list(knn._asking(b, d, d % 3 > 0, 64))
    assert max(map(len, frames)) == 64
    got = pd.concat(frames)
    assert sorted(got["dq"]) == sorted(d[d % 3 > 0]) and (got["dq"] == got["q"] * 40 + got["cell"]).all()


def shuffled(df):
    """Rows that the shuffles of a query wrote."""
    df.collect()

    def rows(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return rows(plan.executedPlan())
        if "QueryStage" in kind:
            return rows(plan.plan())
        written = plan.metrics().get("shuffleRecordsWritten")
        children = plan.children()
        return (written.get().value() if written.isDefined() else 0) + sum(rows(children.apply(i)) for i in range(children.size()))

    return rows(df._jdf.queryExecution().executedPlan())


def test_vectors_go_to_blocks_not_to_each_cell(spark):
    """Where no bound helps, a query met each of 39 cells in a row of its own, and brought ten neighbours from each."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).normal(size=(1500, 64)))]
    df = knn.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10, block=512)
    assert 0 < shuffled(df) < 50 * len(rows)
    rows = [(i, np.float32(v).astype(float)) for i, v in rows]
    assert got(df) == {q: [(i, pytest.approx(s, abs=1e-9)) for i, s in hits] for q, hits in every(rows, 10).items()}


@pytest.mark.parametrize("values", [np.repeat(np.random.default_rng(7).normal(size=(20, 8)), [60] + [3] * 19, axis=0), np.random.default_rng(8).integers(-1, 2, size=(150, 4))])
def test_equal_vectors_go_by_id_over_blocks(spark, values):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(np.random.default_rng(9).permutation(1000), values)]
    found = got(knn.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, block=40))
    assert found == {q: [(i, pytest.approx(s, abs=1e-9)) for i, s in hits] for q, hits in every(rows, 10).items()}
