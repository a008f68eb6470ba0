"""Batches and token ratios against plain loops, with nulls, one-row lanes and values at the limits."""

import random

import pytest

from laborlens.operators import batching


def test_packed(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0, 1, 40, 96, 97, 200, None])) for i in range(200)] + [("solo", 1, 500)]
    got = {(r.lane, r.seq): r.batch for r in batching.packed(spark.createDataFrame(rows, "k string, i long, n long"), "k", "i", "n", 96, 5).collect()}
    for lane in ("a", "b", "", "solo"):
        batch = total = n = 0
        for _, i, size in sorted((r for r in rows if (r[0] or "") == lane), key=lambda r: r[1]):
            size = size or 0
            if n and (total + size > 96 or n >= 5):
                batch, total, n = batch + 1, 0, 0
            total, n = total + size, n + 1
            assert got[lane, i] == batch
    assert batching.packed(spark.createDataFrame([], "k string, i long, n long"), "k", "i", "n", 96).count() == 0


def test_token_ratio(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([0, 1, 10, 33, None]), rng.choice([0, 1, 7, 20, None])) for k in range(4) for i in range(60)]
    got = {r.k: (r.samples, r.ratio) for r in batching.token_ratio(spark.createDataFrame(rows, "k long, i long, chars long, tokens long"), ["k"], ["i"]).collect()}
    for k in range(4):
        ratio, n = batching.FIRST, 0
        for _, _, chars, tokens in (r for r in rows if r[0] == k):
            if chars and tokens:
                ratio, n = max(tokens / chars * batching.SAFETY, ratio * batching.DECAY, batching.FLOOR), n + 1
        assert got[k][0] == n and got[k][1] == pytest.approx(ratio)
