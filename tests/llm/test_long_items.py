"""Benchmark items of any length."""

import random

import pytest

from laborlens.llm import decontaminate


@pytest.mark.parametrize("size", [60, 61, 100, 200, 1000])
def test_items_are_found_whole_and_edited(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(4000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(size) for _ in range(3)]
    few = [w if rng.random() > 0.1 else "other" for w in items[1]]
    longer = [x for w in items[2] for x in ((w, "more") if rng.random() < 0.1 else (w,))]
    texts = [some(150) + x + some(150) for x in (items[0], few, longer, items[0][: size // 2], some(size))]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 1), (2, 2)]
    assert {r.doc_id: r.lcs_share for r in got}[0] == 1.0
    assert sorted(r.doc_id for r in decontaminate.cleaned(docs, bench).collect()) == [3, 4]


def by_all_windows(docs, items):
    """Pairs that some window of a text verifies, whatever the latent space says of it."""
    d = decontaminate
    found = set()
    for i, text in docs:
        words = d.words_of(text).split()
        for x in items:
            if d.lcs(x.words, words) < d.PARAPHRASE * len(x.words):
                continue
            m = next(m for m in d.SCALES if len(x.words) + d.BLOCK <= m * d.BLOCK)
            size = (m + 2) * d.BLOCK
            for at in range(max(1, len(words) - size + 1)):
                window = words[at : at + size]
                share = d.lcs(x.words, window) / len(x.words)
                if share >= d.SAME or (share >= d.PARAPHRASE and d.lcs(x.answer, window) >= d.ANSWER * len(x.answer)):
                    found.add((i, x.item_id))
                    break
    return found


def test_pairs_are_those_of_all_windows(spark):
    """All of sf0.01 against every window of every text: nothing else is told, and nearly nothing is missed."""
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = by_all_windows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], decontaminate.items_of(bench))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 10


def test_large_benchmarks(spark):
    """Recall of 1,500 items in one pass and in three, of which each tenth stands edited in a text."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(6000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(rng.randrange(20, 50)) for _ in range(1500)]
    texts = [some(80) + [w if rng.random() > 0.12 else "other" for w in items[n]] + some(80) for n in range(0, 1500, 10)]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)], "item_id long, text string")
    want = by_all_windows([(n, " ".join(t)) for n, t in enumerate(texts)], [x for x in decontaminate.items_of(bench) if x.item_id % 10 == 0])
    for a_pass in (20_000, 500):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, a_pass=a_pass).collect()}
        assert len(got & want) >= 0.9 * len(want) > 90 and all(i == 10 * d for d, i in got)


def test_one_text_of_ten_megabytes(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(5000)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    words = [rng.choice(vocabulary) for _ in range(1_100_000)]
    words[900_000:900_000] = item
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short")], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(item if n == 7 else [rng.choice(vocabulary) for _ in range(40)])) for n in range(60)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 7)]
