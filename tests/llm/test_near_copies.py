"""Near copies against every pair of texts by plain shingle sets."""

import random
from collections import defaultdict

import numpy as np
import pytest

from laborlens.llm import near_copies, set_join
from tests.llm.brute import words

SF = "/root/testdata/sf0.01"


def grams(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def roots(rows):
    """{number of the row: least number of its class}"""
    sets, out = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while out[i] != i:
            i = out[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if (not a and not sets[j]) or (n and n >= 0.8 * (len(a) + len(sets[j]) - n)):
                x, y = sorted((top(i), top(j)))
                out[y] = x
    return [top(i) for i in range(len(rows))]


def by_id(i):
    return i is None, i or 0


def kept(rows):
    least = defaultdict(list)
    for (i, _), r in zip(rows, roots(rows)):
        least[r].append((i is None, i or 0))
    return sorted((None if none else i for none, i in map(min, least.values())), key=by_id)


def edited(rng, w, edits):
    w = list(w)
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"new{rng.random()}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(None, None), (1, ""), (2, " \t"), (3, "only three words"), (4, "Only THREE words"), (5, "only three"), (None, "no id and no copy")]
    for k in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 400))]
        out += [(len(out) + n + 10, edited(rng, base, e)) for n, e in enumerate((0, 1, 2, len(base) // 60, len(base) // 40, len(base) // 20))]
    large = [f"v{i}" for i in range(200)]
    return out + [(5000 + n, edited(rng, large, 2)) for n in range(90)]


@pytest.mark.parametrize("leaders", [0, 2])
def test_classes_are_those_of_all_pairs(spark, rows, leaders):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body")
    got = [r.doc_id for r in near_copies.keep_one(docs, leaders=leaders, text_col="body").collect()]
    assert sorted(got, key=by_id) == kept(rows)


def test_parity_bits_lose_no_link():
    """Bits that differ are a lower bound of the elements that differ, at every size of set."""
    rng = np.random.Generator(np.random.PCG64(3))
    for n in (1, 2, 30, 200, 5000):
        for change in (0, 1, n // 9, n // 2):
            a = np.unique(rng.integers(0, 1 << 64, size=n, dtype=np.uint64))
            b = np.unique(np.concatenate((a[change:], rng.integers(0, 1 << 64, size=change // 2, dtype=np.uint64))))
            x, y = (set_join.parity(v).view(np.uint64) for v in (a, b))
            assert len(x) == set_join.BITS // 64
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "a b c d e f g")] * 3 + [(6, "x y z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [6, 7]
    assert near_copies.keep_one(docs.limit(0)).isEmpty()


def test_stage_drops_edited_copies(spark):
    """All of sf0.01: one document of each class by shingle similarity stays."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == kept(rows)


def test_a_large_class_of_near_copies_is_whole(spark):
    """Hundreds of texts round one, some of which are like no other but a few: classes by all pairs, none lost by leaders."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(130)]
    rows = [(n, edited(rng, base, rng.choice((1, 2, 2, 3, 4)))) for n in range(500)]
    far = [(1000 + n, edited(rng, rows[n][1].split(), 3)) for n in range(80)]
    docs = spark.createDataFrame(rows + far, "doc_id long, text string")
    got = [r.doc_id for r in near_copies.keep_one(docs).collect()]
    assert sorted(got) == kept(rows + far) and 1 < len(got) < 400


@pytest.mark.parametrize("leaders", [0, 3])
def test_the_last_join_tells_a_pair_few_times(spark, monkeypatch, leaders):
    """Pairs of texts that share many first shingles, and one large class: the rows of the last join stay near the pairs."""
    rng = random.Random(11)
    rows = []
    for k in range(40):
        base = [f"p{k}w{i}" for i in range(400)]
        rows += [(len(rows) + e, edited(rng, base, e)) for e in (0, 9)]
    hub = [f"h{i}" for i in range(150)]
    rows += [(5000 + n, edited(rng, hub, 2)) for n in range(120 if leaders else 10)] + [(9000, " ".join(hub))]
    counts, met = [], set_join._met

    def counted(lists, percent):
        out = met(lists, percent)
        counts.append((out.count(), out.select("a.node", "b.node").distinct().count()))
        return out

    monkeypatch.setattr(set_join, "_met", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, leaders=leaders).collect()) == kept(rows)
    [(told, pairs)] = counts
    assert told <= 3 * pairs + 3
    assert leaders == 0 or pairs < 300


def test_stage_links_near_fingerprints_first(spark, monkeypatch):
    """The pipeline's stage asks SimHash for pairs: those within 2 bits, each fingerprint once; classes stay those of all pairs."""
    import corpus_pipeline
    from tests.llm import brute

    rng = random.Random(3)
    rows = []
    for k in range(12):
        base = [f"s{k}w{i}" for i in range(1500)]
        rows += [(len(rows) + e, edited(rng, base, e)) for e in range(4)]
    asked, near = [], set_join._near_prints

    def noted(nodes):
        out = near(nodes)
        prints = {r.node: r.fp for r in nodes.collect()}
        asked.append((prints, [(r.u, r.v) for r in out.collect()]))
        return out

    monkeypatch.setattr(set_join, "_near_prints", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == kept(rows)
    [(prints, pairs)] = asked
    assert sorted(fp % (1 << 64) for fp in prints.values()) == sorted(brute.fingerprint(t) for _, t in rows)
    assert pairs and all(((prints[u] ^ prints[v]) % (1 << 64)).bit_count() <= 2 for u, v in pairs)


def few_families(rng, families=20):
    """Texts in families of near copies, one of copies too."""
    rows = []
    for k in range(families):
        base = [f"f{k}w{i}" for i in range(120)]
        rows += [(4 * k + i, edited(rng, base, e)) for i, e in enumerate((0, 1, 2, 5))]
    return rows + [(900 + i, rows[0][1]) for i in range(5)]


@pytest.mark.parametrize("few", [0, 10**9])
@pytest.mark.parametrize("by_simhash", [False, True])
def test_few_rows_in_one_partition_change_no_class(spark, monkeypatch, few, by_simhash):
    """What is few stays in one partition; with nothing taken as few the classes are the same."""
    for name in ("FEW_PRINTS", "FEW_NODES", "FEW_KEYS", "FEW_SHINGLES", "EDGES_A_PART"):
        monkeypatch.setattr(set_join, name, few or 1)
    rows = few_families(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in set_join.joined(docs, by_simhash=by_simhash).collect()}
    assert got == {i: rows[top][0] for (i, _), top in zip(rows, roots(rows))}


def test_tasks_of_few_rows_do_not_grow_with_the_partitions(spark):
    """The rounds over few candidates need no task for each shuffle partition; each such task leaves files and events on disk."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, sc = {k: spark.conf.get(k) for k in conf}, spark.sparkContext
    rows = few_families(random.Random(6))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few", "few")
        near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        told = sc.statusTracker()
        stages = {s for j in told.getJobIdsForGroup("few") for s in told.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(told.getStageInfo, stages) if i)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < tasks < 60 * 40, tasks
