"""Each query against a plain version, over whole tables."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from laborlens.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").collect()


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_simhash(spark, docs):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows_of(spark, "op1_simhash")} == brute.simhash(docs)


def test_secrets(spark, docs):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in rows_of(spark, "op2_secrets")}
    want = {i: brute.secrets(t) for i, t in docs}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4], i
        assert set(filter(None, w[4].split(","))) <= set(got[i][4].split(",")), i


def test_warc(spark, pages):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows_of(spark, "op3_warc")}
    assert got == brute.warc([(r.page_id, r.html) for r in pages])


def test_suffix_array(spark, docs):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, "op4_suffix_array"))
    assert got == Counter(brute.byte_repeats(docs))


def test_decontamination_finds_planted_passages(spark, docs):
    """Every item of which a text holds nearly all words in order is found, and texts that share next to nothing are not."""
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {i: (t or "").lower() for i, t in docs}
    exact = {(d, i) for i, w in items.items() for d, t in texts.items() if " ".join(w) in " ".join(t.split())}
    got = rows_of(spark, "op5_decontaminate")
    assert exact <= {(r.doc_id, r.item_id) for r in got} and exact
    for r in got:
        shared = len(set(items[r.item_id]) & set(texts[r.doc_id].split())) / len(set(items[r.item_id]))
        assert shared >= 0.5 and r.lcs_share >= 0.6


def test_quality(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op6_quality")}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), i
        assert not (r.base_failed and r.kept)
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    scores, low = brute.quality_scores(docs, labels)
    for i, want in scores.items():
        assert got[i].score == pytest.approx(want, abs=2e-6), i
        assert abs(want - low) < 4e-6 or got[i].kept == (not got[i].base_failed and want >= low), i
    good = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect() if not got[r.doc_id].base_failed]
    bad = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect() if not got[r.doc_id].base_failed]
    rate = lambda ids: sum(got[i].kept for i in ids) / max(len(ids), 1)
    assert rate(good) > 0.95 and rate(good) > rate(bad)


def test_licenses(spark, docs):
    """Lines, paragraphs and whole texts against every template; passages are tested on made texts."""
    from laborlens.llm.license_texts import TEMPLATES

    got = {(r.doc_id, r.unit, r.line_no): (r.license, r.dice) for r in rows_of(spark, "op7_licenses") if r.unit != "passage"}
    every, want = [(name, Counter(brute.pairs(t))) for name, t in TEMPLATES], {}
    for i, t in docs:
        for unit, at, part in brute.license_units(t or ""):
            mine = Counter(brute.pairs(part))
            best, k = max((2 * (mine & theirs).total() / max(1, mine.total() + theirs.total()), -k) for k, (_, theirs) in enumerate(every))
            if best >= 0.8:
                want[i, unit, at] = (every[-k][0], round(best, 6))
    assert got == want and want


def test_substrings(spark, docs):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows_of(spark, "op8_substrings"))
    assert got == Counter(brute.word_repeats(docs))


def test_urls(spark, pages):
    got = {r.page_id: r for r in rows_of(spark, "op9_urls")}
    assert len(got) == len(pages)
    for p in pages:
        r, (host, path, rule, _) = got[p.page_id], brute.url(p.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
    assert [got[p.page_id].verdict for p in pages] == brute.url_verdicts([p.url for p in pages], 0.9)


def test_mixing(spark, docs):
    rows = rows_of(spark, "op10_mixing")
    text, source = dict(docs), {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(brute.words(text[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
    want = brute.targets(sizes)
    largest = max(r["size"] for r in rows)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest
    again = rows_of(spark, "op10_mixing")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage on what the one before it kept."""
    import corpus_pipeline
    from laborlens.llm import quality, simhash
    from tests.llm.test_near_copies import kept as kept_ids

    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [all_docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < 4:
            assert kept[-1].columns == all_docs.columns
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    verdict = {r.doc_id for r in quality.judge(all_docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert set(ids[1]) == verdict
    assert sorted(ids[2]) == kept_ids([(i, dict(docs)[i]) for i in ids[1]])
    assert set(ids[3]) < set(ids[2]) and sorted(ids[4]) == sorted(ids[3]) and set(ids[5]) <= set(ids[4])
    before, after = ({r.doc_id: r.text for r in k.collect()} for k in kept[3:5])
    for i, t in before.items():
        if brute.secrets(t)[4]:
            assert "[secret]" in after[i] and not brute.secrets(after[i])[4]
        else:
            assert after[i] == t
    assert kept[5].where(~F.col("copies").between(1, 3)).isEmpty()
    assert simhash.fingerprint(None) == 0
