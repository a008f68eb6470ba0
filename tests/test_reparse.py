"""Dictionaries that collide, and parsing again what was parsed before."""

import pytest
from pyspark.sql import functions as F

from laborlens.functions import skills
from laborlens.operators import chunks, dictionary, reparse

SEED = "id int, name string, category string, is_ambiguous boolean, is_common boolean, aliases array<string>, exact array<string>"


def seeds(spark, *rows):
    return spark.createDataFrame([(i, n, "c", False, False, a, e) for i, n, a, e in rows], SEED)


def test_dictionary(spark):
    got = dictionary.loaded(seeds(spark, (1, "  Go  Lang ", ["GO", "golang", " "], []), (2, "R", [], ["R"]), (3, "Swift", ["swift", "SWIFT ui"], ["Swift"])))
    assert [(r.name, list(r.aliases), list(r.exact)) for r in got.orderBy("id").collect()] == [("Go Lang", ["go lang", "go", "golang"], []), ("R", [], ["R"]), ("Swift", ["swift ui"], ["Swift"])]
    known = dictionary.matcher(got).value
    assert [[m[0] for m in found] for found in known.mentions(["go and Golang, r or R", "swift Swift swift UI"])] == [[1, 1, 2], [3, 3]]


@pytest.mark.parametrize(
    ("rows", "told"),
    [
        (((1, "Go", ["x"], []), (2, "Ruby", ["X"], [])), "alias x"),
        (((1, "Go", [], ["G"]), (2, "Ruby", [], ["G"])), "exact alias G"),
        (((1, "Go", [], []), (2, " go ", [], [])), "alias go, name go"),
        (((1, "Go", [], []), (1, "Ruby", [], [])), "id 1"),
    ],
)
def test_collisions_stop_the_load(spark, rows, told):
    with pytest.raises(dictionary.Collision, match=told):
        dictionary.loaded(seeds(spark, *rows))


def test_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_SKILLS", 1)
    with pytest.raises(ValueError, match="more than 1"):
        dictionary.known(dictionary.loaded(seeds(spark, (1, "a", [], []), (2, "b", [], []))))
    monkeypatch.setattr(skills, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="states"):
        skills.Matcher([skills.Skill(1, ("abcdef",))])


POSTING = "id long, source string, title string, description string, tags array<string>, categories array<string>, field_id int, body_is_image boolean, body_extract_failed boolean, embed_hash string"


def test_a_second_run_changes_nothing(spark, tmp_path):
    body = "[자격요건]\nruby 경험\n[우대사항]\ngo 사용"
    posts = spark.createDataFrame(
        [
            (1, "a", "Backend", body, ["Go"], ["서버"], None, False, False, "h1"),
            (2, "a", None, "nothing", None, None, 3, False, None, "h2"),
            (3, "a", "x", "nothing", [], [], 3, True, False, "h3"),
            (4, "a", "보안", None, None, [], None, None, False, None),
            (5, "b", "Backend", body, [], ["서버"], None, False, False, "h5"),
        ],
        POSTING,
    )
    fields = spark.createDataFrame([("backend", 1), ("security", 2)], "code string, id int")
    matcher = skills.sent(spark, [skills.Skill(1, ("ruby",)), skills.Skill(2, ("go",), ambiguous=True)])
    links = spark.createDataFrame([(1, 9, "tag", 1), (5, 9, "tag", 1)], "posting_id long, skill_id int, requirement string, mentions long")
    state = chunks.chunks(posts).where("posting_id <> 1").select("posting_id", "section", "seq", "chunk_hash")

    done = reparse.reparse(posts, matcher, fields, state, str(tmp_path / "1"), "a")
    assert done.counters == {"postings": 4, "skills_linked": 2, "without_skills": 3, "field_updated": 4, "body_failed": 1}
    assert {tuple(r) for r in done.fields.collect()} == {(1, 1), (2, None), (3, None), (4, 2)}
    assert [r.id for r in done.failed.collect()] == [2] and [r.id for r in done.stale.collect()] == [1] and [r.id for r in done.reembed.collect()] == [1]
    after, linked = reparse.applied(posts, links, done)
    assert {tuple(r) for r in linked.collect()} == {(1, 1, "required", 1), (1, 2, "tag", 2), (5, 9, "tag", 1)}
    got = {r.id: (r.field_id, r.body_extract_failed, r.embed_hash) for r in after.collect()}
    assert got == {1: (1, False, None), 2: (None, True, "h2"), 3: (None, False, "h3"), 4: (2, False, None), 5: (None, False, "h5")}

    again = reparse.reparse(after, matcher, fields, chunks.chunks(after).select("posting_id", "section", "seq", "chunk_hash"), str(tmp_path / "2"), "a")
    assert all(x.isEmpty() for x in (again.fields, again.failed, again.stale, again.reembed))
    twice, relinked = reparse.applied(after, linked, again)
    assert sorted(map(str, twice.collect())) == sorted(map(str, after.collect())) and sorted(map(str, relinked.collect())) == sorted(map(str, linked.collect()))


def test_one_scan_feeds_all_outputs(spark, tmp_path):
    """Every output reads the table that the scan has written, and nothing before it."""
    posts = spark.createDataFrame([(1, "a", "x", "ruby", [], [], 1, False, False, "h")], POSTING).where(F.lit(True))
    fields = spark.createDataFrame([("backend", 1)], "code string, id int")
    done = reparse.reparse(posts, skills.sent(spark, [skills.Skill(1, ("ruby",))]), fields, spark.createDataFrame([], "posting_id long, section string, seq int, chunk_hash string"), str(tmp_path / "p"))
    for out in (done.skills, done.fields, done.failed):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and "MapInArrow" not in plan
