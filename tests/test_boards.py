"""A board's answers: mixed tags, broken items, times with and without a zone, kept answers."""

import datetime as dt

from pyspark.sql import functions as F

from laborlens.sources import boards


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_list_items(spark):
    good = '{"data": [{"id": 7, "position": "Dev", "company": {"name": " Acme "}, "skill_tags": [{"title": "SQL"}, " Go ", "", {"text": "C"}, {}], "address": {"location": "Seoul", "district": "Guro"}}, {"position": "no id"}, 5]}'
    (row,) = boards.listed(payloads(spark, good, '{"data": null}', "{}", "broken", None), "b", "https://x/{}", {}).collect()
    assert (row.source_job_id, row.url, row.title, row.company_name, row.newcomer) == ("7", "https://x/7", "Dev", "Acme", False)
    assert row.tech_stacks == ["SQL", "Go", "C"] and row.locations == ["Seoul Guro"] and row.career_min is None and row.company_source_id is None


def test_answers_without_data_are_told(spark):
    given = payloads(spark, '{"data": []}', '{"data": null}', "{}", "broken", "[]", None)
    assert [r.payload for r in boards.unreadable(given).collect()] == ["{}", "broken", "[]", None]


def test_moments(spark):
    given = ["2024-05-01", "2024-05-01T09:00:00", "2024-05-01T00:00:00Z", "2024-05-01T02:00:00+02:00", "soon", "", None]
    got = [r.t for r in spark.createDataFrame([(g,) for g in given], "s string").select(F.unix_timestamp(boards.moment(F.col("s"))).alias("t")).collect()]
    at = int(dt.datetime(2024, 5, 1, tzinfo=dt.UTC).timestamp())
    assert got == [at - 9 * 3600, at, at, at, None, None, None]


def test_detail_keeps_what_it_does_not_know(spark):
    jobs = boards.listed(payloads(spark, '{"data": [{"id": 1, "position": "A", "annual_from": 0, "is_newbie": true, "skill_tags": ["x"]}]}'), "b", "u{}")
    detail = spark.createDataFrame([("1", '{"job": {"detail": {"position": ""}, "skill_tags": [], "is_newbie": false, "company": {"company_tags": ["t"]}}}')], "source_job_id string, payload string")
    row = boards.with_detail(jobs, detail).first()
    assert (row.title, row.career_min, row.newcomer, row.tech_stacks, row.company_tags) == ("A", 0, False, ["x"], ["t"])
    assert row.detail_fetched and row.body_extract_failed
    row = boards.with_detail(jobs, detail.withColumn("payload", F.lit("{}"))).first()
    assert not row.detail_fetched and not row.body_extract_failed and row.newcomer


def test_store_and_replay(spark, tmp_path):
    columns = "source string, kind string, name string, payload string, fetched_at int"
    boards.store(spark.createDataFrame([("b", "position", "1", "old", 1), ("b", "list", "p1", "l", 1), ("c", "position", "1", "c", 9)], columns), str(tmp_path))
    boards.store(spark.createDataFrame([("b", "position", "1", "new", 2)], columns), str(tmp_path))
    kept = boards.stored(spark, str(tmp_path), "b", "position")
    assert [(r.name, r.payload) for r in kept.collect()] == [("1", "new")]
    assert [r[0] for r in spark.range(1, 4).select(boards.offset(F.col("id"))).collect()] == [0, 20, 40]
