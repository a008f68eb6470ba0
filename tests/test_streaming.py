"""Streaming forms run as streams over files and give what the batch forms give."""

import os

import pytest
from pyspark.sql import functions as F

from laborlens.functions import dates, jsonld
from laborlens.operators import backlog, merge
from laborlens.operators.buckets import BucketTable
from laborlens.streaming import crawl, windows

SF = "/root/testdata/sf0.001"


def run(query_of, spark, name, mode="append"):
    q = query_of.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


@pytest.fixture
def files(spark, tmp_path):
    """Writes frames as one file each, in order of time, and reads them as a stream of one file a batch."""

    def of(*frames):
        seen = set()
        for i, f in enumerate(frames):
            f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            fresh = set((tmp_path / "in").glob("*.parquet")) - seen
            for x in fresh:
                os.utime(x, (1e9 + i, 1e9 + i))
            seen |= fresh
        return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return of


def test_windows(spark, files):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "user_id")
    stream = files(events.where("day(ts) <= 15"), events.where("day(ts) > 15"))
    for name, form in {
        "w1": lambda e: windows.tumbling(e, "1 hour", ["event_type"]),
        "w2": lambda e: windows.sliding(e, "1 hour", "30 minutes", ["event_type"]),
    }.items():
        assert run(form(stream), spark, name, "complete") == sorted(tuple(r) for r in form(events).collect())
    s = run(windows.sessions(stream, "6 hours", ["user_id"]), spark, "w3")
    whole = {tuple(r) for r in windows.sessions(events, "6 hours", ["user_id"]).collect()}
    end = events.agg(F.max("ts")).first()[0]
    assert set(s) <= whole
    assert all(r[1] > end.replace(hour=0, minute=0, second=0, microsecond=0) for r in whole - set(s))  # only open sessions are missing


def test_first_seen(spark, files):
    rows = lambda *v: spark.createDataFrame(v, "id long, day string").select("id", F.col("day").cast("timestamp").alias("at"))
    stream = files(rows((1, "2024-01-01"), (2, "2024-01-01"), (1, "2024-01-02")), rows((1, "2024-01-03"), (3, "2024-01-04")))
    assert [r[0] for r in run(crawl.first_seen(stream, ["id"], "at", 7), spark, "seen")] == [1, 2, 3]


def test_ingest(spark, files, tmp_path):
    rows = lambda *v: spark.createDataFrame(v, "source string, source_job_id long, title string, location string, collected_at long")
    stream = files(rows(("s", 1, "a", "x", 1), ("s", 1, "b", None, 2)), rows(("s", 1, "c", None, 3), ("s", 2, "d", "y", 3)))
    old = rows(*[("s", i, "old", "w", 0) for i in range(1, 40) if i != 2])
    table = BucketTable(str(tmp_path / "out"), old.schema, merge.POSTING_KEY, 8)
    table.create(old)
    before = set((tmp_path / "out").rglob("*.parquet"))
    crawl.ingest(stream, table, str(tmp_path / "cp")).awaitTermination()
    got = {r.source_job_id: tuple(r) for r in table.read(spark).collect()}
    assert got[1] == ("s", 1, "c", "w", 3) and got[2] == ("s", 2, "d", "y", 3) and len(got) == 39 and got[7] == ("s", 7, "old", "w", 0)
    after = set((tmp_path / "out").rglob("*.parquet"))
    assert 1 <= len(after - before) <= 2 and len(before & after) >= 6  # files of buckets without a change keep their names
    again = rows(("s", 1, "c", None, 3), ("s", 2, "d", None, 3))
    assert table.merge(again, merge.upsert_postings) == [] and set((tmp_path / "out").rglob("*.parquet")) == after
    assert table.merge(again.limit(0), merge.upsert_postings) == []
    assert len(table.merge(rows(("s", 7, "new", None, 4)), merge.upsert_postings)) == 1 and table.read(spark).count() == 39


def test_dates(spark):
    d = spark.createDataFrame([("~01/15(금)", "수정일 26/09/28", "2026.10.03 14:05"), ("2/30", "등록일 26/10/03", "2026-13-01"), (None, None, None)], "a string, b string, c string")
    as_of = F.lit("2026-10-01 00:00:00").cast("timestamp")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    got = [tuple(r) for r in d.select(show(dates.deadline(F.col("a"), as_of)), show(dates.registered(F.col("b"))), show(dates.date_time(F.col("c")))).collect()]
    assert got == [("2027-01-15 14:59:59", None, "2026-10-03 05:05:00"), (None, "2026-10-02 15:00:00", None), (None, None, None)]


def test_structured(spark):
    jobs = ['{"baseSalary": {"value": {"value": 2500000, "unitText": "MONTH"}}}', '{"baseSalary": {"value": 41000000}}', '{"baseSalary": {"value": {"value": "3000"}}}', '{"baseSalary": {"currency": "usd", "value": 90000}}', '{"baseSalary": 5}', "{", None]
    got = [r[0] for r in spark.createDataFrame([(j,) for j in jobs], "j string").select(jsonld.salary_text(F.col("j"))).collect()]
    assert got == ["월 250만원", "4,100만원", None, None, None, None, None]
    assert jsonld.find_job(["{broken", '[{"@type": "A", "@graph": [{"@type": ["B", "JobPosting"], "x": 1}]}, {"@type": "JobPosting"}]'])["x"] == 1
    assert jsonld.find_job([]) is None


def test_stamp(spark):
    d = spark.createDataFrame([(None,), ('{"a":"1","t":"0"}',)], "raw string")
    assert [r[0] for r in d.select(backlog.stamped(F.col("raw"), "t", F.lit("9"))).collect()] == ['{"t":"9"}', '{"a":"1","t":"9"}']
