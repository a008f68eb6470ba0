"""Runs that end, or are ended by a timer, as a stream: in order, late, and over a restart."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from laborlens.operators import merge
from laborlens.streaming import runs
from tests.test_streaming import files, run  # noqa: F401

DAY = datetime(2024, 1, 1)
LOG = "run string, at timestamp, status string, fetched long"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, runs.PROVIDER)
    yield
    spark.conf.set(key, old)


def rows(spark, *v):
    return spark.createDataFrame([(r, DAY + timedelta(minutes=m), s, n) for r, m, s, n in v], LOG)


def logs(spark):
    return (
        rows(spark, ("a", 0, "running", 1), ("b", 0, "running", 1), ("c", 5, "running", 2), ("a", 10, "success", 3)),
        rows(spark, ("b", 50, "running", 4), ("c", 65, "running", 1), ("a", 20, "failed", 9), ("d", 130, "running", 0)),
        rows(spark, ("b", 100, "success", 9), ("c", 200, "success", 1), ("e", 260, "success", 7)),
        rows(spark, ("f", 600, "partial", None)),
    )


A = ("a", "success", DAY, DAY + timedelta(minutes=10), 4, False)
E = ("e", "success", DAY + timedelta(minutes=260), DAY + timedelta(minutes=260), 7, False)
F_ = ("f", "partial", DAY + timedelta(minutes=600), DAY + timedelta(minutes=600), 0, False)
STALE = [
    ("b", "failed", DAY, DAY + timedelta(minutes=60), 5, True),
    ("c", "failed", DAY + timedelta(minutes=5), DAY + timedelta(minutes=65), 3, True),
    ("d", "failed", DAY + timedelta(minutes=130), DAY + timedelta(minutes=190), 0, True),
]


def test_timers_fail_runs_at_the_cutoff(spark, files):  # noqa: F811
    got = run(runs.ended_runs(files(*logs(spark)), "1 hour", "1 minute"), spark, "runs1")
    assert got == sorted([A, *STALE, E, F_])
    # The same runs are those that the batch form reaps: still running, and begun before the cutoff.
    begun = spark.createDataFrame([(r, "running", DAY + timedelta(minutes=m), None) for r, m in (("b", 0), ("c", 5), ("d", 130), ("g", 590))], "run string, status string, started_at timestamp, finished_at timestamp")
    now = F.lit(DAY + timedelta(minutes=600))
    assert {r.run for r in merge.reap_stale(begun, now - F.expr("INTERVAL 1 HOUR"), now).where("status = 'failed'").collect()} == {r[0] for r in got if r[5]}


def test_progress_moves_the_timer(spark, files):  # noqa: F811
    got = {r[0]: r for r in run(runs.ended_runs(files(*logs(spark)), "1 hour", "1 minute", since_progress=True), spark, "runs2")}
    assert got["b"][1:] == ("success", DAY, DAY + timedelta(minutes=100), 14, False)
    assert got["c"][1:] == ("failed", DAY + timedelta(minutes=5), DAY + timedelta(minutes=125), 3, True)
    assert got["d"] == STALE[2] and got["a"] == A


def test_a_restart_gives_the_same_rows(spark, tmp_path):
    frames = logs(spark)

    def begin(out, cp):
        stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        runs.ended_runs(stream, "1 hour", "1 minute").writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / cp)).trigger(availableNow=True).start().awaitTermination()

    def put(i):
        before = set((tmp_path / "in").glob("*.parquet"))
        frames[i].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for x in set((tmp_path / "in").glob("*.parquet")) - before:
            os.utime(x, (1e9 + i, 1e9 + i))

    for i in range(2):
        put(i)
    begin("out", "cp")
    for i in range(2, 4):
        put(i)
    begin("out", "cp")  # goes on where it stopped
    begin("whole", "cp2")
    show = lambda p: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / p)).collect())
    assert show("out") == show("whole") == sorted([A, *STALE, E, F_])


def test_stops(spark, files):  # noqa: F811
    pages = lambda *v: spark.createDataFrame([(j, DAY + timedelta(minutes=m), p, n, k) for j, m, p, n, k in v], "job string, at timestamp, page long, rows long, known long")
    stream = files(pages(("a", 0, 1, 5, 5), ("b", 0, 1, 5, 5)), pages(("a", 1, 2, 5, 5), ("b", 1, 2, 5, 4), ("b", 2, 3, 0, 0)), pages(("a", 3, 3, 5, 0)), pages(("a", 200, 1, 5, 5)))
    want = [("a", 1, 1, False), ("a", 2, 2, True), ("a", 3, 2, True), ("b", 1, 1, False), ("b", 2, 0, False), ("b", 3, 0, False)]
    assert run(runs.stops(stream), spark, "stops1") == sorted([*want, ("a", 1, 2, True)])
    assert run(runs.stops(stream, forget="1 hour", delay="1 minute"), spark, "stops2") == sorted([*want, ("a", 1, 1, False)])
