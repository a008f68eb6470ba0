"""Kept answers: batches, pushed filters and streams over a bronze folder."""

import pytest
from pyspark.sql import functions as F

from laborlens.sources import kept

ROWS = [(s, k, n, f'{{"s": "{s}", "n": {n}, "t": "가"}}') for s in ("a", "b") for k in ("list", "detail") for n in range(0, 90, 3)]


@pytest.fixture
def folder(spark, tmp_path):
    spark.conf.set(kept.PUSHDOWN, "true")
    assert kept.keep(spark.createDataFrame(ROWS, "source string, kind string, number long, payload string"), str(tmp_path / "b")) == len(ROWS)
    yield tmp_path / "b"
    spark.conf.unset(kept.PUSHDOWN)


def test_batch(spark, folder):
    df = kept.answers(spark, str(folder), step=7)
    assert sorted(map(tuple, df.collect())) == sorted(ROWS)
    assert df.rdd.getNumPartitions() == 4 * 5
    assert kept.answers(spark, f"file://{folder}").count() == len(ROWS)
    assert kept.answers(spark, str(folder / "nothing")).isEmpty()


def test_filters_are_pushed(spark, folder):
    """What lies outside the filters is not opened: reading it would fail."""
    for p in folder.glob("b/*/*.json"):
        p.chmod(0)
        p.unlink()
        p.mkdir()
    for n in (0, 60, 87):
        (folder / f"a/list/{n}.json").unlink()
        (folder / f"a/list/{n}.json").mkdir()
    df = kept.answers(spark, str(folder), step=4).where("source = 'a' and kind in ('list') and number > 2 and number < 60")
    want = sorted(r for r in ROWS if r[0] == "a" and r[1] == "list" and 2 < r[2] < 60)
    assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() == 5
    odd = kept.answers(spark, str(folder)).where((F.col("source") == "a") & (F.col("kind") == "detail") & (F.col("number") % 2 == 0) & (F.col("number") >= 30) & (F.col("number") <= 36))
    assert [r.number for r in odd.orderBy("number").collect()] == [30, 36]
    assert [r.number for r in kept.answers(spark, str(folder)).where("source = 'a' and kind = 'detail' and number = 9").collect()] == [9]


def test_stream(spark, folder, tmp_path):
    def run():
        kept.answer_stream(spark, str(folder), step=5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination(120)

    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(ROWS)
    more = [("a", "list", 90, "{}"), ("c", "list", 1, "{}")]
    kept.keep(spark.createDataFrame(more, "source string, kind string, number long, payload string"), str(folder))
    run()  # goes on from the offset that it had
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(ROWS + more)


def test_a_folder_is_listed_once_however_many_tasks_read_it(tmp_path, monkeypatch):
    for n in range(20):
        (tmp_path / "s" / "k").mkdir(parents=True, exist_ok=True)
        (tmp_path / "s" / "k" / f"{n}.json").write_text(str(n))
    listed = []
    names = kept._Folder._names
    monkeypatch.setattr(kept._Folder, "_names", lambda self, *parts: listed.append(parts) or names(self, *parts))
    scan = kept.Scan({"path": str(tmp_path), "step": "3"})
    parts = scan.partitions()
    assert len(parts) == 7 and [r[2] for p in parts for r in scan.read(p)] == list(range(20))
    assert listed.count(("s", "k")) == 1
