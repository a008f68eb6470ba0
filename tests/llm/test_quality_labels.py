"""Verdicts of the quality rules against the labels of sf0.1."""

from pyspark.sql import functions as F

from laborlens.llm import quality

SF = "/root/testdata/sf0.1"


def test_labelled_junk_goes_and_held_out_good_stays(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = quality._trusted(labels, quality.TRUSTED).where("held").select(F.col("trusted_id").alias("doc_id"))
    got = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    junk = [r.kept for r in got.join(labels.where("quality = 0"), "doc_id", "left_semi").collect()]
    good = [r.kept for r in got.where("not base_failed").join(held, "doc_id", "left_semi").collect()]
    assert sum(junk) <= 0.05 * len(junk) and sum(good) >= 0.98 * len(good) > 1000


def test_all_trusted_documents_are_used(spark):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality._trusted(labels, quality.TRUSTED).count() == 25_000
