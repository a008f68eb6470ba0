"""A table in buckets of its key: a batch rewrites the buckets in which it changes a row, and no other file."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "bucket"


@dataclass(frozen=True)
class BucketTable:
    """Parquet under ``path``, one folder for each of ``buckets`` values of the hash of ``keys``.

    A merge reads the buckets that hold keys of the batch, finds those in which a row
    would change, and puts new files in place of theirs (dynamic partition overwrite). So
    the work follows the batch, files of other buckets keep their names, and a
    batch that comes again writes nothing. One writer at a time.
    """

    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        df = spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, "integer")).parquet(self.path)
        df = df if buckets is None else df.where(F.col(BUCKET).isin(*buckets))
        return df.select(*self.schema.names)

    def create(self, rows: DataFrame) -> None:
        """Write the table anew, empty or not."""
        self._write(rows, "overwrite")

    def _write(self, rows: DataFrame, mode: str, **options: str) -> None:
        dealt = self._bucketed(rows.select(*self.schema.names)).repartition(BUCKET)
        dealt.write.mode(mode).options(**options).partitionBy(BUCKET).parquet(self.path)

    def merge(self, batch: DataFrame, upsert: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """``upsert(old, batch)`` over the buckets of the batch, whose keys are unique; the numbers of those rewritten."""
        spark = batch.sparkSession
        reached = [r[0] for r in self._bucketed(batch).select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        if not reached:
            return []
        old = self.read(spark, reached)
        names = [c for c in self.schema.names if c not in self.keys]
        row = lambda df, name: self._bucketed(df).select(BUCKET, *self.keys, F.xxhash64(*(F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in names)).alias(name))
        merged = upsert(old, batch).select(*self.schema.names)
        differ = row(merged, "now").join(row(old, "was"), [BUCKET, *self.keys], "left").where(~F.col("now").eqNullSafe(F.col("was")))
        changed = sorted(r[0] for r in differ.select(BUCKET).distinct().collect())
        if changed:
            part = self._bucketed(batch).where(F.col(BUCKET).isin(*changed)).drop(BUCKET)
            self._write(upsert(self.read(spark, changed), part), "overwrite", partitionOverwriteMode="dynamic")
        return changed
