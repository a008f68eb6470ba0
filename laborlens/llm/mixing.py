"""Mixing of sources to target weights by hash-threshold histograms.

Tokens are summed by source and hash bucket; each source's budget falls into one
bucket, which alone is refined, twice, by further bits of the hash. The threshold
that results filters every row; nothing is sorted but histograms of at most 1024
rows a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.llm.common import cut, word_array

WEIGHTS = (5, 2, 1)
MOST = 3
LEVELS = 3
BITS = 10
#: Plans of at most so many sources are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def _hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 over id and text, the same in any run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(text))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    Sources by code point, null last, weigh 5, 2, 1, repeating. Shares stop at
    three times a source's size, and the excess goes to the others by weight: the
    water level of that is found where, ordered by the level at which they stop,
    the first source does not reach its stop. One row a source goes through these windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("w", F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1))
    rows = rows.withColumn("stop", MOST * F.col("source_size"))
    before = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("level", left.cast("double") / weight)
    level = F.min(F.when(F.col("level") <= F.col("stop") / F.col("w"), F.struct((F.col("stop") / F.col("w")).alias("o"), "level"))).over(every)["level"]
    return rows.select("source", "source_size", F.least(F.col("stop").cast("double"), F.coalesce(level * F.col("w"), F.col("stop").cast("double"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source)`` for each row.

    Size is the number of words (null text: 0). ``taken`` is a whole number of
    copies, at most three, times the size: every row of a source is taken as often
    as its target holds its size, and rows under the hash threshold once more. Null
    ids hash by their text, repeated rows are taken alike, null is a source of its
    own, and an empty table gives no rows. With ``carry`` the rows of ``docs`` that
    are taken come back instead, with their columns and ``copies`` (a column of that name is replaced).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = _hash(F.col(id_col), text)
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(word_array(text)).cast("long").alias("size"), h.alias("h")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = cut(plan.withColumn("times", times).withColumn("need", F.col("target") - F.col("times") * F.col("source_size")))
    small = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)

    def with_plan(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "source2")
        return left.join(hint(right), left["source"].eqNullSafe(right["source2"]), "left").drop("source2")

    bounds, inside = plan.select("source", "need"), rows
    for level in range(LEVELS):
        bucket = F.shiftright("h", 60 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))
        sums = inside.withColumn("b", bucket).groupBy("source", "b").agg(F.sum("size").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy("source").orderBy("b"))
        hist = with_plan(sums.withColumn("up_to", up_to), bounds)
        edge = hist.where("up_to > need").groupBy("source").agg(F.min(F.struct("b", "n", "up_to")).alias("x"))
        edge = with_plan(bounds, edge.select("source", F.col("x.b").alias("b"), (F.col("x.up_to") - F.col("x.n")).alias("below"), F.col("x.n").alias("n")))
        # A budget that no bucket exceeds takes all that is inside.
        bounds = cut(edge.select("source", *(c for c in bounds.columns if c not in ("source", "need")), F.coalesce("b", F.lit(1 << BITS)).alias(f"b{level}"), (F.col("need") - F.coalesce("below", "need")).alias("need"), *([F.coalesce("n", F.lit(0)).alias("last")] if level == LEVELS - 1 else [])))
        if level < LEVELS - 1:
            inside = with_plan(inside, bounds.select("source", F.col(f"b{level}").alias("edge"))).where(bucket == F.col("edge")).select("source", "size", "h")
    # What is left of the budget takes the last bucket too if that comes nearer to it.
    edge = sum(F.col(f"b{i}") * (1 << (BITS * (LEVELS - 1 - i))) for i in range(LEVELS)) + F.when(F.col("need") * 2 > F.col("last"), 1).otherwise(0)
    final = with_plan(plan.select("source", "source_size", "target", "times"), bounds.select("source", edge.alias("edge")))
    if carry:  # the row travels as one struct, so that its columns clash with none of the plan's
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "copies")).alias("row"), F.col(source_col).cast("string").alias("source"), h.alias("h"))
    out = with_plan(rows, final)
    more = (F.col("times") < MOST) & (F.shiftright("h", 60 - BITS * LEVELS) < F.col("edge"))
    if carry:
        copies = (F.col("times") + more.cast("long")).cast("int")
        return out.withColumn("copies", copies).where("copies > 0").select("row.*", "copies")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + more.cast("long"))).cast("long").alias("taken"), "source")
