"""Connected components by alternating star steps, with a checkpoint for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import cut


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Link every neighbour of a node to the least node of its neighbourhood.

    Large steps move the neighbours above a node, small steps those below it.
    Only minima are aggregated, so no neighbourhood is ever gathered in one place.
    Few edges stay in the ``parts`` that they come in, one of which needs no shuffle.
    """
    # Both directions come from one row, and not from a union, so that edges in one partition stay in it.
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    if large:
        ends = edges.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e"))
    else:
        ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).select(F.explode(F.array(pair("u", "v"), pair("u", "u"))).alias("e"))
    sides = ends.select("e.u", "e.v")
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
    joined = sides.join(F.broadcast(least) if parts == 1 else least, sides["u"] == least["w"])
    out = joined.where("v > u") if large else joined
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct()


#: Edges that a partition of a round holds at least, where there are so many.
EDGES_A_PART = 50_000


def labels(edges: DataFrame, most: int) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``: the least node within two steps.

    Nodes with one root are connected, but a component may have several roots: a
    cheap first grasp of it, in one job instead of the rounds of ``components``. There
    are ``most`` edges at most.
    """
    here = F.broadcast if most < EDGES_A_PART else (lambda x: x)
    ends = edges.coalesce(most // EDGES_A_PART + 1).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    near = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    far = ends.join(here(near.select(F.col("u").alias("w"), F.col("m").alias("l"))), F.col("v") == F.col("w")).groupBy(F.col("u").alias("x")).agg(F.min("l").alias("l"))
    return near.join(here(far), F.col("u") == F.col("x")).select(F.col("u").alias("node"), F.least("m", "l").alias("root"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges (u, v)`` (long); root is the least node reachable.

    Null ends and self loops are ignored; no edges give no rows. A round starts from
    partitions of ``EDGES_A_PART`` edges or more; fewer edges than two of those make one
    partition, whose rounds need no shuffle at all.
    """
    edges = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    # Which rows are there decides whether a round changed anything: count and an order-free digest.
    state = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"))
    seen = edges.agg(state.alias("x")).first()["x"]
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        parts = seen["n"] // EDGES_A_PART + 1
        edges = cut(_star(_star(edges.coalesce(parts), True, parts), False, parts))
        now = edges.agg(state.alias("x")).first()["x"]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    both = F.explode(F.array(*(F.struct(F.col(end).alias("node"), F.col("v").alias("root")) for end in ("u", "v"))))
    return edges.select(both.alias("e")).select("e.*").distinct()
