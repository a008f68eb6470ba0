"""Exact nearest neighbours of many queries at a time, by matrix products over blocks of cells that the triangle inequality rules out.

Vectors are dealt to the nearest of some centres, and near cells share a block. A query
first meets its own block, whose ``top`` best give a bound; then only the blocks that can
hold a nearer vector, and in them only the members whose distance from their centre leaves
room for it. All bounds are exact, so the result is that of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from laborlens.functions.spread import TASKS_A_CORE, spread
from laborlens.sources.folders import fresh_folder, kept

#: Centres that every task holds at most.
MOST_CENTRES = 1024
#: Values of the vectors that meet in one task at most, on each side, and vectors that are not dealt over several.
BLOCK_VALUES = 2**21
LEAST_BLOCK = 4096
#: Queries and members of one product, and rows that are asked for at a time.
ROWS, WIDE = 256, 8192
#: Partitions for each block or pair of blocks, so that few share one, and partitions at most.
SPARSE, MOST_TASKS = 4, 4096
LEAST_NORM = 1e-9
PLACES = 6
_ONE = 10**PLACES
_SLACK = 4 / _ONE  # of similarities that are rounded
_FOUND = "q long, id long, similarity double, computed long"
_FOUND_ARROW = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64()), ("computed", pa.int64())])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _bound(similarity: np.ndarray) -> np.ndarray:
    """How far a vector can be that is as similar."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (similarity - _SLACK))) + 1e-9


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    v = flat.reshape(n, -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _directed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)``; vectors that are null, nearly null or not finite have no direction and no neighbours. Floats stay floats."""
    floats = isinstance(getattr(vectors.schema[vec_col].dataType, "elementType", None), FloatType)
    norm = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{'float' if floats else 'double'}>").alias("v")).where((norm > LEAST_NORM) & (norm < math.inf))


def _blocks(middles: np.ndarray, sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """``(cell, first block, blocks)``: near cells share a block of ``most`` members at most, a cell with more is dealt over several."""
    out, at = [], 0
    for c, n in sizes.items():
        if n > most:
            out.append((c, at, math.ceil(n / most)))
            at += out[-1][2]
    left = np.array([c for c, n in sizes.items() if n <= most], dtype=int)
    while len(left):
        left = left[np.argsort(_distances(middles[left], middles[left[:1]])[:, 0], kind="stable")]
        fit = max(1, int((np.cumsum([sizes[c] for c in left]) <= most).sum()))
        out += [(int(c), at, 1) for c in left[:fit]]
        left, at = left[fit:], at + 1
    return out


def _first(row: np.ndarray, s: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Where the ``top`` hits of each row are, by row and rank."""
    order = np.lexsort((ids, -s, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < top]


class _Meeting:
    """Some queries and their best members so far; similarities are whole millionths.

    Products in single precision rule out what can't be among the ``top``; the others are worked out in doubles.
    """

    def __init__(self, q: np.ndarray, ids: np.ndarray, tau: np.ndarray, top: int):
        self.q, self.ids, self.top, self.small = q, ids, top, q.astype(np.float32)
        self.row, self.s, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = 1.0 - tau * tau / 2.0
        self.loose = 2 * (q.shape[1] + 8) * 2.0**-24 + 1 / _ONE  # twice what a product may be off, and rounding

    def meet(self, m: np.ndarray, small: np.ndarray, ids: np.ndarray, part: np.ndarray) -> None:
        """The queries meet the members ``part``; a few hits a query are taken as they are, of more the bound is raised, and what ties then is sorted out in doubles."""
        s, many = self.small @ small[part].T, 4 * (self.top + 1) * len(self.q)
        hit = s >= (self.least - self.loose).astype(np.float32)[:, None]
        if np.count_nonzero(hit) > many:
            hit = s >= (np.maximum(self.least, self._likely(s)) - self.loose).astype(np.float32)[:, None]
        row, at = self._all(m, ids, part) if np.count_nonzero(hit) > many else np.divmod(np.flatnonzero(hit), len(part))
        other = ids[part[at]] != self.ids[row]
        row, at = row[other], part[at[other]]
        exact = np.rint(np.einsum("ij,ij->i", self.q[row], m[at]) * _ONE).astype(np.int64)
        row, exact, found = (np.concatenate(x) for x in ((self.row, row), (self.s, exact), (self.id, ids[at])))
        first = _first(row, exact, found, self.top)
        self.row, self.s, self.id = row[first], exact[first], found[first]
        full = np.flatnonzero(np.bincount(self.row, minlength=len(self.q)) == self.top)
        self.least[full] = np.maximum(self.least[full], self.s[np.searchsorted(self.row, full, "right") - 1] / _ONE)

    def _likely(self, s: np.ndarray) -> np.ndarray:
        """What ``top`` members besides the query reach at least: members in groups, the best of each group."""
        groups = 12 * (self.top + 1)
        deep = s.shape[1] // groups
        if deep < 2:
            return np.full(len(s), -3.0)
        best = s[:, : deep * groups].reshape(len(s), deep, groups).max(axis=1)
        return np.partition(best, groups - self.top - 1, axis=1)[:, groups - self.top - 1]

    def _all(self, m: np.ndarray, ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of all pairs by similarity and id, one more than ``top`` for the query itself."""
        by_id, n = np.argsort(ids[part]), min(self.top + 1, len(part))
        place = np.arange(len(part)) - np.rint(self.q @ m[part[by_id]].T * _ONE).astype(np.int64) * len(part)
        return np.repeat(np.arange(len(self.q)), n), by_id[np.argpartition(place, n - 1, axis=1)[:, :n].ravel()]


def _nearest(q: np.ndarray, q_ids: np.ndarray, tau: np.ndarray, m: np.ndarray, ids: np.ndarray, cell: np.ndarray, r: np.ndarray, middles: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(q, id, similarity, queries, computed)`` for some queries at a time: the best of a block's members, and for how many a product was made.

    Members lie by cell and distance from its centre, so that what the bound leaves of a
    cell is a run of them. Queries first meet the cell that is nearest to them.
    """
    cells, at = np.unique(cell, return_inverse=True)
    order = np.lexsort((r, at))
    m, ids, place, start = m[order], ids[order], (4.0 * at + r)[order], 4.0 * np.arange(len(cells))
    small, away, own = m.astype(np.float32), _distances(q, middles[cells]), np.isin(q_ids, ids)
    near = away.argmin(axis=1)
    order = np.lexsort((away.min(axis=1), near))
    for c in np.unique(near):
        of_cell = order[near[order] == c]
        for some in np.array_split(of_cell, math.ceil(len(of_cell) / ROWS)):
            meeting, t, seen = _Meeting(q[some], q_ids[some], tau[some], top), tau[some, None], 0
            for now in (np.arange(len(cells)) == c, np.arange(len(cells)) != c):
                low = np.searchsorted(place, start + np.maximum(0.0, (away[some] - t).min(axis=0)), "left")
                high = np.searchsorted(place, start + np.minimum(3.0, (away[some] + t).max(axis=0)), "right")
                now &= low < high
                step = np.zeros(len(m) + 1, np.int64)
                np.add.at(step, low[now], 1)
                np.add.at(step, high[now], -1)
                asked = np.flatnonzero(np.cumsum(step))
                for x in range(0, len(asked), WIDE):
                    meeting.meet(m, small, ids, asked[x : x + WIDE])
                seen += len(asked)
                t = np.minimum(t, _bound(meeting.least)[:, None])
            yield q_ids[some][meeting.row], meeting.id, meeting.s / _ONE, q_ids[some], seen - own[some].astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    return _unit(table["v"].combine_chunks().flatten().to_numpy(), len(table))


def _met(asking: pa.Table, there: pa.Table, middles: np.ndarray, top: int) -> pa.Table:
    """``(q, id, similarity, computed)``; one row a query has a null id and the number of similarities computed for it."""
    parts = []
    if len(asking) and len(there):
        tau, members = asking["tau"].to_numpy(), (there[x].to_numpy() for x in ("id", "cell", "r"))
        parts = list(_nearest(_matrix(asking), asking["q"].to_numpy(), tau, _matrix(there), *members, middles, top))
    hits = [(q, pa.array(ids), pa.array(s), pa.array(np.zeros(len(q), np.int64))) for q, ids, s, _, _ in parts]
    counts = [(q, pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.float64()), pa.array(n)) for *_, q, n in parts]
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(q), *rest], schema=_FOUND_ARROW) for q, *rest in hits + counts], _FOUND_ARROW)


def _asking(b: pd.DataFrame, d: np.ndarray, go: np.ndarray, most: int) -> Iterator[pd.DataFrame]:
    """A row for each query and block (``cell``) where ``go`` is set, ``most`` rows at a time: a batch of queries asks for nearly all blocks where no bound helps."""
    row, cell = np.nonzero(go)
    q, v, tau = (b[x].to_numpy() for x in ("id", "v", "tau"))
    for at in range(0, len(row), most):
        r, of = row[at : at + most], cell[at : at + most]
        yield pd.DataFrame({"q": q[r], "qv": v[r], "cell": of, "dq": d[r, of], "tau": tau[r]})


def knn_join(vectors: DataFrame, top: int, id_col: str = "vec_id", vec_col: str = "embedding", centres: int | None = None, block: int | None = None) -> DataFrame:
    """``(q, rank, id, similarity, computed)``: the ``top`` most similar other vectors of each vector.

    Similarities are cosines to six places, equal ones go by id; ``computed`` is how
    many were worked out for the query, the rest being ruled out. In a task ``block``
    queries meet ``block`` members at most. Ids are unique; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    directed = _directed(vectors, id_col, vec_col)
    kind, n = directed.schema["v"].dataType.simpleString(), directed.count()
    k = min(MOST_CENTRES, centres or math.ceil(math.sqrt(max(n, 1))))
    chosen = directed.orderBy(F.xxhash64("id"), "id").limit(k).collect()
    middle = _unit(np.array([r["v"] for r in chosen]), len(chosen)) if chosen else np.zeros((0, 1))
    middles = spark.sparkContext.broadcast(middle)
    even = math.ceil(n / math.ceil(math.sqrt(TASKS_A_CORE * spark.sparkContext.defaultParallelism)))
    block = block or min(max(1, BLOCK_VALUES // middle.shape[1]), max(LEAST_BLOCK, even))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _distances(_unit(np.stack(b["v"].to_numpy()), len(b)), middles.value)
                b["cell"] = d.argmin(axis=1)
                b["r"] = d.min(axis=1)
                yield b

    members = kept(spread(directed, "id").mapInPandas(deal, f"id long, v {kind}, cell int, r double"), fresh_folder(spark, "cells"))
    dealt = _blocks(middle, {r["cell"]: r["count"] for r in members.groupBy("cell").count().collect()}, block)  # one row a centre
    blocks = max((at + of for _, at, of in dealt), default=1)
    dealt = spark.createDataFrame(dealt, "cell int, at int, of int")
    members = members.join(F.broadcast(dealt), "cell").select("id", "v", "cell", "r", (F.col("at") + F.pmod(F.xxhash64("id"), "of")).cast("int").alias("block"))

    def alone(there: pa.Table) -> pa.Table:
        asking = pa.table([there["id"], there["v"], pa.array(np.full(len(there), 3.0))], ["q", "v", "tau"])
        return _met(asking, there, middles.value, top)

    own = kept(members.repartition(SPARSE * blocks, "block").groupBy("block").applyInArrow(alone, _FOUND), fresh_folder(spark, "own"))
    worst = own.where("id is not null").groupBy("q").agg(F.count("*").alias("n"), F.min("similarity").alias("s"))
    tau = F.when(F.col("n") == top, F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * (F.col("s") - _SLACK))) + 1e-9)
    bounded = spread(members, "id").join(worst.select(F.col("q").alias("id"), tau.alias("tau")), "id", "left").withColumn("tau", F.coalesce("tau", F.lit(3.0)))
    reach = bounded.groupBy("block", "cell").agg(F.max("r").alias("radius"), F.max(F.col("r") + F.col("tau")).alias("reach")).orderBy("block", "cell").collect() if blocks > 1 else []  # one row a cell, or a block
    part, cell, radius, far = (np.array([r[x] for r in reach]) for x in ("block", "cell", "radius", "reach"))
    near = np.nonzero(_distances(middle[cell], middle[cell]) - radius <= far[:, None] + 1e-6) if reach else ((), ())
    pairs = sorted({(int(part[a]), int(part[b])) for a, b in zip(*near) if part[a] != part[b]})
    found = own
    if pairs:
        names, first = np.unique(part, return_index=True)

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for mine, b in batch.groupby("block"):
                    d = _distances(_unit(np.stack(b["v"].to_numpy()), len(b)), middles.value)
                    low = np.minimum.reduceat(d[:, cell] - radius, first, axis=1)
                    for rows in _asking(b, low, (low <= b["tau"].to_numpy()[:, None]) & (names != mine), WIDE):
                        yield pd.DataFrame({"q": rows["q"], "v": rows["qv"], "mine": mine, "block": names[rows["cell"]], "tau": rows["tau"]})

        tasks = min(SPARSE * len(pairs), MOST_TASKS)
        q = bounded.mapInPandas(ask, f"q long, v {kind}, mine int, block int, tau double").repartition(tasks, "mine", "block")
        m = members.join(F.broadcast(spark.createDataFrame(pairs, "mine int, block int")), "block").select("mine", "block", "id", "v", "cell", "r").repartition(tasks, "mine", "block")
        found = own.union(q.groupBy("mine", "block").cogroup(m.groupBy("mine", "block")).applyInArrow(lambda asking, there: _met(asking, there, middles.value, top), _FOUND))
    of_q = Window.partitionBy("q")
    best = found.select("q", F.row_number().over(of_q.orderBy(F.desc("similarity"), "id")).alias("rank"), "id", "similarity", F.sum("computed").over(of_q).alias("computed"))
    return best.where((F.col("rank") <= top) & F.col("id").isNotNull())
