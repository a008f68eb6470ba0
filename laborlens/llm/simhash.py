"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints at
distance 2 or less agree on the upper segment or differ in at most one bit of
the lower one, so each fingerprint probes its own upper segment and the Hamming
ball of radius 1 round its lower one (1 + 33 look-ups), fetches the
fingerprints stored there and verifies the whole distance.

A segment value with more than ``bucket_cap`` fingerprints is not read out pair
by pair. Fingerprints that meet in one take an exact other way: two
fingerprints are within 2 bits if and only if the balls of radius 1 round them
share a point, so each sends its 65 points and links to the least fingerprint of
each. That is linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import cut
from laborlens.llm.graph import components

SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a whole text as an unsigned integer of 64 bits; no words give 0."""
    norm = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())  # bytes: A-Z and ASCII white space only
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(norm)]
    hashed, seed = xxhash.xxh64_intdigest, SEED
    if len(starts) < words:
        return hashed(norm, seed)
    counts, n = np.zeros(64, dtype=np.int64), len(starts) - words + 1
    for at in range(0, n, _CHUNK):
        some = [hashed(norm[a:b], seed) for a, b in zip(starts[at : min(at + _CHUNK, n)], ends[at + words - 1 :])]
        rows = np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for each row, fp as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _upper():
    return F.shiftrightunsigned("fp", 32)


def _lower():
    return F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))


def near_links(prints: DataFrame, bucket_cap: int = 64, few: bool = False) -> DataFrame:
    """Links ``(u, v)`` between nodes whose fingerprints differ in 1 or 2 bits.

    ``prints``: ``(fp, node)``, each fingerprint once. Every class that links by
    the distance is connected by the links returned; copies need none. ``few``
    fingerprints, in one partition, stay in it.
    """
    here = F.broadcast if few else (lambda x: x)
    stored = prints.select("fp", "node", F.explode(F.array(_upper(), _lower())).alias("key"))
    ball = [_lower(), *(_lower().bitwiseXOR(F.lit(1 << i)) for i in range(32))]
    probes = prints.select("fp", "node", F.explode(F.array(_upper(), *ball)).alias("key"))
    hot = cut(stored.groupBy("key").count().where(F.col("count") > bucket_cap).select("key"))
    any_hot = not hot.isEmpty()
    if any_hot:
        met = probes.join(here(hot), "key", "left_semi").select("fp", "node").distinct()
        probes, stored = probes.join(here(hot), "key", "left_anti"), stored.join(here(hot), "key", "left_anti")
    a, b = probes.alias("a"), stored.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2
    links = a.join(here(b), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    if any_hot:
        points = met.select("node", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(64)))).alias("point"))
        centre = points.groupBy("point").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("point", "v")
        links = links.union(points.join(here(centre), "point").where("node <> v").select(F.col("node").alias("u"), "v"))
    return (links.coalesce(1) if few else links).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bucket_cap: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most 2 bits.
    Empty and null texts have fingerprint zero and link like any other. Repeated
    rows come back as often as they are there. A row with a null id takes the
    component of its fingerprint, if a row with an id has that, else null; it
    never connects others. An empty table gives no rows.
    """
    each = cut(fingerprints(docs, words, id_col, text_col))
    prints = each.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(near_links(cut(prints), bucket_cap))
    labels = prints.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return each.join(labels, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
