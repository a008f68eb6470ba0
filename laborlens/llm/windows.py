"""Repeated windows of fixed length over a corpus, as one Spark plan.

A window is ``size`` consecutive units (bytes or words) of one text. Every window
has an anchor, the leftmost least k-gram by hash inside it; equal windows have
equal anchors. Consecutive windows with one anchor form a super-k-mer, one packed
string. The plan

1. scans the texts for super-k-mers and ships only their hashes (anchor, content),
   counted by anchor with map-side combining;
2. settles anchors that are met once (nothing repeats) or always with the same
   packed string (everything repeats) from those counts;
3. fetches one packed string of each kind for the rest and sends it to the bucket
   of its anchor, where the operator's own sorter finds the repeated windows;
4. treats a bucket whose anchor is met more than ``bucket_cap`` times window by
   window instead: hashes counted with map-side combining, so no bucket has to fit in a task.

Rows are named by (k1, k2): the id (null: the largest long) and a hash of the
content. Equal rows share a name and so a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import cut

NO_ID = (1 << 63) - 1
#: Occurrences of an anchor up to which its bucket is sorted in one task.
BUCKET_CAP = 4096
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, size=256, dtype=np.uint64)
_GROUP = 1 << 18  # units hashed at once; a longer text goes alone


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _BACK):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any range of a sequence of 64-bit units, from prefix sums modulo 2**64."""

    def __init__(self, units: np.ndarray):
        n = 1 << max(10, len(units) + 1).bit_length()
        ahead, self.back = _powers(n)
        self.sums = np.zeros(len(units) + 1, dtype=np.uint64)
        np.cumsum(units * ahead[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """Hash of each k-gram."""
        n = len(self.sums) - k
        return _mixed((self.sums[k:] - self.sums[:n]) * self.back[:n] + np.uint64(k))


def word_bounds(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words that single spaces separate."""
    gaps = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(norm)]))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_joined(text: str | None) -> bytes:
    return b" ".join(as_bytes(text).split())


def _content(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of byte ranges: unlike the rolling sums, which only choose anchors, no construction of repeated words makes it collide."""
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts)).view(np.int64)


def _units(texts: list[bytes], by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Unit hashes of the texts end to end, and how many each text has."""
    if not by_word:
        return _BYTE[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.array([len(t) for t in texts], dtype=np.int64)
    has = np.array([bool(t) for t in texts])
    joined = b" ".join(t for t in texts if t)
    sizes = np.zeros(len(texts), dtype=np.int64)
    if not joined:
        return np.zeros(0, dtype=np.uint64), sizes
    starts, ends = word_bounds(joined)
    sizes[has] = [t.count(b" ") + 1 for t in texts if t]
    return Rolling(_BYTE[np.frombuffer(joined, dtype=np.uint8)]).of(starts, ends), sizes


def super_kmers(texts: list[bytes], by_word: bool, size: int, k: int) -> dict[str, np.ndarray]:
    """Super-k-mers of the texts: text number, first window s, windows n, anchor a (from s), anchor and content hash."""
    units, sizes = _units(texts, by_word)
    none = {c: np.zeros(0, dtype=np.int64) for c in ("text", "s", "n", "a", "key", "full")}
    if len(units) < size:
        return none
    roll, text_of = Rolling(units), np.repeat(np.arange(len(texts)), sizes)
    grams = roll.every(k)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, wide = 1, size - k + 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    at = np.flatnonzero(text_of[: len(units) - size + 1] == text_of[size - 1 :])
    if not len(at):
        return none
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    n = np.diff(np.concatenate((first, [len(at)])))
    s, a = at[first], anchor[first]
    base = np.concatenate(([0], np.cumsum(sizes)))
    if by_word:
        joined = b" ".join(t for t in texts if t)
        starts, ends = word_bounds(joined)
        full = _content(joined, starts[s], ends[s + n - 2 + size])
    else:
        full = _content(b"".join(texts), s, s + n - 1 + size)
    return {"text": text_of[s], "s": s - base[text_of[s]], "n": n, "a": a - s, "key": grams[a].view(np.int64), "full": full}


def _grouped(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > _GROUP:
            yield at, texts[at:i]
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, texts[at:]


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(k1, k2, doc_id, text)``, whatever other columns there are."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("k1"), F.xxhash64(text, doc_id.isNull()).alias("k2"), doc_id.alias("doc_id"), text.alias("text"))


def apart(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``~key`` in place of a key that it is grouped by: a join on that deals it anew, so that AQE may split a hot key."""
    return df.withColumn(f"not_{key}", F.bitwise_not(key)).drop(key)


def repeated(
    docs: DataFrame,
    by_word: bool,
    size: int,
    k: int,
    later_only: bool,
    solve: Callable[[list[tuple]], Iterator[tuple[int, int, int]]],
    bucket_cap: int = BUCKET_CAP,
) -> DataFrame:
    """``(k1, k2, spans)`` for texts with repeated windows; spans are ``array<struct<lo,hi>>`` in units, in no order.

    ``docs`` is what ``named`` returns. With ``later_only`` a window counts where
    a text with a smaller k1 has it too, else where any other position has it.
    ``solve`` gets the kinds of one bucket, ``(packed, a, n, k1, settled)``, and
    yields ``(number of the kind, lo, hi)``, counted from the start of its packed string.
    """
    squeeze = words_joined if by_word else as_bytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (c.to_numpy(zero_copy_only=False) for c in b.columns[:2])
            for at, some in _grouped([squeeze(t) for t in b.column(2).to_pylist()]):
                x = super_kmers(some, by_word, size, k)
                row = x["text"] + at
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k1[row], k2[row], x["s"].astype(np.int32), x["n"].astype(np.int32), x["a"].astype(np.int32), x["key"], x["full"])], names=["k1", "k2", "s", "n", "a", "key", "full"])

    found = docs.select("k1", "k2", "text").mapInArrow(scan, "k1 long, k2 long, s int, n int, a int, key long, full long")
    counts = found.groupBy("key").agg(F.count("*").alias("times"), F.min("full").alias("f1"), F.max("full").alias("f2"), F.min("k1").alias("first"), F.max("k1").alias("last"))
    counts = counts.where("first < last" if later_only else "times > 1").select("key", "first", F.col("times").alias("met"), (F.col("f1") == F.col("f2")).alias("same"))
    joined = apart(counts, "key")
    hits = cut(found.join(joined, F.col("key") == F.bitwise_not("not_key")).drop("not_key"))

    whole = (F.col("s").alias("lo"), (F.col("s") + F.col("n") - 1 + size).alias("hi"))
    settled = hits.where("same").where("k1 > first" if later_only else "true").select("k1", "k2", *whole)
    mixed = hits.where("not same")
    kinds = cut(mixed.groupBy("key", "full").agg(F.count("*").alias("times"), F.max("met").alias("met"), F.min(F.struct("k1", "k2", "s", "n", "a")).alias("rep")).select("key", "full", "times", "met", "rep.*"))
    several = kinds.where("times > 1").select(F.bitwise_not("key").alias("not_key"), F.col("full").alias("full2"), F.col("k1").alias("first_k1"), "times")
    shared = mixed.join(several, (F.col("key") == F.bitwise_not("not_key")) & (F.col("full") == F.col("full2")))
    also = shared.where("k1 > first_k1" if later_only else "true").select("k1", "k2", *whole)

    any_hot = not kinds.where(F.col("met") > bucket_cap).isEmpty()
    if later_only:  # a document that has its packed string first may have it in several places
        kinds = kinds.where("times = 1").unionByName(shared.where("k1 = first_k1").select(kinds.columns))
    spans = settled.union(also).union(_by_bucket(docs, kinds.where(F.col("met") <= bucket_cap), by_word, size, later_only, solve, squeeze))
    if any_hot:
        spans = spans.union(_by_window(docs, kinds.where(F.col("met") > bucket_cap), by_word, size, later_only, squeeze))
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _wanted(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Texts with the list of kinds that they represent."""
    lists = kinds.groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "full", "s", "n", "a", "times")).alias("kinds"))
    return docs.select("k1", "k2", "text").join(lists.hint("shuffle_hash"), ["k1", "k2"])


def _packed(text: bytes, by_word: bool, size: int, kinds: list[dict]) -> Iterator[bytes]:
    if not by_word:
        return (text[x["s"] : x["s"] + x["n"] - 1 + size] for x in kinds)
    starts, ends = word_bounds(text)
    return (text[starts[x["s"]] : ends[x["s"] + x["n"] - 2 + size]] for x in kinds)


def _by_bucket(docs: DataFrame, kinds: DataFrame, by_word: bool, size: int, later_only: bool, solve: Callable, squeeze: Callable) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "full", "k1", "k2", "s", "n", "a", "times", "packed")
        for b in batches:
            for r in range(b.num_rows):
                k1, k2, kinds = b.column(0)[r].as_py(), b.column(1)[r].as_py(), b.column(3)[r].as_py()
                text = squeeze(b.column(2)[r].as_py())
                rows = [(x["key"], x["full"], k1, k2, x["s"], x["n"], x["a"], x["times"], p) for x, p in zip(kinds, _packed(text, by_word, size, kinds))]
                types = (pa.int64(),) * 4 + (pa.int32(),) * 3 + (pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and content; a bucket may span batches."""

        def emit(bucket: dict[int, tuple], places: dict[int, list[tuple]]) -> None:
            if len(bucket) > 1:
                fulls = list(bucket)
                for i, lo, hi in solve(list(bucket.values())):
                    out.extend((k1, k2, s + lo, s + hi) for k1, k2, s in places[fulls[i]])

        key, bucket, places, out = None, {}, {}, []
        for b in batches:
            for key_, full, k1, k2, s, n, a, times, packed in zip(*(c.to_pylist() for c in b.columns)):
                if key_ != key:
                    emit(bucket, places)
                    key, bucket, places = key_, {}, {}
                bucket[full] = (packed, a, n, k1, times > 1 and not later_only)
                places.setdefault(full, []).append((k1, k2, s))
            if out:
                yield _spans(out)
                out.clear()
        emit(bucket, places)
        if out:
            yield _spans(out)

    packed = _wanted(docs, kinds).mapInArrow(pack, "key long, full long, k1 long, k2 long, s int, n int, a int, times long, packed binary")
    return packed.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "k1 long, k2 long, lo int, hi int")


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k1", "k2", "lo", "hi"])


def _by_window(docs: DataFrame, kinds: DataFrame, by_word: bool, size: int, later_only: bool, squeeze: Callable) -> DataFrame:
    """The exact way for buckets over the cap: every window of every kind by its hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                k1, k2, kinds = b.column(0)[r].as_py(), b.column(1)[r].as_py(), b.column(3)[r].as_py()
                body = squeeze(b.column(2)[r].as_py())
                starts, ends = word_bounds(body) if by_word else (np.arange(len(body)), np.arange(1, len(body) + 1))
                at = np.concatenate([np.arange(x["s"], x["s"] + x["n"]) for x in kinds])
                key = np.repeat([x["key"] for x in kinds], [x["n"] for x in kinds])
                cols = [np.full(len(at), k1), np.full(len(at), k2), key, _content(body, starts[at], ends[at + size - 1]), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k1", "k2", "key", "w", "lo"])

    every = _wanted(docs, kinds).mapInArrow(each, "k1 long, k2 long, key long, w long, lo int")
    met = every.groupBy("key", "w").agg(F.count("*").alias("times"), F.min("k1").alias("first"), F.max("k1").alias("last"))
    met = met.where("first < last" if later_only else "times > 1").select(F.bitwise_not("key").alias("not_key"), F.col("w").alias("w2"), "first")
    on = (F.col("key") == F.bitwise_not("not_key")) & (F.col("w") == F.col("w2"))
    return every.join(met, on).where("k1 > first" if later_only else "true").select("k1", "k2", "lo", (F.col("lo") + size).cast("int").alias("hi"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap or touch made one."""
    out: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]
