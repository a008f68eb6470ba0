"""Substring dedup on word windows by super-k-mer partitioning.

A super-k-mer travels as one packed string to the bucket of its minimiser; there
its windows are cut out and sorted, and each run of equal windows gives their
first document. ``windows.repeated`` holds the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from laborlens.llm.windows import BUCKET_CAP, merged, named, repeated, words_joined


def sorted_windows(size: int):
    """Solver of a bucket: windows sorted, those that start in a smaller document marked."""

    def solve(kinds: list[tuple]) -> Iterator[tuple[int, int, int]]:
        rows = []
        for i, (packed, _, n, k1, _) in enumerate(kinds):
            gaps = [-1, *(j for j, c in enumerate(packed) if c == 32), len(packed)]
            rows += [(packed[gaps[o] + 1 : gaps[o + size]], k1, i, o) for o in range(n)]
        rows.sort()
        open_: dict[int, list[dict]] = {}
        for _, same in groupby(rows, key=lambda x: x[0]):
            first = None
            for _, k1, i, at in same:
                first = k1 if first is None else first
                if k1 > first:
                    open_.setdefault(i, []).append({"lo": at, "hi": at + size})
        for i, found in open_.items():
            for lo, hi in merged(found):
                yield i, lo, hi

    return solve


def remove_repeats(docs: DataFrame, size: int = 50, k: int = 12, bucket_cap: int = BUCKET_CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text, kept_sha256)`` for each row.

    A word goes if a window of ``size`` words over it also starts in a document
    with a smaller id. Null text has no words. A null id counts as larger than
    any other and not as smaller than another null. Rows that share an id never
    count against each other; repeated rows each come back. Texts shorter than a
    window stay whole; an empty table gives no rows.
    """
    rows = named(docs, id_col, text_col)
    spans = repeated(rows, True, size, k, True, sorted_windows(size), bucket_cap)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in b.columns)):
                words = words_joined(text).split(b" ") if text and words_joined(text) else []
                n, kept, at = len(words), [], 0
                for lo, hi in merged(found):
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                body = b" ".join(kept)
                out.append((doc_id, n, n - len(kept), body.decode("utf-8", "replace"), hashlib.sha256(body).hexdigest()))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    both = rows.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
