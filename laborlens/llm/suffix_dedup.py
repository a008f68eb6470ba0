"""Removal of repeated byte strings by sorted suffixes.

The suffixes that start at the anchors of a bucket (and the mirrored ones that
end there) are put in order by deep-shallow sorting: multikey quicksort down to a
shallow depth, then blind tries for the groups whose common prefix is longer.
Longest common prefixes of neighbours give, for each pair of kinds, how far they
agree to the right and to the left of the anchor, and so the repeated strings of
``size`` bytes. ``windows.repeated`` holds the plan round it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from laborlens.llm.windows import BUCKET_CAP, as_bytes, merged, named, repeated

_STEP = 8  # bytes that multikey quicksort compares at once


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] does not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class _Node:
    __slots__ = ("depth", "kids", "leaf")

    def __init__(self, depth: int, leaf: int | None = None):
        self.depth, self.leaf, self.kids = depth, leaf, {}


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """Order of a group with a common prefix of ``depth`` bytes.

    Nodes keep only where they branch and the byte each branch starts with. A
    string goes down blindly, is compared once with a leaf it ends at, and is
    hung in where the two part. The end of a string sorts before any byte.
    """

    def byte(i: int, at: int) -> int:
        s = strings[i]
        return s[at] if at < len(s) else -1

    def any_leaf(node: _Node) -> int:
        while node.leaf is None:
            node = next(iter(node.kids.values()))
        return node.leaf

    same: dict[int, list[int]] = {}
    root = _Node(len(strings[group[0]]), group[0])
    for i in group[1:]:
        node = root
        while node.leaf is None and byte(i, node.depth) in node.kids:
            node = node.kids[byte(i, node.depth)]
        other = any_leaf(node)
        part = depth + common_prefix(strings[i][depth:], strings[other][depth:])
        if part == len(strings[i]) == len(strings[other]):
            same.setdefault(other, []).append(i)
            continue
        parent, node = None, root
        while node.leaf is None and node.depth < part:
            parent, node = node, node.kids[byte(i, node.depth)]
        leaf = _Node(len(strings[i]), i)
        if node.leaf is None and node.depth == part:
            node.kids[byte(i, part)] = leaf
            continue
        fork = _Node(part)
        fork.kids = {byte(other, part): node, byte(i, part): leaf}
        if parent is None:
            root = fork
        else:
            parent.kids[byte(i, parent.depth)] = fork
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.leaf is None:
            stack += [node.kids[c] for c in sorted(node.kids, reverse=True)]
        else:
            order += [node.leaf, *same.get(node.leaf, ())]
    return order


def deep_shallow(strings: list[bytes], shallow: int = 64) -> list[int]:
    """Indices of the strings in order."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            order += group
        elif depth >= shallow:
            order += blind_trie(strings, group, depth)
        else:
            keys = [strings[i][depth : depth + _STEP] for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less, equal, more = [], [], []
            for i, x in zip(group, keys):
                (less if x < pivot else equal if x == pivot else more).append(i)
            # A pivot shorter than the step ends every string equal to it here.
            stack.append((more, depth))
            if len(pivot) < _STEP:
                stack += [([i], depth) for i in reversed(equal)]
            else:
                stack.append((equal, depth + _STEP))
            stack.append((less, depth))
    return order


class Agreement:
    """How far the strings of a bucket agree, from their neighbours in sorted order; memory grows with the bucket, not its square."""

    def __init__(self, strings: list[bytes]):
        self.order = np.array(deep_shallow(strings))
        self.place = np.argsort(self.order)
        self.near = np.array([common_prefix(strings[a], strings[b]) for a, b in zip(self.order, self.order[1:])], dtype=np.int64)

    def with_all(self, i: int) -> np.ndarray:
        """Longest common prefixes of string i with each string, 0 with itself."""
        p, out = self.place[i], np.zeros(len(self.order), dtype=np.int64)
        out[self.order[:p]] = np.minimum.accumulate(self.near[:p][::-1])[::-1]
        out[self.order[p + 1 :]] = np.minimum.accumulate(self.near[p:])
        return out


def sorted_suffixes(size: int):
    """Solver of a bucket: repeated strings round the anchor, as one span of each kind."""

    def solve(kinds: list[tuple]) -> Iterator[tuple[int, int, int]]:
        if all(x[4] for x in kinds):
            return
        ahead = Agreement([p[a:] for p, a, *_ in kinds])
        back = Agreement([p[:a][::-1] for p, a, *_ in kinds])
        for i, (_, a, _, _, settled) in enumerate(kinds):
            if not settled:
                right, left = ahead.with_all(i), back.with_all(i)
                fits = left + right >= size
                fits[i] = False
                if fits.any():
                    yield i, a - int(left[fits].max()), a + int(right[fits].max())

    return solve


def remove_repeats(docs: DataFrame, size: int = 400, k: int = 100, bucket_cap: int = BUCKET_CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)`` for each row; kept is binary.

    A byte of the UTF-8 text goes if a string of ``size`` bytes over it also
    starts at any other position of the corpus. Null text is empty. Repeated rows
    are repeats like any other and each come back; a null id is kept as it is.
    Texts shorter than ``size`` stay whole; an empty table gives no rows.
    """
    rows = named(docs, id_col, text_col)
    spans = repeated(rows, False, size, k, False, sorted_suffixes(size), bucket_cap)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in b.columns)):
                body, at, kept, cuts = as_bytes(text), 0, [], merged(found)
                for lo, hi in cuts:
                    kept.append(body[at:lo])
                    at = hi
                rest = b"".join([*kept, body[at:]])
                out.append((doc_id, len(body), len(body) - len(rest), len(cuts), rest, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out)) or [()] * 6
            types = (pa.int64(),) * 4 + (pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    both = rows.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
