"""Fill-in-the-middle transformation of texts on ropes.

A text becomes a rope: a tree whose leaves hold a few thousand units and whose
nodes cache how many units and code points lie below. Two cuts at unit ranks give
prefix, middle and suffix as trees; the output puts them together again in another
order with sentinels between. The inverse finds the sentinels in a rope of the
output, splits it there by code points and concatenates the parts in their first
order. Splits and concatenations share leaves, so no text is copied until it is written.

A row is transformed by its own id and text alone: no shuffle, nothing is gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# What marks prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a leaf.
LEAF = 4096
#: How a text falls into units; the units of a text give it back when joined.
UNITS = {"point": None, "word": re.compile(r"\s*\S+\s*\Z|\s*\S+|\s+\Z"), "line": re.compile(r"[^\n]*\n|[^\n]+")}


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (``text``) or two ropes, with the units and code points below."""

    units: int
    points: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[Rope]:
        todo = [self]
        while todo:
            at = todo.pop()
            if at.left is None:
                yield at
            else:
                todo += (at.right, at.left)

    def __str__(self) -> str:
        return "".join(x.text for x in self.leaves())


NOTHING = Rope(0, 0)


def concat(a: Rope, b: Rope) -> Rope:
    if not a.points or not b.points:
        return a if a.points else b
    return Rope(a.units + b.units, a.points + b.points, "", a, b)


def build(text: str, unit: str = "point", leaf: int = LEAF) -> Rope:
    """A balanced rope over the units of a text."""
    if UNITS[unit] is None:
        row = [Rope(len(t), len(t), t) for t in (text[at : at + leaf] for at in range(0, len(text), leaf))]
    else:
        every = UNITS[unit].findall(text)
        row = [Rope(len(part), len(t), t) for part in (every[at : at + leaf] for at in range(0, len(every), leaf)) for t in ["".join(part)]]
    while len(row) > 1:
        row = [concat(*row[at : at + 2]) if at + 1 < len(row) else row[at] for at in range(0, len(row), 2)]
    return row[0] if row else NOTHING


def split(rope: Rope, rank: int, unit: str | None = "point") -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest; with ``unit`` None the ranks are those of code points, whatever the units."""
    before, after = [], []
    while rope.left is not None:
        n = rope.left.points if unit is None else rope.left.units
        if rank < n:
            after.append(rope.right)
            rope = rope.left
        else:
            before.append(rope.left)
            rope, rank = rope.right, rank - n
    if unit is None or UNITS[unit] is None:
        parts = rope.text[:rank], rope.text[rank:]
    else:
        every = UNITS[unit].findall(rope.text)
        parts = "".join(every[:rank]), "".join(every[rank:])
    a, b = (Rope(n, len(t), t) for n, t in zip((rank, rope.units - rank), parts))
    return concat(reduce(concat, before, NOTHING), a), reduce(lambda x, y: concat(x, y), reversed(after), b)


def find(rope: Rope, mark: str) -> int:
    """Code points before the first ``mark``, which may lie across leaves; -1 where there is none."""
    seen, tail = 0, ""
    for x in rope.leaves():
        here = tail + x.text
        if (at := here.find(mark)) >= 0:
            return seen - len(tail) + at
        seen += len(x.text)
        tail = here[len(here) - len(mark) + 1 :] if len(mark) > 1 else ""
    return -1


def chances(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight hex digits of the SHA-256 of ``seed:id``; a null id reads ``null``."""
    hexed = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[at : at + 8], 16) for at in range(0, 32, 8)]


def rearranged(doc_id: int | None, text: str | None, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "point") -> tuple:
    """``(units, form, prefix_chars, middle_chars, output)`` of one text; both counts are None for the plain form."""
    text = text or ""
    rope, (h1, h2, h3, h4) = build(text, unit), chances(doc_id, seed)
    n = rope.units
    if not text or h3 % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(rope, high, unit)
    prefix, middle = split(head, low, unit)
    p, s, m = (Rope(0, len(x), x) for x in (PREFIX, SUFFIX, MIDDLE))
    if h4 % 100 < spm:
        form, order = "spm", (s, suffix, p, prefix, m, middle)
    else:
        form, order = "psm", (p, prefix, s, suffix, m, middle)
    return n, form, prefix.points, middle.points, str(reduce(concat, order))


def restored(output: str, form: str) -> str:
    """The text that an output was made from, by splitting a rope of it at its sentinels.

    A text that holds a sentinel stays plain, and no end of a text makes one with the
    beginning of another, so the first of each is the one that was put in.
    """
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    rope = build(output)
    rest, middle = split(rope, find(rope, MIDDLE), None)
    one, two = split(rest, find(rest, second), None)
    one, two, middle = (split(x, len(mark), None)[1] for x, mark in ((one, first), (two, second), (middle, MIDDLE)))
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return str(concat(concat(prefix, middle), suffix))


@pandas_udf(StringType())
def _restore(output: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([restored(o, f) for o, f in zip(output, form)])


def restore(output: Column | str, form: Column | str) -> Column:
    """The text of an output and its form, as a column."""
    return _restore(output, form)


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "point", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for each row of ``docs``.

    ``rate`` percent of the texts are rearranged, ``spm`` percent of these with the
    suffix first; ``seed`` and id decide. ``n`` counts units. Null texts are empty;
    empty texts, and those that hold a sentinel, stay plain. Null ids are treated
    alike, repeated rows give equal rows, other columns don't matter, and an empty
    table gives no rows. A task holds an Arrow batch of texts and one rope.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(i, *rearranged(i, t.as_py(), seed, rate, spm, unit)) for i, t in zip(ids, b.column(1))]
            columns = zip(*rows) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
