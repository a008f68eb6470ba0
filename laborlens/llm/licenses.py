"""Licence scan: Dice coefficient over word bigrams against templates.

A unit of text is normalised to lower-case words, so that comment markers and line
breaks don't count. Units are lines, paragraphs of several lines, the whole text,
and passages: runs of words of any length that are like a template, so that a notice inside a longer line, or a licence that runs
over several paragraphs among other text, is found too. Only templates whose number
of bigrams allows the threshold are compared: Dice >= t needs n between t/(2-t) and
(2-t)/t times the template's.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.license_texts import TEMPLATES

LEAST = 0.8
_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> Counter:
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:]))


def units(text: str) -> Iterator[tuple[str, int, str]]:
    """Lines with text, paragraphs of several lines, and the whole if it has several paragraphs: (unit, first line, text)."""
    lines = text.split("\n")
    paragraphs, at = 0, 0
    block: list[str] = []
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            yield "line", i, line
            at = at if block else i
            block.append(line)
        elif block:
            paragraphs += 1
            if len(block) > 1:
                yield "paragraph", at, " ".join(block)
            block = []
    if paragraphs > 1:
        yield "document", 0, text


class Matcher:
    def __init__(self, templates, least: float = LEAST):
        self.least = least
        self.templates = [(name, x := bigrams(text), x.total()) for name, text in templates]
        self.having: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i in range(len(self.templates)):
            for g in self.templates[i][1]:
                self.having[g].append(i)
        sizes = [n for *_, n in self.templates] or [0]
        self.bounds = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least

    def best(self, text: str) -> tuple[str, float] | None:
        """Best template at the threshold or over it; of equals the first in the list."""
        words = _WORD.findall(text.lower())
        n = len(words) - 1
        if not self.bounds[0] <= n <= self.bounds[1]:
            return None
        grams = list(zip(words, words[1:]))
        near = {i for g in grams for i in self.having.get(g, ())}
        top, mine = None, Counter(grams) if near else None
        for i in sorted(near):
            name, theirs, m = self.templates[i]
            if m * self.least / (2 - self.least) <= n <= m * (2 - self.least) / self.least:
                dice = self._dice(i, mine, n)
                if dice >= self.least and (top is None or dice > top[1]):
                    top = name, dice
        return top

    def _dice(self, i: int, mine: Counter, n: int) -> float:
        _, theirs, m = self.templates[i]
        return 2 * sum(min(c, mine[g]) for g, c in theirs.items() if g in mine) / (n + m)

    def passages(self, text: str) -> Iterator[tuple[int, str, float]]:
        """First line, template and Dice of the best passages that don't overlap; a better one goes before, of equals the earlier.

        A passage is a run of bigrams of any length, so words may be put in, left out
        or changed anywhere. It begins and ends with a bigram of its template, for else a
        shorter one would be better.
        """
        spans = list(_WORD.finditer(text))
        words = [m[0].lower() for m in spans]
        hits: dict[int, list[tuple[int, tuple[str, str]]]] = defaultdict(list)
        for at, g in enumerate(zip(words, words[1:])):
            for i in self.having.get(g, ()):
                hits[i].append((at, g))
        found = []
        for i, mine in hits.items():
            found += ((-dice, start, i, end, self.templates[i][0]) for start, end, dice in self._runs(i, mine))
        taken: list[tuple[int, int]] = []
        for dice, start, _, end, name in sorted(found):
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                yield text.count("\n", 0, spans[start].start()), name, -dice

    def _runs(self, i: int, hits: list[tuple[int, tuple[str, str]]]) -> Iterator[tuple[int, int, float]]:
        """First word, end and Dice of the best run from each hit that reaches the threshold.

        A run of n bigrams at the threshold t shares ``t (n + m) / 2`` with a template of m,
        and n is at most ``longest``. So a window of m bigrams that holds the run, or
        the first m of a longer one (which has ``n - m`` more), shares ``few`` at least. Such windows are
        found by sliding one over the hits, a bigram in and out at a step; ends are tried only for hits before one.
        """
        _, theirs, m = self.templates[i]
        longest = int(m * (2 - self.least) / self.least)
        t = self.least
        few = min(t / 2 * (1 + t / (2 - t)), 1 - (2 - 2 * t) / t) * m - 1e-9
        if len(hits) < few:
            return
        near, have, shared, out = [], Counter(), 0, 0
        for k, (at, g) in enumerate(hits):
            have[g] += 1
            shared += have[g] <= theirs[g]
            while hits[out][0] <= at - m:
                gone = hits[out][1]
                shared -= have[gone] <= theirs[gone]
                have[gone] -= 1
                out += 1
            if shared >= few:
                near.append(at)
        if not near:
            return
        k = 0
        for first, (start, _) in enumerate(hits):
            while k < len(near) and near[k] < start:
                k += 1
            if k == len(near) or near[k] > start + longest + m:
                continue
            have, shared, best = Counter(), 0, (0.0, 0)
            for at, g in hits[first:]:
                if at - start >= longest:
                    break
                have[g] += 1
                shared += have[g] <= theirs[g]
                best = max(best, (2 * shared / (at - start + 1 + m), -at))
            if best[0] >= self.least:
                yield start, -best[1] + 2, best[0]

    def scan(self, text: str) -> Iterator[tuple[str, int, str, float]]:
        """Unit, line, licence and Dice of all units; a passage is told only where no other unit of its line has the licence."""
        told = set()
        for unit, at, part in units(text):
            if hit := self.best(part):
                told.add(("document" if unit == "document" else at, hit[0]))
                yield unit, at, *hit
        for at, name, dice in self.passages(text):
            if (at, name) not in told and ("document", name) not in told:
                yield "passage", at, name, dice


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, unit, line_no, license, dice)`` for each unit that is like a template.

    line_no counts from 0. Null and empty texts have no units; null ids are kept;
    repeated rows each report; of templates with equal Dice the first in the list is
    told; an empty table gives no rows. Other columns of ``docs`` are not read. Memory
    of a task grows with its longest text, not with the number of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        for b in batches:
            out = [(i, unit, at, name, round(dice, 6)) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for unit, at, name, dice in matcher.scan(text or "")]
            types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)], names=["doc_id", "unit", "line_no", "license", "dice"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, unit string, line_no int, license string, dice double")
