"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over all passages of the corpus.
2. A randomised SVD of the TF-IDF matrix of passages, fitted by two distributed
   passes over a bounded sample of documents and all benchmark items: the range of
   ``A'A`` times a random matrix, then its small Gram matrix.
3. Every passage of every document is folded into the latent space and compared
   with the items by cosine; passages at ``cosine`` or over are candidates.
4. Candidates are verified on words: longest common subsequence with the item, and
   for paraphrases how much of the item's answer (its last sentence) is there.

Passages are windows of 2, 4 or 6 blocks of 12 words, at every block; an item is
compared with the windows of the scale that holds it. An item of more than ``LONGEST``
words is cut into overlapping pieces of so many words for the search, and verified
in a range that grows with it. Features are the benchmark's
words that at most ``MAX_DF`` of passages have, and the ``RARE`` rarest of each
item at least, so that the tables that tasks get grow with the benchmark alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.llm.windows import _BYTE, _GROUP, Rolling, word_bounds

BLOCK = 12
SCALES = (2, 4, 6)
LONGEST = (SCALES[-1] - 1) * BLOCK
PASSAGE = 2 * BLOCK
MAX_DF = 0.002
RARE = 6
RANK = 128
OVERSAMPLE = 16
#: Documents that the SVD is fitted on, at most: those whose ids hash lowest.
SAMPLE_DOCS = 5_000
SAMPLE_TASKS = 8
#: Items that one pass over the corpus looks for; a larger benchmark takes more passes, so that what tasks get stays bounded.
ITEMS_A_PASS = 20_000
#: Passages whose cosines with all items are in memory at a time.
ROWS_AT_ONCE = 4096
COSINE = 0.5
SAME, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
_SLOTS = 20
_SPLIT = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> bytes:
    """Lower-case words, ASCII punctuation dropped, joined by single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split())


def _hashed(norm: bytes) -> np.ndarray:
    starts, ends = word_bounds(norm)
    return Rolling(_BYTE[np.frombuffer(norm, dtype=np.uint8)]).of(starts, ends)


class Lookup:
    """Feature numbers of word hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # in order
        self.slots = np.zeros(1 << _SLOTS, dtype=bool)
        self.slots[hashes >> np.uint64(64 - _SLOTS)] = True

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and feature numbers of the words that are features."""
        at = np.flatnonzero(self.slots[h >> np.uint64(64 - _SLOTS)])
        i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[i] == h[at]
        return at[same], i[same]


def _groups(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Texts in groups: their numbers, words, word hashes end to end, and the first word of each."""
    group: list[tuple[int, bytes]] = []
    total = 0
    for i, t in enumerate([*texts, None]):
        norm = words_of(t) if i < len(texts) else b""
        if group and (i == len(texts) or total + len(norm) > _GROUP):
            joined = b" ".join(x for _, x in group)
            sizes = np.array([x.count(b" ") + 1 for _, x in group])
            yield np.array([j for j, _ in group]), [x for _, x in group], _hashed(joined), np.concatenate(([0], np.cumsum(sizes)))
            group, total = [], 0
        if norm:
            group.append((i, norm))
            total += len(norm)


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    answer: list[bytes]


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Item]:
    """The items, equal ones once: a stated set of queries, which the driver holds."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).distinct().collect()
    out = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        if words := words_of(t).split():
            sentences = [s for s in re.split(r"[.?!\n]+", t) if words_of(s)]
            out.append(Item(i, words, words_of(sentences[-1]).split() if sentences else words))
    return out


def pieces_of(items: list[Item]) -> list[tuple[int, int, int]]:
    """Item, first word and words of each piece: the whole of an item of at most LONGEST words."""
    out = []
    for i, x in enumerate(items):
        n = len(x.words)
        last = max(0, n - LONGEST)
        out += [(i, a, min(n, LONGEST)) for a in (*range(0, last, LONGEST // 2), last)]
    return out


def lcs(of: list[bytes], among: list[bytes]) -> int:
    """Length of the longest common subsequence, a machine word a bit."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(of):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(of)) - 1
    s = full
    for w in among:
        u = s & masks.get(w, 0)
        s = ((s + u) | (s - u)) & full
    return len(of) - s.bit_count()


def _frequencies(docs: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many passages each word is, and how many passages there are, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, df, total = Lookup(hashes), np.zeros(len(hashes), dtype=np.int64), 0
        for b in batches:
            for _, _, h, base in _groups(b.column(0).to_pylist()):
                at, f = look.of(h)
                text = np.searchsorted(base, at, side="right") - 1
                blocks = np.concatenate(([0], np.cumsum(-(-np.diff(base) // PASSAGE))))
                total += int(blocks[-1])
                pairs = np.unique((blocks[text] + (at - base[text]) // PASSAGE) * len(hashes) + f)
                df += np.bincount(pairs % len(hashes), minlength=len(hashes))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], names=["f", "n"])

    rows = docs.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(hashes), dtype=np.int64)
    total = 0
    for f, n in rows:
        if f < 0:
            total = n
        else:
            df[f] = n
    return df, total


def _unit(f: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of one passage: features and values of length 1."""
    f, n = np.unique(f, return_counts=True)
    v = n * idf[f]
    return f, v / max(np.linalg.norm(v), 1e-12)


def _passes(sample: DataFrame, look: Lookup, idf: np.ndarray, basis: np.ndarray, gram: bool) -> np.ndarray:
    """Sum over the sample's passages a of ``a (a'B)``, or with ``gram`` of ``(B'a)(B'a)'``."""
    shape = (basis.shape[1], basis.shape[1]) if gram else basis.shape
    sent = sample.sparkSession.sparkContext.broadcast((look.hashes, idf, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, idf, basis = sent.value
        look, out = Lookup(hashes), np.zeros(shape)
        for b in batches:
            for _, _, h, base in _groups(b.column(0).to_pylist()):
                at, f = look.of(h)
                text = np.searchsorted(base, at, side="right") - 1
                passage = base[text] * 2 + (at - base[text]) // PASSAGE  # tells passages of a group apart
                cuts = np.flatnonzero(np.diff(passage)) + 1
                for part in np.split(f, cuts) if len(f) else ():
                    add(out, *_unit(part, idf), basis, gram)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["x"])

    return sum((np.frombuffer(r.x).reshape(shape) for r in sample.select("text").mapInArrow(run, "x binary").toLocalIterator()), np.zeros(shape))


def add(out: np.ndarray, f: np.ndarray, v: np.ndarray, basis: np.ndarray, gram: bool) -> None:
    y = v @ basis[f]
    if gram:
        out += np.outer(y, y)
    else:
        out[f] += np.outer(v, y)


@dataclass
class Model:
    """What tasks get: features, their latent vectors, and the items' pieces in latent space."""

    hashes: np.ndarray
    latent: np.ndarray
    items: list[Item]
    pieces: list[tuple[int, int, int]]
    vectors: np.ndarray


def fit(docs: DataFrame, items: list[Item], rank: int = RANK) -> Model:
    """``docs`` has (doc_id, text)."""
    pieces = pieces_of(items)
    hashes = [_hashed(b" ".join(items[i].words[a : a + n])) for i, a, n in pieces]
    every = np.unique(np.concatenate(hashes))
    df, total = _frequencies(docs, every)
    idf = np.log((1 + total) / (1 + df)) + 1e-3
    wanted = set(np.flatnonzero(df <= MAX_DF * max(total, 1)).tolist())
    for h in hashes:
        mine = np.unique(np.searchsorted(every, h))
        wanted |= set(mine[np.lexsort((mine, df[mine]))][:RARE].tolist())
    keep = np.array(sorted(wanted))
    hashes_, idf = every[keep], idf[keep]
    look = Lookup(hashes_)
    rows = [_unit(look.of(h)[1], idf) for h in hashes]

    # The cut is found on hashes alone, so that no task gathers texts but those of the sample.
    marked = docs.select("text", F.xxhash64("doc_id", "text").alias("h"))
    last = marked.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h").alias("h")).first()["h"]
    sample = marked.where(F.col("h") <= F.lit(last)).repartition(SAMPLE_TASKS, "h").dropDuplicates(["h"]).select("text")
    width = min(rank + OVERSAMPLE, len(keep))
    basis = np.random.Generator(np.random.PCG64(11)).standard_normal((len(keep), width))
    for gram in (False, True):
        out = _passes(sample, look, idf, basis, gram)
        for f, v in rows:
            add(out, f, v, basis, gram)
        if not gram:
            basis = np.linalg.qr(out)[0]
    _, u = np.linalg.eigh(out)
    basis = basis @ u[:, ::-1][:, : min(rank, width)]
    vectors = np.array([v @ basis[f] for f, v in rows])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(hashes_, (basis * idf[:, None]).astype(np.float32), items, pieces, vectors.astype(np.float32))


class Finder:
    """Items that a group of texts holds. One for each task."""

    def __init__(self, model: Model, cosine: float):
        self.model, self.cosine, self.look = model, cosine, Lookup(model.hashes)
        scale = [next((m for m in SCALES if n + BLOCK <= m * BLOCK), SCALES[-1]) for _, _, n in model.pieces]
        self.of_scale = {m: np.flatnonzero(np.array(scale) == m) for m in set(scale)}

    def candidates(self, h: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """Text, piece, first word, words and cosine of passages like a piece of an item."""
        at, f = self.look.of(h)
        if not len(at):
            return
        # Blocks of the texts end to end, with room after each, so that no window reaches into the next text.
        blocks = -(-np.diff(base) // BLOCK)
        first = np.concatenate(([0], np.cumsum(blocks + SCALES[-1] - 1)))
        owner = np.repeat(np.arange(len(blocks)), blocks)
        start = np.arange(len(owner)) + owner * (SCALES[-1] - 1)
        text = np.searchsorted(base, at, side="right") - 1
        block = first[text] + (at - base[text]) // BLOCK
        cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        sums = np.zeros((first[-1] + 1, self.model.latent.shape[1]), dtype=np.float32)
        sums[block[cuts]] = np.add.reduceat(self.model.latent[f], cuts, axis=0)
        z, have = sums[start], 1
        for m, chosen in sorted(self.of_scale.items()):
            for more in range(have, m):
                z += sums[start + more]
            have = m
            for lo in range(0, len(z), ROWS_AT_ONCE):
                some = z[lo : lo + ROWS_AT_ONCE]
                cos = (some @ self.model.vectors[chosen].T) / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-12)
                for r, i in zip(*np.nonzero(cos >= self.cosine)):
                    w = lo + r
                    t = owner[w]
                    yield int(t), int(chosen[i]), int(start[w] - first[t]) * BLOCK, m * BLOCK, float(cos[r, i])

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """Text, item, cosine, LCS and answer shares and first word: the best passage of each pair that is verified."""
        for numbers, norms, h, base in _groups(texts):
            best: dict[tuple[int, int], tuple] = {}
            words: dict[int, list[bytes]] = {}
            shares: dict[tuple[int, int, int, int], tuple[float, float]] = {}
            for t, k, at, n, cos in self.candidates(h, base):
                if t not in words:
                    words[t] = norms[t].split()
                i, before, size = self.model.pieces[k]
                item = self.model.items[i]
                lo, hi = at - BLOCK, at + n + BLOCK
                if len(item.words) > size:  # the range is rounded, so that pieces of one place share it
                    room = len(item.words) // 4
                    step = max(room // 2, BLOCK)
                    at = max(0, at - before)
                    lo = at // step * step - room - BLOCK
                    hi = lo + len(item.words) + 2 * room + step + n
                place = t, i, max(0, lo), hi
                if place not in shares:
                    window = words[t][max(0, lo) : hi]
                    share = lcs(item.words, window) / len(item.words)
                    shares[place] = share, lcs(item.answer, window) / len(item.answer) if share >= PARAPHRASE else 0.0
                share, answer = shares[place]
                if share >= SAME or (share >= PARAPHRASE and answer >= ANSWER):
                    best[t, i] = max(best.get((t, i), (0.0,)), (share, answer, cos, -at))
            for (t, i), (share, answer, cos, at) in sorted(best.items()):
                yield int(numbers[t]), i, cos, share, answer, -at


def _models(docs: DataFrame, items: list[Item], a_pass: int) -> Iterator:
    """A fitted model for each pass, as a broadcast variable."""
    for at in range(0, len(items), a_pass):
        yield docs.sparkSession.sparkContext.broadcast(fit(docs, items[at : at + a_pass]))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, id_col: str = "doc_id", text_col: str = "text", a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """``(doc_id, item_id, cosine, lcs_share, answer_share, at)`` for each row of ``docs`` and item that it holds.

    Null and empty texts and items hold nothing. Null ids are kept, repeated rows
    each report, equal items report once each. An empty table or benchmark gives no
    rows. Other columns are not read. Memory of a task grows with its longest text, and
    with ``ROWS_AT_ONCE`` passages times the items of a pass.
    """
    rows = _rows(docs, id_col, text_col)
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, at int"
    parts = []
    for model in _models(rows, items_of(benchmark), a_pass):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            finder = Finder(model.value, cosine)
            names = [x.split()[0] for x in schema.split(", ")]
            types = (pa.int64(), pa.int64(), *(pa.float64(),) * 3, pa.int32())
            for b in batches:
                ids = b.column(0).to_pylist()
                found = [(ids[t], finder.model.items[i].item_id, round(c, 4), round(s, 4), round(a, 4), at) for t, i, c, s, a, at in finder.found(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 6, types)], names=names)

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def cleaned(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, id_col: str = "doc_id", text_col: str = "text", a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; nothing is shuffled.

    Null and empty texts stay, repeated rows stay or go together, an empty table gives no rows and an empty benchmark all.
    """
    column, out = docs.columns.index(text_col), docs
    for model in _models(_rows(docs, id_col, text_col), items_of(benchmark), a_pass):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            finder = Finder(model.value, cosine)
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for t, *_ in finder.found(b.column(column).to_pylist()):
                    keep[t] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
