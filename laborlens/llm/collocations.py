"""Collocations of two to five words by level-wise passes.

Words that are met often enough are the first level. A pass over level k - 1 has
the level's phrases in every task and counts a phrase of k words only where both of
its overlapping phrases of k - 1 words are among them; such a phrase is the pair of
their numbers, which names it exactly. Texts are tokenised twice, to count words and to write
their numbers as a table in the shared folder; all further levels read that table.

A level goes to the tasks only while it has at most ``most`` phrases. Beyond that
all levels are found by joins over one row for each place, which need no table in a task.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.llm.common import cut, shared_dir

# What ends a piece of text, and what else separates words.
ENDS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
MOST_WORDS, LEAST, TOP = 5, 100, 2000
#: Phrases of a level that a task may hold.
TASK_PHRASES = 2_000_000
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + (ENDS + GAPS).encode(), b"abcdefghijklmnopqrstuvwxyz" + b"." * len(ENDS) + b" " * len(GAPS))
_AT_ONCE = 1 << 20  # words taken at once; places counted before they are combined are four times as many
_SALTS = 64


def _tokens(texts: list[bytes]) -> pa.DictionaryArray:
    """Words of the texts in order, with a full stop for each end of a piece or text."""
    spaced = b".".join(texts).translate(_BYTES).replace(b".", b" . ")
    return pa.array(spaced.split(), pa.binary()).dictionary_encode()


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.DictionaryArray]]:
    for b in batches:
        waiting: dict[str, list[bytes]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py().encode("utf-8", "surrogatepass")
            waiting[lang].append(t)
            sizes[lang] += len(t)
            if sizes[lang] > 3 * _AT_ONCE:
                yield lang, _tokens(waiting.pop(lang))
                sizes[lang] = 0
        for lang, some in waiting.items():
            yield lang, _tokens(some)


def _next(at: np.ndarray, level: tuple) -> np.ndarray:
    """Numbers of the phrases of the next level, from those of this one at every place; -1 where there is none."""
    keys, numbers = level
    out = np.full(len(at), -1, dtype=np.int64)
    both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    if len(both) and len(keys):
        pair = (at[both] << 32) | at[both + 1]
        where = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[where] == pair
        out[both[hit]] = numbers[where[hit]]
    return out


def _words(docs: DataFrame) -> DataFrame:
    """``(lang, word, f)``; a null word carries the number of all words of its language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, tokens in _by_lang(batches):
            n = np.bincount(tokens.indices.to_numpy(), minlength=len(tokens.dictionary))
            words = tokens.dictionary.to_pylist()
            real = [i for i, w in enumerate(words) if w != b"."]
            rows = [words[i].decode("utf-8", "surrogatepass") for i in real] + [None]
            f = np.append(n[real], n[real].sum())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.string()), pa.array(f, pa.int64())], names=["lang", "word", "f"])

    return docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _numbered(df: DataFrame) -> DataFrame:
    return cut(cut(df).withColumn("id", F.monotonically_increasing_id()))


def _by_tables(docs: DataFrame, words: DataFrame, least: int, longest: int, most: int) -> list[DataFrame] | None:
    """The levels from two words on, with every level's table in the tasks; None where one has more than ``most`` phrases."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    if words.count() > most:
        return None
    first = words.select("id", "lang", "word").toArrow().sort_by("id")
    ids = [first["id"].to_numpy()]
    vocabulary: dict[str, dict[bytes, int]] = defaultdict(dict)
    for i, (lang, word) in enumerate(zip(first["lang"].to_pylist(), first["word"].to_pylist())):
        vocabulary[lang][word.encode("utf-8", "surrogatepass")] = i
    sent = sc.broadcast(dict(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, tokens in _by_lang(batches):
            known = sent.value.get(lang, {})
            number = np.fromiter((known.get(w, -1) for w in tokens.dictionary.to_pylist()), dtype=np.int32, count=len(tokens.dictionary))
            at = number[tokens.indices.to_numpy()] if len(number) else number
            at = at[(at >= 0) | np.append(at[1:] >= 0, False)]  # one gap is as good as many
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary())], names=["at"])

    path = f"{shared_dir(spark)}/numbers-{uuid.uuid4().hex}"
    docs.mapInArrow(encode, "at binary").write.parquet(path)
    numbers, tables, levels = spark.read.parquet(path), [], []
    for _ in range(2, longest + 1):
        before, names = sc.broadcast(list(tables)), sc.broadcast(ids[-1])

        def count(batches: Iterator[pa.RecordBatch], before=before) -> Iterator[pa.RecordBatch]:
            def combined(parts: list[np.ndarray]) -> pa.RecordBatch:
                every = np.concatenate(parts)
                parts.clear()
                every.sort()
                at = np.flatnonzero(np.append(every[1:] != every[:-1], len(every) > 0))
                return pa.RecordBatch.from_arrays([pa.array(every[at], pa.int64()), pa.array(np.diff(at, prepend=-1), pa.int64())], names=["pair", "f"])

            parts, held = [], 0
            for b in batches:
                for x in b.column(0):
                    at = np.append(np.frombuffer(x.as_py(), dtype=np.int32), -1).astype(np.int64)
                    for level in before.value:
                        at = _next(at, level)
                    both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
                    parts.append((at[both] << 32) | at[both + 1])
                    held += len(both)
                    if held > 4 * _AT_ONCE:
                        yield combined(parts)
                        held = 0
            if parts:
                yield combined(parts)

        def named(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pair = b.column(0).to_numpy(zero_copy_only=False)
                p, q = names.value[pair >> 32], names.value[pair & 0xFFFFFFFF]
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64()), b.column(1)], names=["p", "q", "f"])

        frequent = numbers.mapInArrow(count, "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        level = _numbered(frequent.mapInArrow(named, "p long, q long, f long"))
        levels.append(level)
        if len(levels) == longest - 1:
            break
        if level.count() > most:
            return None
        rows = level.select("id", "p", "q").toArrow().sort_by("id")
        pairs = (np.searchsorted(ids[-1], rows["p"].to_numpy()) << 32) | np.searchsorted(ids[-1], rows["q"].to_numpy())
        order = np.argsort(pairs)
        tables.append((pairs[order], order))
        ids.append(rows["id"].to_numpy())
    return levels


def _by_joins(docs: DataFrame, words: DataFrame, least: int, longest: int) -> list[DataFrame]:
    """The same levels from one row for each place: a place and the next one make a phrase, counts come back by a join."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                tokens = _tokens([text.as_py().encode("utf-8", "surrogatepass")])
                for lo in range(0, len(tokens), _AT_ONCE):
                    some = tokens[lo : lo + _AT_ONCE].cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int64()), pa.array([lang] * len(some), pa.string()), some], names=["row", "place", "lang", "word"])

    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "lang", "text"))
    met = rows.mapInArrow(places, "row long, place long, lang string, word string").where("word <> '.'")
    there = cut(met.join(words.select("lang", "word", "id"), ["lang", "word"]).select("row", "place", "id"))
    levels = []
    for k in range(2, longest + 1):
        after = there.select("row", (F.col("place") - 1).alias("place"), F.col("id").alias("q"))
        pairs = there.withColumnRenamed("id", "p").join(after, ["row", "place"])
        level = _numbered(pairs.groupBy("p", "q").agg(F.count("*").alias("f")).where(F.col("f") >= least))
        levels.append(level)
        if k < longest:
            there = cut(pairs.join(level.select("p", "q", "id"), ["p", "q"]).select("row", "place", "id"))
    return levels


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """``floor(1000 a n / (l r))`` of four columns, in decimals."""
    a, n, l, r = (F.col(c).cast("decimal(18,0)") for c in (a, n, l, r))  # noqa: E741
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), l * r).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = MOST_WORDS, top: int | None = TOP, most: int = TASK_PHRASES, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best ``top`` phrases, all of them with ``top`` None.

    A phrase of 2 to ``longest`` words that is met ``a >= least`` times within pieces
    of text is cut where its parts' counts l and r give the lowest score
    ``floor(1000 a n / (l r))``, n being all words of the language; of equal scores
    the earliest cut counts. A phrase inside a longer one that is met as often goes.
    Products are decimals of 38 digits, exact for counts below 10**17.

    Null texts are empty, null languages are ``und``, repeated rows count each time,
    other columns don't matter, very long texts are whole, an empty table gives no rows.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = cut(_words(docs).where((F.col("f") >= least) | F.isnull("word")))
    totals = counts.where("word is null").select("lang", F.col("f").alias("n"))
    words = _numbered(counts.where("word is not null"))
    levels = _by_tables(docs, words, least, longest, most) or _by_joins(docs, words, least, longest)
    # heads and tails: how often the first and the last 1, 2 ... words of a phrase are met, the phrase itself last.
    known = [words.select("id", "lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))]
    for level in levels:
        p = known[-1].select(F.col("id").alias("p"), "lang", F.col("phrase").alias("begin"), F.col("heads").alias("h"))
        q = known[-1].select(F.col("id").alias("q"), "last", F.col("tails").alias("t"))
        whole = level.join(p, "p").join(q, "q")
        known.append(cut(whole.select("id", "lang", "f", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", F.array_append("h", F.col("f")).alias("heads"), F.array_append("t", F.col("f")).alias("tails"), "p", "q")))
    kept = []
    for k, rows in enumerate(known[1:], 2):
        if k < longest:
            longer = known[k].select("p", "q", F.col("f").alias("f2"))
            as_often = longer.select(F.col("p").alias("id"), "f2").union(longer.select(F.col("q").alias("id"), "f2")).groupBy("id").agg(F.max("f2").alias("f2"))
            rows = rows.join(as_often, "id", "left").where(F.coalesce(F.col("f2") < F.col("f"), F.lit(True)))
        parts = F.explode(F.array(*(F.struct(F.lit(j).alias("k"), F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r")) for j in range(1, k))))
        kept.append(rows.select("id", "lang", "phrase", F.col("f").alias("a"), parts.alias("x")).select("id", "lang", "phrase", "a", "x.*").withColumn("level", F.lit(k)))
    cuts = reduce(DataFrame.unionByName, kept).join(totals, "lang")
    best = cuts.withColumn("score", score("a", "n", "l", "r")).groupBy("level", "id", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    best = best.select("id", "lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # the best of each of many parts first, so that no task sorts a whole language
        best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
        best = best.withColumn("i", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("i") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
