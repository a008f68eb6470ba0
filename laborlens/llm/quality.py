"""Quality rules: surface counts and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials
over them, one of trusted documents and one of the whole corpus, give each bucket
a log ratio; a document's score is the mean over its n-grams. The target is fitted
on one half of the trusted documents; the threshold is a low quantile of the scores
of the other half. DataFrame functions only; the table of ``buckets`` weights is
the one thing that passes the driver, and its size does not depend on the corpus.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import once, shared_dir

BUCKETS = 1 << 13
#: Share of held-out trusted documents under the threshold. With fewer than LEAST_HELD of them the threshold is THRESHOLD.
QUANTILE, LEAST_HELD = 0.01, 50
THRESHOLD = -0.15
SMOOTHING = 1.0
#: Trusted ids that are sent to where the texts are; beyond, texts are shuffled to meet them.
BROADCAST_IDS = 4_000_000
#: Trusted documents that are used at most; all of them.
TRUSTED = None
SYMBOLS = "[#*$%&|<>]"
_SPACE = "[\\x20\\x09-\\x0D]"
LEAST_WORDS, MOST_REPEATED = 50, 50


def _words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return F.array_remove(F.split(text, f"{_SPACE}+"), "")


def _from(a: Column, first: int, n: Column) -> Column:
    """``n`` elements, or none, from number ``first``."""
    return F.slice(a, first, F.greatest(n, F.lit(0)))


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _repeated_words(t: Column) -> Column:
    """Words in windows of three words that the text has twice or more, from the windows' hashes."""

    def places(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["at"]))

    def count(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).cast("long").alias("n"), x.alias("last"))
        return F.aggregate(p, start, step, lambda acc: acc["n"])

    keyed = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(t)) < F.size(t), once(once(keyed, places), count)).otherwise(F.lit(0).cast("long"))


def _measured(rows: DataFrame, text: Column, table: Column, buckets: int, carry: list[str]) -> DataFrame:
    """``carry`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score for each row.

    One step a projection, so that each array is made once and the parts outside the
    lambdas are compiled.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_SPACE[1:]}"))
    steps = rows.select(*carry, _words(text).alias("w"), lines.alias("lines"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    dup_lines = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    steps = steps.select(*carry, "n_symbols", F.length(F.array_join("w", "")).cast("long").alias("word_chars"), dup_lines.alias("n_dup_lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    done = [*carry, "n_symbols", "word_chars", "n_dup_lines", "n_words"]
    h, n = F.col("h"), F.size("h")
    steps = steps.select(*done[:-1], n.cast("long").alias("n_words"), "h", _pairs(_from(h, 1, n - 1), _from(h, 2, n - 1)).alias("p"))
    p, m = F.col("p"), F.size("p")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.get(table, _bucket(x, buckets)))
    score = F.round((total(h) + total(p)) / F.greatest(n + m, F.lit(1)), 6)
    steps = steps.select(*done, score.alias("score"), _pairs(_from(p, 1, m - 1), _from(h, 3, m - 1)).alias("t"))
    steps = steps.select(*done, "score", _repeated_words(F.col("t")).alias("n_repeat_words"))
    # Generated, so that a filter on a measure stays above and doesn't repeat the expressions below.
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
    return steps.select(*carry, F.inline(F.array(F.struct(*measures))))


def _trusted(labels: DataFrame, most: int | None) -> DataFrame:
    """``(trusted_id, held)``: documents with quality 1 and not toxic, and which of them are held out."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    if most is not None:
        good = good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)
    return good.select("trusted_id", (F.pmod(F.xxhash64("trusted_id", F.lit(1)), F.lit(2)) == 1).alias("held"))


def weights(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log ratio of the trusted to the raw multinomial for each bucket, in nats.

    The raw counts cover every document; ``good`` has the trusted ids. Without any, all ratios are 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(good, F.col("doc_id") == F.col("trusted_id"), "left").select("trusted_id", _words(F.col("text")).alias("w"))
    # A row for each word and the word after it; only the sums of the buckets are shuffled.
    each = rows.select(F.col("trusted_id").isNotNull().alias("t"), F.inline(F.arrays_zip(F.col("w").alias("a"), _from(F.col("w"), 2, F.size("w") - 1).alias("b"))))
    each = each.select("t", F.xxhash64("a").alias("a"), F.when(F.col("b").isNotNull(), F.xxhash64("b")).alias("b"))
    each = each.select("t", F.explode(F.array(_bucket(F.col("a"), buckets), F.when(F.col("b").isNotNull(), _bucket(F.xxhash64("a", "b"), buckets)))).alias("b")).where("b is not null")
    counted = each.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("t").alias("target"))
    counts = {r["b"]: (r["raw"], r["target"]) for r in counted.collect()}
    raw, target = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not target:
        return [0.0] * buckets
    smooth = lambda n, total: math.log((n + SMOOTHING) / (total + SMOOTHING * buckets))
    return [round(smooth(counts.get(b, (0, 0))[1], target) - smooth(counts.get(b, (0, 0))[0], raw), 6) for b in range(buckets)]


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def fitted(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int | None = TRUSTED, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, float]:
    """The table of weights as a column, and the threshold.

    With too few held-out documents that pass the base rules, the target is fitted on all and the threshold is THRESHOLD.
    """
    path = f"{shared_dir(docs.sparkSession)}/trusted-{uuid.uuid4().hex}"
    good = _trusted(labels, trusted)
    good.write.parquet(path)
    good = docs.sparkSession.read.schema(good.schema).parquet(path)
    good = good.hint("broadcast" if good.count() <= BROADCAST_IDS else "shuffle_hash")
    as_table = lambda ids: F.from_json(F.lit(json.dumps(weights(docs, ids, buckets, id_col, text_col))), "array<double>")
    if good.where("held").count() >= LEAST_HELD:
        table = as_table(good.where("not held"))
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).join(good.where("held"), F.col("doc_id") == F.col("trusted_id"), "left_semi")
        passed = _measured(rows, F.col("text"), table, buckets, []).where(~_base_failed())
        n, at = passed.agg(F.count("*"), F.percentile("score", F.lit(QUANTILE))).first()
        if n >= LEAST_HELD:
            return table, at
    return as_table(good), THRESHOLD


def scored(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int = BUCKETS, trusted: int | None = TRUSTED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)``; ``row`` has all columns of ``docs``.

    A threshold that is not given is fitted. Null text has no words and fails.
    Texts without n-grams score 0. Null ids are never trusted; repeated rows count
    and come back each; an empty table gives no rows. Columns of ``docs`` travel as
    one struct and clash with none of the measures. Memory of a task grows with its
    longest text (about 40 bytes a word), not with the number of texts.
    """
    table, low = fitted(docs, labels, buckets, trusted, id_col, text_col)
    low = low if threshold is None else threshold
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    out = _measured(rows, text, table, buckets, ["row"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("row", *names, _base_failed().alias("base_failed"), "score", (~_base_failed() & (F.col("score") >= low)).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)`` for each row."""
    out = scored(docs.select("doc_id", "text"), labels, **how)
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
