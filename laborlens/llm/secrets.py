"""Secret scan over an incremental ledger of content-addressed blobs.

Every version of a text is a blob, addressed by its SHA-256. Only pairs of blob
and rule version that the ledger does not hold are scanned, once for all paths
that carry the blob; findings are then joined back to every path. All of it is
DataFrame functions: the pieces that ``split`` leaves between matches give the
offsets of the matches in code points.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.llm.common import cut

def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The kinds in the order in which their spans are listed, with the pattern of each.
_NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are greedy, so a least length in the pattern drops the same matches as a test after it.
KINDS = (("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]{24,}"))
LEAST_VALUE = 6
#: Names the rules: whatever changes them makes every blob unseen.
RULE_VERSION = hashlib.sha256(repr((KINDS, LEAST_VALUE)).encode()).hexdigest()[:16]
#: Findings of at most so many bytes are broadcast.
BROADCAST_BYTES = 8 << 20
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, spans string"


def _matches(text: Column, number: int, pattern: str) -> Column:
    """``array<struct<kind,at,lead,match>>``: at counts matches, lead is the length of what stands before since the last."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("lead"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    rows = F.transform(both, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("at"), F.length(x["lead"]).alias("lead"), x["match"].alias("match")))
    return F.when(text.rlike(pattern), rows)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Findings of ``(blob, text)``: ``(blob, n_assign, n_access, n_hex, spans)``, only blobs that have any; repeated blobs count once."""
    found = [F.coalesce(_matches(F.col("text"), i, p), F.array().cast("array<struct<kind:int,at:int,lead:int,match:string>>")) for i, (_, p) in enumerate(KINDS)]
    rows = blobs.select("blob", F.inline(F.concat(*found))).where("match is not null")
    rows = rows.groupBy("blob", "kind", "at").agg(F.first("lead").alias("lead"), F.first("match").alias("match"))
    rows = rows.withColumn("end", F.sum(F.col("lead") + F.length("match")).over(Window.partitionBy("blob", "kind").orderBy("at")))
    rows = rows.where((F.col("kind") != 0) | (F.length(F.regexp_extract("match", ASSIGN, 2)) >= LEAST_VALUE))
    span = F.struct((F.col("end") - F.length("match")).alias("start"), "kind", "end")
    grouped = rows.groupBy("blob").agg(*(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, (k, _) in enumerate(KINDS)), F.sort_array(F.collect_list(span)).alias("x"))
    names = F.array(*(F.lit(k) for k, _ in KINDS))
    spans = F.array_join(F.transform("x", lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return grouped.select("blob", *(f"n_{k}" for k, _ in KINDS), spans.alias("spans"))


def scan_history(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(report, fresh)``: findings for every row of ``versions``, and the ledger rows to append.

    ``ledger`` has ``(blob, rule_version, n_assign, n_access, n_hex, spans)``, one
    row for each pair already scanned. The report has ``(doc_id, blob, n_assign,
    n_access, n_hex, base_sha256, spans)`` for each row: null text is empty, a null
    path is kept, repeated rows each come back, an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(path_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    paths = rows.select("doc_id", "blob")
    counts = [f"n_{k}" for k, _ in KINDS]
    place = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place")
    unseen = paths.groupBy("blob").agg(F.max(place).alias("place"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version)
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    # One path stands for each blob; its text is scanned where that row is dealt, so copies spread.
    blobs = rows.withColumn("place", place).join(unseen.hint("shuffle_hash"), ["blob", "place"], "left_semi").select("blob", "text")
    found = scan_blobs(blobs)
    fresh = unseen.select("blob", F.lit(rule_version).alias("rule_version")).join(found, "blob", "left").na.fill(0, counts).na.fill("", ["spans"])
    if ledger is not None:
        found = found.unionByName(known.select("blob", *counts, "spans"))
    return report(versions, found, path_col, text_col), fresh


def report(versions: DataFrame, found: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings by blob joined back to every row of ``versions``."""
    counts = [f"n_{k}" for k, _ in KINDS]
    paths = versions.select(F.col(path_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("blob"))
    # Joined on the reversed address, so that the findings are dealt anew and a hot blob may be split.
    back = found.select(F.reverse("blob").alias("bolb"), *counts, "spans")
    out = paths.join(back, F.col("blob") == F.reverse("bolb"), "left").na.fill(0, counts).na.fill("", ["spans"])
    return out.select("doc_id", "blob", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


def scan_with_ledger(versions: DataFrame, path: str, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report of ``scan_history`` by a ledger that is kept as Parquet under ``path``.

    Blobs that the ledger has under this rule version are not scanned again; the others
    are scanned and appended, so that the next run over the same and new versions scans
    the new ones only. A run that fails appends nothing, or all it found.
    """
    spark = versions.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:  # no run before this one
        ledger = None
    _, fresh = scan_history(versions, ledger, path_col=path_col, text_col=text_col)
    fresh.select(*(c.split()[0] for c in LEDGER.split(", "))).write.mode("append").parquet(path)
    # Two runs at a time may append the same pairs.
    known = spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rule_version"])
    return report(versions, known, path_col, text_col)


def masked(docs: DataFrame, mask: str = "[secret]", text_col: str = "text") -> DataFrame:
    """``docs`` with every finding in its text replaced by ``mask``; texts without findings stay as they are, null included.

    Findings that overlap are masked once. Each row travels as one struct, so that its
    columns clash with none of the findings'. The findings are broadcast if they have
    at most BROADCAST_BYTES bytes, else joined by a shuffle.
    """
    _, fresh = scan_history(docs, text_col=text_col)
    found = cut(fresh.where("spans <> ''").select("blob", "spans"))
    size = found.agg(F.sum(F.length("spans") + F.length("blob"))).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("shuffle_hash")
    text = F.col("row").getField(text_col).cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("key", F.sha2(F.coalesce(text, F.lit("")), 256)).join(found, F.col("key") == F.col("blob"), "left")
    span = F.transform(F.split("spans", ","), lambda x: F.transform(F.slice(F.split(x, ":"), 2, 2), lambda y: y.cast("int")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        lo, hi = x[0], x[1]
        fresh_ = F.concat(acc["out"], F.substr(text, acc["at"] + 1, lo - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], hi).alias("at"), F.when(lo >= acc["at"], fresh_).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(span, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    new = F.when(F.col("spans").isNull(), text).otherwise(clean)
    return rows.select(*(new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
