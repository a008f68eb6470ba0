"""URL filter by rules and a path-template tree.

Rules decide first. For the rest, each host has a tree over all segments of its
paths, with numbers, hex strings and UUIDs generalised to wildcards. The tree is
merged from the host down: a branch whose smoothed rate of blocked labels does not
differ from that of its parent by more than chance becomes the parent's wildcard
branch, and the subtrees of merged branches are pooled and merged on. A template is
rejected if its smoothed share of blocked labels reaches ``purity``. The labels are
the verdicts of the rules. DataFrame functions only; counts are summed by leaf
before anything is shuffled, and each level is one pass over the leaves that reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.llm.common import cut

# Verdict, host and path of each rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PURITY = 0.9
Z = 1.96
#: Segments from this number on count as one, so that the number of levels is bounded; none is dropped.
LEVELS = 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What varies within a segment: UUIDs, hex strings with a digit, numbers.
_VARIABLE = (
    r"(?<=/)[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?=/|$)",
    r"(?<=/)(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{8,}(?=/|$)",
    r"[0-9]+",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def by_rule(rules, what) -> Column:
    """``what(rule)`` of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        _, host, path = rule
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        out = F.when(fits, F.lit(what(rule))).otherwise(out)
    return out


def generalised(path: Column) -> Column:
    """The path with what varies replaced by ``*``, without empty segments."""
    for pattern in _VARIABLE:
        path = F.regexp_replace(path, pattern, "*")
    return F.array_join(F.array_remove(F.split(path, "/"), ""), "/")


def _segments(path: Column) -> Column:
    parts = F.split(path, "/", LEVELS)  # the last part takes the rest
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def _rate(block: str, labels: str) -> Column:
    return (F.col(block) + 1) / (F.col(labels) + 2)


def _level(leaves: DataFrame, depth: int) -> DataFrame:
    """Leaves that reach ``depth`` with their node moved one segment down; a leaf that ends here moves to its node's end, segment ``""``."""
    here = leaves.withColumn("seg", F.coalesce(F.get("segs", F.lit(depth)), F.lit("")))
    branch = here.groupBy("node", "seg").agg(F.sum("block").alias("b"), F.sum("labels").alias("l"))
    above = branch.groupBy("node").agg(F.sum("b").alias("pb"), F.sum("l").alias("pl"), F.count("*").alias("pn")).select(F.reverse("node").alias("edon"), "pb", "pl", "pn")
    p = _rate("pb", "pl")
    error = F.sqrt(p * (1 - p) * (1 / (F.col("l") + 2) + 1 / (F.col("pl") + 2)))
    like = (F.col("pn") > 1) & (F.abs(_rate("b", "l") - p) <= Z * error)
    # Joins are on reversed names, so that they deal both sides anew and a host with many branches may be split.
    branch = branch.join(above, F.col("node") == F.reverse("edon")).select(F.reverse("node").alias("edon"), F.reverse("seg").alias("ges"), F.when(like, "*").otherwise(F.col("seg")).alias("to"))
    out = here.join(branch, (F.col("node") == F.reverse("edon")) & (F.col("seg") == F.reverse("ges")))
    return cut(out.select("leaf", F.concat_ws("/", "node", "to").alias("node"), "segs", "block", "labels", (F.col("seg") == "").alias("ended")))


def tree(rows: DataFrame, purity: float = PURITY) -> DataFrame:
    """``(leaf, template, reject)`` of each leaf of ``rows (leaf, host, label)``; a leaf is ``host/generalised path``."""
    counts = rows.groupBy("leaf", "host").agg(F.count_if(F.col("label") == "block").alias("block"), F.count("label").alias("labels"))
    leaves = cut(counts.select("leaf", F.col("host").alias("node"), _segments(F.substr("leaf", F.length("host") + 2)).alias("segs"), "block", "labels"))
    depth = leaves.agg(F.max(F.size("segs"))).first()[0] or 0
    done = []
    for d in range(depth + 1):
        moved = _level(leaves, d)
        done.append(moved.where("ended").select("leaf", "node", "block", "labels"))
        leaves = moved.where("not ended")
    ends = done[0]
    for more in done[1:]:
        ends = ends.union(more)
    pure = ends.groupBy("node").agg(F.sum("block").alias("pb"), F.sum("labels").alias("pl")).select(F.reverse("node").alias("edon"), (_rate("pb", "pl") >= purity).alias("reject"))
    return ends.join(pure, F.col("node") == F.reverse("edon")).select("leaf", F.col("node").alias("template"), "reject")


def filter_urls(pages: DataFrame, rules=RULES, purity: float = PURITY, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, template)`` for each row; template is null where a rule decides.

    Null and malformed URLs have an empty host and path, which form a template
    like any other. Without any label no template is rejected. Null ids are kept,
    repeated rows each come back and count each; an empty table gives no rows.
    Other columns of ``pages`` are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", by_rule(rules, lambda r: r[1] + r[2]).alias("rule"), by_rule(rules, lambda r: r[0]).alias("label"))
    rows = rows.withColumn("leaf", F.concat("host", F.lit("/"), generalised(F.col("path"))))
    verdicts = tree(rows, purity).select(F.reverse("leaf").alias("fael"), "template", "reject")
    out = rows.join(verdicts, F.col("leaf") == F.reverse("fael"), "left")
    method = F.when(F.col("reject"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), F.when(F.col("rule").isNull(), F.col("template")).alias("template"))
