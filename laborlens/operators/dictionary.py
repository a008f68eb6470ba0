"""The dictionary of skills as a dimension: loaded from seed rows, refused if two skills claim an alias."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import embedding, skills
from laborlens.functions.text import squeezed

#: Rows of a dictionary that the driver takes at most.
MOST_SKILLS = 100_000
SHOWN = 10


class Collision(ValueError):
    """An alias that two skills claim."""


def loaded(seeds: DataFrame) -> DataFrame:
    """``(id, name, category, is_ambiguous, is_common, aliases, exact)`` from seed rows of the same columns.

    Names lose superfluous white space; the name is an alias too, aliases in any case
    are kept in lower case, and none stays beside an exact spelling of the same
    letters. Two skills of one name, an id met twice, and an alias that two skills
    claim in any case or exactly stop the load with ``Collision``.
    """
    name = squeezed(F.col("name"))
    rows = seeds.select("id", name.alias("name"), "category", "is_ambiguous", "is_common", embedding.plain_aliases(name, F.col("aliases"), F.col("exact")).alias("aliases"), embedding.cased_aliases(F.col("exact")).alias("exact"))
    told = rows.select("id", F.explode(F.concat(F.transform("aliases", lambda a: F.concat(F.lit("alias "), a)), F.transform("exact", lambda a: F.concat(F.lit("exact alias "), a)), F.array(F.concat(F.lit("name "), F.lower("name"))))).alias("claim"))
    told = told.union(rows.select(F.monotonically_increasing_id(), F.concat(F.lit("id "), F.col("id").cast("string"))))
    twice = told.groupBy("claim").agg(F.count_distinct("id").alias("n")).where("n > 1").orderBy("claim").limit(SHOWN).collect()
    if twice:
        raise Collision("claimed more than once: " + ", ".join(r["claim"] for r in twice))
    return rows


def known(dictionary: DataFrame) -> list[skills.Skill]:
    """The dictionary's rows in order of ids, as the matcher takes them; at most ``MOST_SKILLS``."""
    rows = dictionary.select("id", "aliases", "exact", "is_ambiguous").orderBy("id").limit(MOST_SKILLS + 1).collect()
    if len(rows) > MOST_SKILLS:
        raise ValueError(f"a dictionary of more than {MOST_SKILLS} skills is no dimension that fits a task")
    return [skills.Skill(r["id"], tuple(r["aliases"]), tuple(r["exact"]), bool(r["is_ambiguous"])) for r in rows]


def matcher(dictionary: DataFrame) -> Broadcast:
    return skills.sent(dictionary.sparkSession, known(dictionary))


def frequent_names(texts: DataFrame, text_col: str, n: int, least_chars: int = 4) -> DataFrame:
    """Seed rows from the ``n`` most frequent words of a corpus, most frequent first, of equal ones in order of letters."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[0-9a-z]+"), F.lit(0))).alias("name")).where(F.length("name") >= least_chars)
    top = words.groupBy("name").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "name").limit(n)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("o"), "name"))).alias("a")).select(F.posexplode("a").alias("i", "x"))
    none = F.array().cast("array<string>")
    return ranked.select((F.col("i") + 1).alias("id"), F.col("x.name").alias("name"), F.lit(None).cast("string").alias("category"), F.lit(False).alias("is_ambiguous"), F.lit(False).alias("is_common"), none.alias("aliases"), none.alias("exact"))
