"""The questions that a chat user asks: periods, names and profiles resolved, then one of the analytic plans."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators import analytics as A
from laborlens.operators.filters import GRADES, Scope
from laborlens.sources.market import AS_OF, Market

_FORMAT = "%Y-%m-%d %H:%M:%S"
_SEOUL = timedelta(hours=9)
EXCERPT = 200


@dataclass(frozen=True)
class Profile:
    skills: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    career: str | None = None


@dataclass(frozen=True)
class Answer:
    """``rows`` is None where nothing was found; ``told`` says what was taken and what not."""

    found: bool
    rows: DataFrame | None = None
    told: dict = field(default_factory=dict)


def window_of(period: str, as_of: str = AS_OF, back: int = 1) -> tuple[str, str]:
    """The last full ``week`` (from Monday) or ``month`` of Seoul before a moment, or with ``back`` an earlier one, as half-open UTC times."""
    local = datetime.strptime(as_of, _FORMAT) + _SEOUL
    day = datetime(local.year, local.month, local.day)
    if period == "week":
        end = day - timedelta(days=day.weekday() + 7 * (back - 1))
        start = end - timedelta(days=7)
    elif period == "month":
        months = day.year * 12 + day.month - 1 - (back - 1)
        start, end = (datetime(n // 12, n % 12 + 1, 1) for n in (months - 1, months))
    else:
        raise ValueError(f"a period is a week or a month, not {period}")
    return tuple((x - _SEOUL).strftime(_FORMAT) for x in (start, end))


def _scope(period: str | None, days: int | None, as_of: str, **others) -> Scope:
    """A calendar period wins over a number of days."""
    return Scope(window=window_of(period, as_of), as_of=as_of, **others) if period else Scope(days=days, as_of=as_of, **others)


def popular_skills(m: Market, field: str | None = None, period: str | None = None, days: int = 30, top: int = 10, as_of: str = AS_OF) -> DataFrame:
    return A.popular_skills(m, _scope(period, days, as_of, field=field), top)


def rising_skills(m: Market, period: str | None = None, window_days: int = 7, top: int = 10, as_of: str = AS_OF) -> dict[str, DataFrame]:
    """Growers, newcomers and totals of a window and the one before it; with a period both are of the calendar."""
    if period:
        recent, previous = window_of(period, as_of), window_of(period, as_of, 2)
    else:
        end = datetime.strptime(as_of, _FORMAT)
        at = [(end - timedelta(days=window_days * i)).strftime(_FORMAT) for i in range(3)]
        recent, previous = (at[1], at[0]), (at[2], at[1])
    return {"risers": A.rising_skills(m, recent, previous, top=top), "newcomers": A.new_skills(m, recent, previous, top=top), "totals": A.rising_totals(m, recent, previous)}


def compare_segments(m: Market, by: str, field: str | None = None, period: str | None = None, days: int = 30, top: int = 8, as_of: str = AS_OF) -> DataFrame:
    return A.stacks_by_segment(m, by, _scope(period, days, as_of, field=field), top)


def salary_stats(m: Market, skill: str | None = None, field: str | None = None, career: str | None = None, period: str | None = None, days: int | None = None, as_of: str = AS_OF) -> DataFrame:
    """Without a period or days the whole time counts."""
    return A.salary_stats(m, _scope(period, days, as_of, field=field, career=career), skill)


def _known(m: Market, skill: str) -> bool:
    return not A.resolve_skill_name(m, skill).isEmpty()


def related_skills(m: Market, skill: str, top: int = 10) -> Answer:
    return Answer(True, A.related_skills(m, skill, top=top)) if _known(m, skill) else Answer(False, told={"unknown": skill})


def skill_demand(m: Market, skill: str) -> Answer:
    return Answer(True, A.skill_demand(m, skill)) if _known(m, skill) else Answer(False, told={"unknown": skill})


def _company(m: Market, name: str) -> tuple[int | None, list[tuple]]:
    """Id of the company that a name means, and the candidates, 20 at most, where it means several."""
    rows = A.company_verdict(m, name).collect()
    if rows[0]["status"] == "found":
        return rows[0]["company_id"], []
    return None, [(r["company_id"], r["name"], r["postings"]) for r in rows if r["status"] == "ambiguous"]


def company_profile(m: Market, name: str, top: int = 10) -> Answer:
    company, candidates = _company(m, name)
    if company is None:
        return Answer(False, told={"status": "ambiguous" if candidates else "not_found", "candidates": candidates})
    skills = A.company_top_skills(m, [company], tuple(GRADES), top).select(F.lit("skill").alias("kind"), F.col("name").alias("key"), F.col("postings").alias("n"))
    return Answer(True, A.company_profile(m, company).unionByName(skills), {"company_id": company})


def compare_companies(m: Market, names: list[str], top: int = 10) -> Answer:
    """Top skills of each company that is found, and whether all share them; fewer than two make no comparison."""
    ids, unresolved = [], []
    for name in names:
        company, _ = _company(m, name)
        (unresolved.append(name) if company is None else ids.append(company))
    if len(set(ids)) < 2:
        return Answer(False, told={"unresolved": unresolved})
    shared = A.compare_companies(m, ids, top).select("name", F.lit(True).alias("shared"))
    rows = A.company_top_skills(m, ids, ("tag", "required"), top).join(F.broadcast(shared), "name", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    return Answer(True, rows, {"unresolved": unresolved, "company_ids": ids})


def similar_companies(m: Market, name: str, top: int = 5) -> Answer:
    company, candidates = _company(m, name)
    return Answer(False, told={"candidates": candidates}) if company is None else Answer(True, A.similar_companies(m, company, top), {"company_id": company})


def search_postings(m: Market, vec_id: int, field: str | None = None, career_max: int | None = None, section: int | None = None, top: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """Hits for a stored query vector; with ``texts (id, text)`` the first characters of each."""
    hits = A.search_postings(m, vec_id, section, top, field=field, career_max=career_max)
    if texts is None:
        return hits
    return hits.join(texts.select("id", F.left("text", F.lit(EXCERPT)).alias("excerpt")), "id", "left")


def search_companies(m: Market, vec_id: int, size_type: str | None = None, field: str | None = None, top: int = 10) -> DataFrame:
    return A.search_companies(m, vec_id, size_type, top, field)


def analyze_skill_gap(m: Market, skills: list[str] | None = None, field: str | None = None, career: str | None = None, top: int = 15, profile: Profile | None = None, as_of: str = AS_OF) -> Answer:
    """What is not given comes from the profile: its skills, first field and career level."""
    who = profile or Profile()
    mine = list(skills or who.skills)
    if not mine:
        return Answer(False, told={"reason": "no skills are known"})
    scope = Scope(field=field or next(iter(who.fields), None), career=career or who.career, days=90, as_of=as_of)
    names = A.resolved_names(m, mine).collect()  # a person's own skills
    told = {"matched": sorted(r["name"] for r in names if r["name"]), "unknown": sorted(r["raw"] for r in names if not r["name"])}
    return Answer(True, A.missing_skills(m, mine, scope, top), told)


def data_coverage(m: Market, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    return {"totals": A.data_coverage(m, runs=runs), "breakdown": A.coverage_breakdown(m)}
