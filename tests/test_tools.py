"""Tools of the chat: periods, names, profiles."""

import pytest

from laborlens.operators import analytics as A
from laborlens.operators import tools
from laborlens.operators.filters import Scope
from laborlens.sources.market import Market

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def m(spark):
    return Market(spark, SF)


def test_windows():
    assert tools.window_of("week", "2001-07-01 00:00:00") == ("2001-06-17 15:00:00", "2001-06-24 15:00:00")
    assert tools.window_of("week", "2001-07-01 15:00:00") == ("2001-06-24 15:00:00", "2001-07-01 15:00:00")  # Monday 0 o'clock in Seoul
    assert tools.window_of("week", "2001-07-01 00:00:00", 2)[1] == "2001-06-17 15:00:00"
    assert tools.window_of("month", "2001-01-31 16:00:00") == ("2000-12-31 15:00:00", "2001-01-31 15:00:00")
    assert tools.window_of("month", "2001-01-31 16:00:00", 2) == ("2000-11-30 15:00:00", "2000-12-31 15:00:00")
    with pytest.raises(ValueError, match="week or a month"):
        tools.window_of("day")


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_period_wins_over_days(m):
    week = tools.window_of("week")
    assert rows(tools.popular_skills(m, period="week", days=1)) == rows(A.popular_skills(m, Scope(window=week), 10))
    assert rows(tools.popular_skills(m)) == rows(A.popular_skills(m, Scope(days=30), 10))
    assert rows(tools.rising_skills(m, window_days=30)["totals"]) == rows(A.rising_totals(m, ("2001-06-01 00:00:00", "2001-07-01 00:00:00"), ("2001-05-02 00:00:00", "2001-06-01 00:00:00")))
    assert rows(tools.salary_stats(m)) == rows(A.salary_stats(m))
    assert rows(tools.compare_segments(m, "size", days=365)) == rows(A.stacks_by_segment(m, "size", Scope(days=365), 8))


def test_unknown_skills_are_told(m):
    assert not tools.skill_demand(m, "nothing").found and not tools.related_skills(m, "nothing").found
    assert rows(tools.skill_demand(m, "brand#13").rows) == rows(A.skill_demand(m, "brand#13"))
    total = {(r.kind, r.key): r.n for r in A.skill_demand(m, "nothing").collect()}
    assert total.get(("total", ""), 0) == 0


def test_companies_by_name(m):
    one = tools.company_profile(m, " customer#000000002 ")
    assert one.found and one.told == {"company_id": 2} and {"skill", "career"} <= {r.kind for r in one.rows.collect()}
    many = tools.company_profile(m, "Customer#00000001")
    assert not many.found and many.told["status"] == "ambiguous" and len(many.told["candidates"]) == 10
    assert tools.company_profile(m, "nobody").told["status"] == tools.company_profile(m, " ").told["status"] == "not_found"
    assert not tools.compare_companies(m, ["Customer#000000002", "nobody"]).found
    two = tools.compare_companies(m, ["Customer#000000002", "x y", "Customer#000000004"])
    assert two.told == {"unresolved": ["x y"], "company_ids": [2, 4]} and {r.company_id for r in two.rows.collect()} == {2, 4}
    assert rows(tools.similar_companies(m, "Customer#000000002").rows) == rows(A.similar_companies(m, 2, 5))


def test_a_profile_fills_what_is_not_given(m):
    who = tools.Profile(("Brand#11", "brand 22", "unheard"), ("asia", "europe"), "mid")
    got = tools.analyze_skill_gap(m, profile=who)
    assert got.told == {"matched": ["Brand#11", "Brand#22"], "unknown": ["unheard"]}
    assert rows(got.rows) == rows(A.missing_skills(m, list(who.skills), Scope(field="asia", career="mid", days=90)))
    own = tools.analyze_skill_gap(m, ["Brand#13"], field="africa", career="junior", profile=who)
    assert own.told["matched"] == ["Brand#13"] and rows(own.rows) == rows(A.missing_skills(m, ["Brand#13"], Scope(field="africa", career="junior", days=90)))
    assert not tools.analyze_skill_gap(m).found and not tools.analyze_skill_gap(m, profile=tools.Profile()).found


def test_coverage_with_nothing_owned_is_that_of_the_sql(m):
    """A sum over no owned skill is null, as in the SQL of skill_gap; missing_skills and the tool tell 0, as the tool's SQL does."""
    assert {r.coverage for r in A.skill_gap(m, ["nobody knows"], top=5).collect()} == {None}
    assert {r.coverage for r in A.missing_skills(m, ["nobody knows"], top=5).collect()} == {0.0}
