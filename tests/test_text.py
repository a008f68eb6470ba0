"""Cases of the text rules, made from the rules."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from laborlens.functions import skills, text
from laborlens.operators.chunks import MAX_CHARS, MIN_TAIL, chunks, closing_hashes, long_split
from laborlens.functions.html import BOILERPLATE, block_text, content_images
from laborlens.functions.page import Page

SALARY = [
    ("4,200 ~ 5,100 만원", (4200, 5100, "range", "annual")),
    ("5100–4200", (4200, 5100, "range", "annual")),
    ("7,000 만 원 이상", (7000, None, "min_only", "annual")),
    ("9000만원 이하", (None, 9000, "max_only", "annual")),
    ("월급 250 ~ 310만원", (3000, 3720, "range", "monthly")),
    ("monthly 410", (4920, 4920, "range", "monthly")),
    ("per hour 15", (None, None, "unknown", "hourly")),
    ("협의 후 4,000만원", (None, None, "negotiable", None)),
    ("추후 결정", (None, None, "negotiable", None)),
    ("€ 65,000", (None, None, "unknown", None)),
    ("999만원", (None, None, "unknown", None)),
    ("월 49만원", (None, None, "unknown", None)),
    ("100,001", (None, None, "unknown", None)),
    ("\t\n", (None, None, "unknown", None)),
    (None, (None, None, "unknown", None)),
]
FIELD = [
    (["android 앱", "정보보안"], "보안 담당", "security"),
    (["android 앱", "정보보안"], "기획", None),
    (["firmware", "FPGA 설계", "data 분석"], "게임", "embedded"),
    (["main office"], "", None),
    (["AI lab"], "", "data_ai"),
    (["풀스택", "인프라 운영"], "클라우드 운영", "devops"),
    (["기획", "마케팅"], "iOS 앱", "mobile"),
    (None, "DBA", "data_ai"),
    ([], None, None),
]
KEYS = [("주식회사  Blue-Whale", "bluewhale"), ("가람 소프트㈜", "가람소프트"), ("(유)하늘 [서울]", "하늘"), ("A.B. 'Lab'（R&D）", "ablab"), (None, "")]
KNOWN = [
    skills.Skill(1, ("ruby", "루비")),
    skills.Skill(2, ("ruby on rails",)),
    skills.Skill(3, ("f#", ".net")),
    skills.Skill(4, ("dart",), ambiguous=True),
    skills.Skill(5, exact=("Swift",)),
    skills.Skill(6, ("swift ui", "RUBY")),
]


def test_salary(spark):
    rows = spark.createDataFrame([(r,) for r, _ in SALARY], "raw string").select(text.salary(F.col("raw")).alias("s")).collect()
    assert [tuple(r.s) for r in rows] == [w for _, w in SALARY]


def test_tech_field(spark):
    rows = spark.createDataFrame([(c, t) for c, t, _ in FIELD], "c array<string>, t string").select(text.tech_field(F.col("c"), F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [f for *_, f in FIELD]


def test_company_key(spark):
    rows = spark.createDataFrame(KEYS, "n string, k string").select(text.company_key(F.col("n")).alias("g"), "k").collect()
    assert [r.g for r in rows] == [k for _, k in KEYS]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("Ruby on Rails, rubyist and RUBY", [2, 1]),
        ("루비로 짠 코드, 슈루비", [1]),
        ("F#/.NET, xf# and f#1", [3, 3]),
        ("throws a dart at noon", []),
        ("dart 사용", [4]),
        ("dart" + " " * 41 + "개발", []),
        ("swift and Swift and Swift UI", [5, 6]),
        ("", []),
        (None, []),
    ],
)
def test_mentions(body, want):
    assert [m[0] for m in skills.Matcher(KNOWN).in_bodies([body])[0]] == want


def test_mentions_are_leftmost_longest():
    """Against every substring that is an alias and may stand where it stands."""
    rng = random.Random(1)
    tree, names = skills.Matcher([skills.Skill(i, (a,)) for i, a in enumerate(("a", "ab", "a b", "b+", "가", "가나", "+"))]), ("a", "ab", "a b", "b+", "가", "가나", "+")
    word = lambda c: c.isascii() and c.isalnum()
    hangul = lambda c: "가" <= c <= "힣"
    texts = []
    wanted = []
    for _ in range(300):
        s = "".join(rng.choice("aAb +가나 ") for _ in range(30))
        every = []
        for i, j in itertools.combinations(range(len(s) + 1), 2):
            before, after = s[i - 1 : i], s[j : j + 1]
            if s[i:j].lower() in names and not (before and (word(before) or (hangul(before) and hangul(s[i])))) and not (after and word(after)):
                every.append((i, -j))
        want, at = [], 0
        for i, j in sorted(every):
            if i >= at:
                want.append((names.index(s[i:-j].lower()), i, -j))
                at = -j
        texts.append(s)
        wanted.append(want)
    assert tree.mentions(texts) == wanted
    long, shift, want = "".join(x + "|" for x in texts), 0, []
    for x, w in zip(texts, wanted):
        want += [(i, a + shift, b + shift) for i, a, b in w]
        shift += len(x) + 1
    assert tree.mentions([long, None, long]) == [want, [], want]  # pieces of a long text
    assert skills.Matcher([]).mentions(["a", None]) == [[], []]


def test_tags():
    one, two, none = skills.Matcher(KNOWN).in_tags([" Ruby ", "Swift, dart", None])
    assert one == [(1, 0, 6)] and [m[0] for m in two] == [5, 4] and none == []


def test_grades(spark):
    rows = spark.createDataFrame([(1, "ruby\n[자격요건]\nruby 경험\n[우대사항]\nf#\n[복리후생]\n.net", ["Dart"]), (2, None, [])], "id long, description string, tags array<string>")
    got = {(r.skill_id, r.requirement, r.mentions) for r in skills.graded(rows, KNOWN).collect()}
    assert got == {(1, "required", 2), (3, "preferred", 1), (4, "tag", 1)}


def test_chunks(spark):
    long = "\n".join(["y" * 150] * 20)
    rows = spark.createDataFrame([(1, "about us\n[주요업무]\nbuild\n[복리후생]\nlunch\n[자격요건]\n" + long), (2, " "), (3, None)], "id long, description string")
    got = chunks(rows).orderBy("section", "seq").collect()
    assert [(r.section, r.seq) for r in got] == [("required", 0), ("required", 1), ("required", 2), ("responsibility", 0)]
    assert got[3].content == "about us\nbuild" and all(r.token_count >= 1 for r in got)


def split(spark, *texts):
    return [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(long_split(F.col("t")).alias("p")).collect()]


def test_long_split(spark):
    short, cut, tail, bullets = split(spark, "- \nshort", "a" * 2500, "b" * 1190 + "\n" + "c" * 30, "\n".join(["• ", "d" * 200] * 12))
    assert short == ["- \nshort"]
    assert cut == ["a" * 1200, "a" * 1200, "a" * 100]
    assert tail == ["b" * 1190 + "\n" + "c" * 30]
    assert [p.count("d") for p in bullets] == [1000, 1000, 400] and not any("•" in p for p in bullets)


def test_long_split_keeps_every_line_in_order(spark):
    rng = random.Random(2)
    texts = ["\n".join("z" * rng.choice((0, 1, 39, 300, 1199, 1200, 1201, 3000)) for _ in range(12)) + "\nend" for _ in range(20)]
    for t, pieces in zip(texts, split(spark, *texts), strict=True):
        assert "".join(pieces).replace("\n", "") == t.replace("\n", "")
        assert len(t) <= MAX_CHARS or all(len(p) <= MAX_CHARS for p in pieces[:-1]) and len(pieces[-1]) <= MAX_CHARS + MIN_TAIL


def test_hash_closes_only_when_all_is_embedded(spark):
    postings = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, content_hash string")
    plan = spark.createDataFrame([(1, "required", 0, "embed"), (1, "required", 1, "reuse"), (2, "required", 0, "embed"), (2, "body", 0, "embed"), (4, "body", 0, "reuse")], "posting_id long, section string, seq int, action string")
    done = spark.createDataFrame([(1, "required", 0), (2, "required", 0)], "posting_id long, section string, seq int")
    assert {tuple(r) for r in closing_hashes(postings, plan, done).collect()} == {(1, "a"), (3, "c")}


def test_html():
    page = Page("<nav>menu</nav><p>a<br>b</p><script>x</script><img src='i.png'><img src='logo.png'>").without(BOILERPLATE)
    assert (block_text(page, 0), content_images(page, 0)) == ("a\nb", ["i.png"])
    assert block_text(Page(None), 0) == ""
