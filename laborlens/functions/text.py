"""Normalisers of posting text as columns; all of them stay inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms and separators that a company's key drops.
_LEGAL = r"(?iu)\(주\)|\(株\)|㈜|주식회사|유한회사|\(유\)"
_BRACKETED = r"[\(\[（【][^\)\]）】]*[\)\]）】]"
_SEPARATORS = r"(?U)[\s\-_.,'\"·•]+"

# Header lines of sections; the first that fits decides.
SECTIONS = (
    (
        "ignore",
        r"복리\s*후생|복지|근무\s*조건|근무\s*환경|근무\s*시간|채용\s*절차|전형\s*절차|지원\s*방법|제출\s*서류|기타\s*사항|유의\s*사항|회사\s*소개|서비스\s*소개"
        r"|^[\W\d_]*(?:hiring|recruit(?:ment)?|selection)?\s*(?:process(?:es)?|benefits?|welfare|perks)(?:\s*[&/]\s*(?:benefits?|perks))?[\W\d_]*$",
    ),
    ("preferred", r"우대\s*사항|우대\s*조건|우대\s*요건|있으면\s*좋아요|environment|이런\s*분(들)?(을|이라면|이면)?\s*(환영|더\s*좋)|preferred|nice\s*to\s*have|plus"),
    ("required", r"자격\s*요건|지원\s*자격|필수\s*요건|필수\s*조건|필수\s*역량|자격\s*조건|이런\s*분(들)?(을|를)?\s*(찾|모)|requirements?|qualifications?|must\s*have"),
    ("responsibility", r"주요\s*업무|담당\s*업무|업무\s*내용|수행\s*업무|이런\s*일을\s*해"),
)
HEADER_CHARS = 60
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"

# Keywords of tech fields in the order in which they are tried; WHOLE ones need word boundaries.
FIELDS = (
    ("security", ("보안", "security", "해킹", "침해")),
    ("embedded", ("임베디드", "embedded", "펌웨어", "firmware", "hw", "제어", "h/w", "hw/", "하드웨어", "반도체", "asic", "fpga", "회로")),
    ("game", ("게임", "game")),
    ("data_ai", ("인공지능", "머신러닝", "딥러닝", "빅데이터", "데이터 엔지니어", "데이터 사이언", "ai", "ml 엔지니어", "data engineer", "data scien")),
    ("mobile", ("안드로이드", "android", "ios", "모바일", "앱개발", "크로스플랫폼")),
    ("frontend", ("프론트", "frontend", "퍼블리셔", "웹 개발자")),
    ("backend", ("서버", "백엔드", "backend", "풀스택", "si개발", "si·", "si/")),
    ("devops", ("devops", "시스템 엔지니어", "인프라", "클라우드", "sre", "네트워크", "시스템엔지니어", "system engineer", "시스템관리", "서버관리")),
    ("data_ai", ("dba", "데이터", "data")),
)
WHOLE = ("ai", "hw", "sre", "c", "ml 엔지니어")

# Least employees of each size, and tags that name a size.
SIZES = ((1000, "enterprise"), (300, "large"), (100, "medium"), (30, "small"), (1, "startup"))
SIZE_TAGS = {"대기업": "enterprise", "중견기업": "large", "중소기업": "medium", "스타트업": "startup"}

# How salaries are worded, and the plausible amounts in units of 10,000.
_NEGOTIABLE = "회사내규|사내규정|면접 후|면접후|협의|추후 결정|미정"
_FOREIGN = r"(?i)[$€£¥₹]|\b(usd|eur|jpy|gbp|krw\s*equivalent)\b"
_HOURLY = r"(?i)시급|시간\s*당|hourly|per\s*hour"
_MONTHLY = r"(?i)월\s*급|월급여|월\s*\d|monthly|per\s*month"
_NUM, _UNIT = r"(\d[\d,]*)", r"\s*만\s*원?"
MONTHLY_RANGE, ANNUAL_RANGE = (50, 10_000), (1_000, 100_000)


#: All characters that Unicode calls white space, which is what ``(?U)\\s`` fits.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{BLANKS}]+", " "))


def company_key(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), _LEGAL, ""), _BRACKETED, "")
    return F.lower(F.regexp_replace(plain, _SEPARATORS, ""))


def section_of(line: Column) -> Column:
    """Section that a header line opens, else null."""
    text = stripped(line)
    out = F.when((text == "") | (F.length(text) > HEADER_CHARS), F.lit(None).cast("string"))
    for name, pattern in SECTIONS:
        out = out.when(text.rlike(f"(?iuU){pattern}"), name)
    return out


def sections(text: Column) -> Column:
    """``array<struct<section,text>>`` of a body: a header opens a block, what stands before the first is ``body``; blank blocks go."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)

    def blocks(ln: Column) -> Column:
        heads = F.filter(F.transform(ln, lambda x, i: F.struct(i.alias("at"), section_of(x).alias("section"))), lambda h: h["section"].isNotNull())
        heads = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("body").alias("section"))), heads)

        def cut(hs: Column) -> Column:
            end = lambda i: F.coalesce(F.get(hs, i + 1)["at"], F.size(ln))
            return F.transform(hs, lambda h, i: F.struct(h["section"].alias("section"), stripped(F.array_join(F.slice(ln, h["at"] + 2, end(i) - h["at"] - 1), "\n")).alias("text")))

        return F.element_at(F.transform(F.array(heads), cut), 1)

    return F.filter(F.element_at(F.transform(F.array(lines), blocks), 1), lambda b: b["text"] != "")


def field_vote(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for field, words in FIELDS:
        out = out.when(low.rlike("(?U)" + "|".join(rf"\b{re.escape(w)}\b" if w in WHOLE else re.escape(w) for w in words)), field)
    return out


def tech_field(categories: Column, title: Column) -> Column:
    """Majority of the categories' votes; a tie goes to the title if it is for one of the tied, no vote to the title."""
    votes = F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), field_vote), lambda v: v.isNotNull())

    def decide(v: Column) -> Column:
        n = lambda f: F.size(F.filter(v, lambda y: y == f))
        most = F.array_max(F.transform(v, n))
        tied = F.filter(F.array_distinct(v), lambda f: n(f) == most)
        by_title = field_vote(title)
        return F.when(F.size(v) == 0, by_title).when(F.size(tied) == 1, F.get(tied, F.lit(0))).when(F.array_contains(tied, by_title), by_title)

    return F.element_at(F.transform(F.array(votes), decide), 1)


def company_size(employees: Column, tags: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for least, name in SIZES:
        out = out.when(employees >= least, name)
    named = F.create_map(*(F.lit(x) for pair in SIZE_TAGS.items() for x in pair))
    known = F.filter(F.transform(tags, lambda t: F.try_element_at(named, F.trim(t))), lambda s: s.isNotNull())
    return F.coalesce(out, F.get(known, F.lit(0)), F.lit("unknown"))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("bigint")


def salary(raw: Column) -> Column:
    """``struct<low,high,kind,period>`` in units of 10,000 a year."""
    t = stripped(raw)
    monthly = t.rlike(_MONTHLY)
    period = F.when(monthly, "monthly").otherwise("annual")

    def amount(x: Column) -> Column:
        fits = F.when(monthly, x.between(*MONTHLY_RANGE)).otherwise(x.between(*ANNUAL_RANGE))
        return F.when(fits, F.when(monthly, x * 12).otherwise(x)).cast("int")

    def made(low: Column, high: Column, kind: str, per: Column) -> Column:
        return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(kind).alias("kind"), per.cast("string").alias("period"))

    none = F.lit(None)
    unknown = made(none, none, "unknown", none)
    pair = rf"{_NUM}(?:{_UNIT})?\s*[~\-–]\s*{_NUM}(?:{_UNIT})?"
    least, most, one = (rf"{_NUM}(?:{_UNIT})?{x}" for x in (r"\s*이상", r"\s*이하", ""))
    a, b = (_number(F.regexp_extract(t, pair, i)) for i in (1, 2))
    single = lambda p: amount(_number(F.regexp_extract(t, p, 1)))
    low, high = amount(F.least(a, b)), amount(F.greatest(a, b))
    return (
        F.when(t.isNull() | (t == ""), unknown)
        .when(t.rlike(_NEGOTIABLE), made(none, none, "negotiable", none))
        .when(t.rlike(_FOREIGN), unknown)
        .when(t.rlike(_HOURLY), made(none, none, "unknown", F.lit("hourly")))
        .when(t.rlike(pair), F.when(low.isNotNull() & high.isNotNull(), made(low, high, "range", period)).otherwise(unknown))
        .when(t.rlike(least), F.when(single(least).isNotNull(), made(single(least), none, "min_only", period)).otherwise(unknown))
        .when(t.rlike(most), F.when(single(most).isNotNull(), made(none, single(most), "max_only", period)).otherwise(unknown))
        .when(single(one).isNotNull(), made(single(one), single(one), "range", period))
        .otherwise(unknown)
    )


def career(text: Column) -> Column:
    """``struct<low,high>`` of years; both null if any will do."""
    made = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    none = F.lit(None)
    pair, least, one = r"(\d+)\s*[~\-]\s*(\d+)\s*년", r"(\d+)\s*년\s*(?:이상|↑)", r"(\d+)\s*년"
    a, b = (_number(F.regexp_extract(text, pair, i)) for i in (1, 2))
    return (
        F.when(text.isNull() | text.rlike(r"무관|신입\s*[·/]?\s*경력|경력\s*무관"), made(none, none))
        .when(text.rlike(pair), made(F.least(a, b), F.greatest(a, b)))
        .when(text.rlike(least), made(_number(F.regexp_extract(text, least, 1)), none))
        .when(text.rlike("신입"), made(F.lit(0), F.lit(0)))
        .when(text.rlike(one), made(_number(F.regexp_extract(text, one, 1)), none))
        .otherwise(made(none, none))
    )


def employee_count(text: Column) -> Column:
    n = _number(F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"[\d,]+", 0))
    return F.when(n.between(1, 50_000), n).cast("int")


def revenue(text: Column) -> Column:
    """Sum of the units of 10**12, 10**8 and 10**4 before the currency; null without any."""
    pattern = r"(?:(\d[\d,]*)\s*조)?\s*(?:(\d[\d,]*)\s*억)?\s*(?:(\d[\d,]*)\s*만)?\s*원"
    t = F.replace(text, F.lit(" "), F.lit(""))
    part = lambda i, unit: F.coalesce(_number(F.regexp_extract(t, pattern, i)), F.lit(0)) * F.lit(unit)
    return F.nullif(part(1, 10**12) + part(2, 10**8) + part(3, 10**4), F.lit(0))


def description(responsibility: Column, qualifications: Column, preferred: Column) -> Column:
    """Headed blocks joined by a blank line; blank parts are left out."""
    heads = (("[주요업무]", responsibility), ("[자격요건]", qualifications), ("[우대사항]", preferred))
    parts = [F.when(stripped(x) != "", F.concat(F.lit(f"{h}\n"), stripped(x))) for h, x in heads]
    return F.nullif(F.concat_ws("\n\n", *parts), F.lit(""))


def content_hash(title, company, stacks, categories, locations, career_min, career_max, body, welfare, closed_at) -> Column:
    """SHA-256 over ten fields; lists count in order of code points, a missing year reads ``None``."""
    listed = lambda a: F.array_join(F.array_sort(F.coalesce(a, F.array().cast("array<string>"))), ",")
    year = lambda y: F.coalesce(y.cast("string"), F.lit("None"))
    blank = lambda x: F.coalesce(x, F.lit(""))
    return F.sha2(F.concat_ws("␟", blank(title), blank(company), listed(stacks), listed(categories), listed(locations), year(career_min), year(career_max), blank(body), blank(welfare), blank(closed_at)), 256)


def chunk_hash(section: Column, squeezed_content: Column) -> Column:
    return F.sha2(F.concat(section, F.lit("\x1f"), squeezed_content), 256)


def token_estimate(squeezed_content: Column) -> Column:
    return F.greatest(F.lit(1), F.length(squeezed_content))
