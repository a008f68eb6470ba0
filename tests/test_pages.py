"""Plain tags read by one pattern against the library's parser, and how pages are dealt over tasks."""

import random

import pyarrow as pa
import pytest

from laborlens import registry
from laborlens.functions import html, page
from laborlens.functions.spread import TASKS_A_CORE

SF = "/root/testdata/sf0.001"
PARTS = (
    "<div>", "</div>", '<p class="k ad-x">', "<P ID=i>", "text &amp; x", "a&ampb", "<br/>", "<img src=a.png width='3'>", "<a href=x/>", "<!-- c -- >", "<!---->", "<!doctype html>", "<!x>", "<?pi?>", "<script>", "</script>",
    '<SCRIPT>var a="<b>";</SCRIPT >', "<script/>", "<style>", "<", " < ", '<a href="x"y>', '<a href = "x">', '<a href="x>', "<li>", "<ul>", "<td>", "<table>", "</table>", "<dt>", "<dd>", "<nav>", "</body>", "<title>t &amp", "</title>",
    "&", "&#65;", "<a/b>", '</div x=">">', "</>", "<a =b>", "<section aria-hidden='true' class=blind>", '<a a="1" A="2">', "\n", "<p\xa0x='1'>", "<p x=1\x0b>",
)


@pytest.fixture(scope="module")
def slow():
    """Pages read by the library's parser alone."""

    class Slow(page._Builder):
        def read(self, html):
            self.feed(html)
            self.close()
            self.close_to(0)

    def read(text, fast=page._Builder):
        page._Builder = Slow
        try:
            return page.Page(text)
        finally:
            page._Builder = fast

    return read


def test_plain_tags_are_read_as_by_the_library(slow):
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(1, 14)))
        a, b = page.Page(text), slow(text)
        assert vars(a) == vars(b), text


def test_selectors_below_an_element_and_without_what_is_gone():
    p = page.Page("<div class=k><p class='k x'>a</p><nav><p class=k>b</p></nav></div><p>c</p>")
    assert list(p.select("div p")) == [3, 5] and list(p.select("p, .k", 4)) == [5] and p.one(".k", 6) is None
    assert list(p.without("nav").select(".k")) == [2, 3] and list(p.select(".k")) == [2, 3, 5]


@pytest.mark.parametrize("name", ["src6_site_c_list", "src7_site_c_detail", "src8_site_d_list", "src8_site_d_detail", "tx17_label_values", "tx21_images", "tx16_tx18_tx20_bodies", "tx17_tx19_tx23_structured"])
def test_pages_are_parsed_in_as_many_tasks_as_there_are_cores(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    n = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parsed = plan[plan.index("ArrowEvalPython") :]
    assert f"{n}), REPARTITION_BY_NUM" in parsed


def test_few_pages_are_held_at_a_time():
    asked = []

    class Seen:
        def __call__(self, x):
            asked.append(x)
            return (x,)

    made = html.read(Seen(), html.StructType([html._BODY["text"]]), "h")
    assert made is not None
    run = html.slices(Seen(), pa.struct([("text", pa.string())]))
    first = next(run(iter([(pa.array(["a"] * (3 * html.BATCH)),)])))
    assert len(first) == len(asked) == html.BATCH


@pytest.mark.parametrize("name", ["tx28_long_chunks", "tx28_chunks", "tx6_skill_round_trip"])
def test_bodies_are_cut_in_as_many_tasks_as_there_are_cores(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_white_space_is_that_of_unicode(spark):
    from pyspark.sql import functions as F

    from laborlens.functions import text

    rows = spark.createDataFrame([(f"{c}a{c}{c}b{c}",) for c in map(chr, range(1, 0x3100))], "t string")
    old = rows.select(text.stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).alias("x"), text.squeezed(F.col("t")).eqNullSafe(F.trim(F.regexp_replace("t", r"(?U)\s+", " "))).alias("y"))
    assert old.where("not x or not y").isEmpty()
