"""Elements of nested, unclosed and commented markup, and the time it takes to find them."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.functions.markup import VOID, Select, _Page, elements
from hearth.sources import html_cards

CARD = {"card": Select("div", "c", inside={"name": Select("b"), "link": Select("a", attrs=("href",), has=("href",), text=False)})}


def read(page, wanted=CARD):
    return _Page(wanted).read(page)


def names(page):
    return [(c["text"], [n["text"] for n in c["name"]]) for c in read(page)["card"]]


def test_nested_and_unclosed():
    assert names("<div class='c'><div>x<div>y</div></div><b>n</b>z</div>out") == [("xynz", ["n"])]
    # the second card lies in the first, which was never closed, and keeps what is its own
    assert names("<div class='c'><div class='c'><b>two</b></div>") == [("two", []), ("two", ["two"])]
    assert names("<li><div class='c'><b>one</b><li></li><div class='c'><b>two</b></div>") == [("onetwo", ["one"]), ("two", ["two"])]
    assert names("<section><div class=c><p>a<p>b<i>c</section>d") == [("abc", [])]
    # an inline end tag ends nothing behind a block, and an end tag without a begin nothing at all
    assert names("<b><div class='c'>x</b></em></p>y</div>z</b>") == [("xy", [])]


def test_what_is_no_element():
    assert names("<!-- <div class='c'> --><!doctype html><style>div { } <div class='c'></style>") == []
    assert names("<script>a < b '<div class=\"c\">'</script><div class='c'>x<script>y</script>z</div>") == [("xz", [])]
    assert names("<div class='c'>x<!-- </div> -->y") == [("xy", [])]
    assert names("<div class='c'>x<!-- y") == [("x", [])]
    assert names("") == [] and names("1 < 2 <div class='c' <b>") == []


def test_attributes_and_text():
    found = read("<DIV title='a > b' CLASS=c><A href='/x?a=1&amp;b=2&para=3' href='no'>&lt;b&gt;</A><a>no</a><a href=''>no</a></DIV>")["card"]
    assert [c["link"] for c in found] == [[{"href": "/x?a=1&b=2&para=3"}]] and found[0]["text"] == "<b>nono"
    assert read("<div class=c><a href=/x/>1</a><b/>2</div>")["card"] == [{"text": "12", "name": [{"text": ""}], "link": [{"href": "/x/"}]}]
    rows = {"t": Select("p", breaks="\n"), "part": Select("p", "x", part=True, lacks=("style",))}
    out = read("<p class='a x'>1<br>2<br/>3</p><p class='x' style=''>4", rows)
    assert [t["text"] for t in out["t"]] == ["1\n2\n3", "4"] and [t["text"] for t in out["part"]] == ["123"]


def test_sibling_before():
    wanted = {"card": Select("div", "c", after={"pic": Select("div", "m", text=False, inside={"img": Select("img", attrs=("src",), text=False)})})}
    page = "<div class='m'><img src='1'></div><div class='m'><p><img src='2'></div><br><div class='c'>a</div><section><div class='c'>b</div></section><div class='c'>c</div>"
    assert [[i["src"] for p in c["pic"] for i in p["img"]] for c in read(page, wanted)["card"]] == [["2"], [], ["2"]]


def test_as_a_column(spark):
    rows = spark.createDataFrame([(1, "<div class='c'><b>n</b></div>"), (2, None), (3, "")], "i long, page string")
    found = rows.select("i", elements(F.col("page"), **CARD).alias("e")).orderBy("i").collect()
    assert [[(c["text"], [n["text"] for n in c["name"]], list(c["link"])) for c in r["e"]["card"]] for r in found] == [[("n", ["n"], [])], [], []]
    assert rows.limit(0).select(elements(F.col("page"), **CARD)).collect() == []


class _Reference(HTMLParser):
    """The texts of all elements of well-formed markup, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.open, self.out = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.out.append([tag, ""])
        if tag not in VOID:
            self.open.append(len(self.out) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for i in self.open:
            self.out[i][1] += data


_trees = st.recursive(st.text("ab 1", max_size=4), lambda inner: st.tuples(st.sampled_from(["div", "b", "section", "img"]), st.lists(inner, max_size=4)), max_leaves=25)


def _written(tree):
    if isinstance(tree, str):
        return tree
    tag, parts = tree
    return "<img>" if tag == "img" else f"<{tag}>{''.join(map(_written, parts))}</{tag}><!-- <{tag}> -->"


@settings(max_examples=200, deadline=None)
@given(st.lists(_trees, max_size=4))
def test_equals_a_parser_on_closed_markup(trees):
    page = "".join(map(_written, trees))
    found = read(page, {t: Select(t) for t in ("div", "b", "section", "img")})
    expected = _Reference(page).out
    for tag, rows in found.items():
        assert [r["text"] for r in rows] == [text.strip() for t, text in expected if t == tag]


def test_time_grows_with_the_page():
    parts = ("<div class='c'><b>", "<a", "<!", "</", "<a '", "<b><div>", "</b>", "<i></u>", "<a \"'", "<p", "&amp;", "<script", "<a " + " " * 9)
    for part in parts:
        spent = []
        for n in (20_000, 160_000):
            page = part * n
            begin = time.perf_counter()
            read(page, {"x": Select("section")})
            spent.append(time.perf_counter() - begin)
        assert spent[1] < 24 * spent[0] + 0.2, (part, spent)


def test_batches_of_pages_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        page = "<div class='prop'><div class='prop-imgWrap'><a href='/i/{}'></a></div></div>" + " " * 100_000
        landed = spark.range(500).select(F.col("id").alias("batch"), F.concat(F.lit(page.split("{}")[0]), F.col("id").cast("string"), F.lit(page.split("{}")[1])).alias("payload")).coalesce(1)
        rows = html_cards.cards(landed, html_cards.PROPS).select("batch", F.col("card.wrap")[0]["link"][0]["href"].alias("href"))
        assert sorted(map(tuple, rows.collect())) == [(k, f"/i/{k}") for k in range(500)]
        sizes = landed.select(F.arrow_udf(lambda x: pa.array([len(x)] * len(x)), returnType="long")("payload").alias("n")).distinct().collect()
        assert max(r["n"] for r in sizes) <= 100
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
