"""Pages: nesting, choice by attribute, entities, forms of attributes and links, dates."""

import datetime

import pytest
from pyspark.sql import functions as F

from stancewise.sources import markup, tables

PAGES = "page_id long, url string, html string"
BODY = " palabra" * 60


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ('<div itemprop="articleBody">inflaci&oacute;n &amp; d&#233;ficit &#xE9; &lt;b&gt;</div>', "inflación & déficit é <b>"),
        ("<div itemprop='articleBody'>a<div>b</div>c</div>d", "a b c"),
        ("<DIV ItemProp=articleBody>a<br>b<br/>c<img src='>'>d</DIV>e", "a b c d"),
        ('<div class="box item-page wide">one<p>two<p>three</div>four', "one two three"),
        ('<div class="item-pages">no</div>', None),
        ('<div class="item-page">second choice</div><div itemprop="articleBody">first choice</div>', "first choice"),
        ('<div itemprop="articleBody">a<!-- no <b> --><script>var x = "</div>";</script><style>p{}</style>b</div>c', "a b"),
        ('<div itemprop="articleBody">a</p></span>b</div>c', "a b"),
        ('<div itemprop="articleBody">never closed <b>bold', "never closed  bold"),
        ('<div itemprop="articleBody">a</div><div itemprop="articleBody">b</div>', "a"),
        ('<div itemprop="articleBody" itemprop="other">a &unknown; &amp;lt; b</div>', "a &unknown; &lt; b"),
        ('<div itemprop="articleBody">a < b & c</div>', "a < b & c"),
        ("<section><div itemprop=articleBody>a<section>b</section></section>c", "a b"),
        ('<div itemprop="articleBody"><h1>cut &amp;&amp</h1>off &#39 &lt &ampx; &#39;&lt;</div>', "cut &&amp off &#39 &lt &ampx; '<"),
        ("", None),
        ("plain", None),
    ],
)
def test_bodies(html, body):
    assert markup.scan(html).found()[0] == body


def test_pages_with_unknown_declarations_are_read_as_far_as_they_go():
    assert markup.scan('<div itemprop="articleBody">a<![if x]>b</div>').found()[0] is not None
    assert markup.scan("<article>a<![x[y", (("article", None, None),)).found()[0].startswith("a")


def test_links_of_all_forms(spark):
    html = """<a href="/informacion/discursos/1">x</a><A HREF='/informacion/discursos/2'>y</A><a class=c href=/informacion/discursos/3 >z</a>
      <a href = "https://other.example/informacion/discursos/4?a=1&amp;b=2">w</a><a href="/informacion/discursos/?start=20">next</a><a name="q">no</a>
      <link href="/informacion/discursos/no"><a href="5">relative</a><a href="//[bad/informacion/discursos/6">bad</a><a href="/informacion/discursos/1">again</a><!-- <a href="/informacion/discursos/7"> -->"""
    pages = spark.createDataFrame([(1, "https://host.example/informacion/discursos/", html), (2, "u", None)], PAGES)
    root = "https://host.example/informacion/discursos/"
    got = {r["url"] for r in tables.page_links(pages, "/informacion/discursos/", "start=").collect()}
    assert got == {*(root + x for x in "1235"), "https://other.example/informacion/discursos/4?a=1&b=2", "//[bad/informacion/discursos/6"}
    rooted = {r["url"] for r in tables.page_links(pages.withColumn("url", F.lit("x")), "/informacion/discursos/", "start=", "https://root.example").collect()}
    assert "https://root.example/informacion/discursos/2" in rooted


def test_dates_and_words_of_pages(spark):
    div = '<div itemprop="articleBody">'
    rows = [
        (1, f"<time>3 de Mayo de 2021</time>{div}el 1 de enero de 1999{BODY}</div>"), (2, f"<title>31 de diciembre de 2019</title>{div}{BODY}</div>"), (3, f"{div}31 de febrero de 2019{BODY}</div>"),
        (4, f"{div}1 de foo de 2019{BODY}</div>"), (5, f"{div}{BODY * 2} 1 de mayo de 2019</div>"), (6, f"{div}short</div>"), (7, f"<time></time>{div}1 de mayo de 2019{BODY}</div>"),
        (8, f"{div}2 de&nbsp;marzo de 2020 inflaci&oacute;n{BODY}</div>"), (9, f"<p>{BODY}</p>"), (10, None),
    ]
    found = {r["page_id"]: r for r in tables.page_speeches(spark.createDataFrame([(i, "u", h) for i, h in rows], PAGES)).collect()}
    assert {i: r["date"] for i, r in found.items()} == {1: datetime.date(2021, 5, 3), 2: datetime.date(2019, 12, 31), 3: None, 4: None, 5: None, 7: None, 8: None}
    assert found[8]["text"].startswith("2 de marzo de 2020 inflación palabra") and found[8]["n_words"] == 4 + 60
    dated = spark.createDataFrame([(1, datetime.date(2020, 1, 1)), (2, datetime.date(2019, 1, 1)), (3, None)], "id long, date date")
    assert {r["id"] for r in tables.since(dated, "2020-01-01").collect()} == {1, 3}
