import time

import pytest
from pyspark.sql import functions as F

from surveytab.llm.html_main import extracted, main_text, main_texts

PROSE = "Some words, with commas, that go on for a while and make a paragraph of fair length. "


def page(inside, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{inside}{after}</body></html>"


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain text, a < b &amp; c", "plain text, a < b & c"),
    (page("<article><h1>Head</h1><p>One &amp; two&nbsp;three\n four<p>Five<br>six</article>"), "Head\n\nOne & two three four\n\nFive six"),
    (page("<article><p>Body.</p></article>", "<nav><ul><li><a href=/>Home</a></ul></nav><header>Site</header>",
          "<aside>Side</aside><form><p>Mail me</p></form><footer>&copy; x</footer>"), "Body."),
    (page(f"<div class='content'><p>{PROSE}</p><p>Short.</p><div class='share'>Share</div></div>",
          "<div id='menu'><a href=1>A</a></div>", f"<div class='comments'><p>{PROSE * 3}</p></div><div class='sideBar sidebar'><p>{PROSE * 3}</p></div>"),
     f"{PROSE.strip()}\n\nShort."),
    (page(f"<section><p>{PROSE}</p></section><section><p>{PROSE}</p></section>"), f"{PROSE.strip()}\n\n{PROSE.strip()}"),
    (page("<article><p>Text.<script>var a = '<p>no</p>'</script></p><!-- <p>no</p> --><div class='ad banner'>Buy</div></article>"), "Text."),
    (page(f"<div><p>{PROSE}</p><ul><li>one</li><li>two</li></ul><ul><li><a href=1>x</a><li><a href=2>y</a></ul></div>"), f"{PROSE.strip()}\n\none\n\ntwo"),
    ("<article><p>cut off here <b>bold</b> and <a hre", "cut off here bold and"),
    ("<article><p>never closed comment<!-- x <p>y", "never closed comment"),
    (page("<p hidden>no</p><p>yes</p><p style='display:none'>no</p>"), "yes"),
    (page("<table><tr><td>a<td>b<tr><td>c</table>"), "a\n\nb\n\nc"),
])
def test_main_text(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("name", ["content no-sidebar", "has-header", "ad-free", "site-content with-widget"])
def test_wrappers_whose_names_have_a_word_for_something_else(name):
    menu = "<div class='menu'><a href=1>A</a> <a href=2>B</a></div>"
    body, comments = f"<p>{PROSE}</p><p>{PROSE}</p>", f"<div class='comments'><article><p>{PROSE}</p></article></div>"
    text = f"{PROSE.strip()}\n\n{PROSE.strip()}"
    assert main_text(page(f"<div class='{name}'>{menu}<article>{body}</article></div>")) == text
    assert main_text(page(f"{menu}<div class='{name}'>{body}</div>")) == text
    assert main_text(page(f"<article>{body}</article>{comments}")) == text


def test_links_between_paragraphs_stay():
    links = "<ul><li><a href=1>x</a><li><a href=2>y</a></ul>"
    assert main_text(page(f"<article><p>{PROSE}</p>{links}<p>{PROSE}</p>{links}</article>")) == (
        f"{PROSE.strip()}\n\nx\n\ny\n\n{PROSE.strip()}")


@pytest.mark.parametrize("html, text", [
    (page(f"<form id=aspnetForm><div><p>{PROSE}</p></div></form>"), PROSE.strip()),
    (page(f"<div data-title='the hidden cost of x'><p>{PROSE}</p></div>"), PROSE.strip()),
    (page(f"<div data-note=' class=\"menu\" '><p>{PROSE}</p></div>"), PROSE.strip()),
    (page(f"<div hidden><p>{PROSE}</p></div>"), PROSE.strip()),  # shown by a script later
    (page(f"<article><header><h1>Head</h1></header><p>{PROSE}</p></article>", "<header><h1>Site</h1></header>"), f"Head\n\n{PROSE.strip()}"),
    (page(f"<article><p>{PROSE}</p></article><article><p>Shorter one.</p></article>"), f"{PROSE.strip()}\n\nShorter one."),
    (page(f"<article><p>{PROSE}</p><div class='work-related'><p>Injuries.</p></div><table class='share-prices'><tr><td>7</table></article>"),
     f"{PROSE.strip()}\n\nInjuries.\n\n7"),
    (page(f"<article><p>{PROSE}</p><div class='related-posts'><p>More.</p></div><div class='social-share'>Post it</div></article>"), PROSE.strip()),
    (page(f"<p>Short lead.</p><div><p>{PROSE}</p><p>{PROSE}</p></div><h2>After</h2><p>Short end.</p>"),
     f"Short lead.\n\n{PROSE.strip()}\n\n{PROSE.strip()}\n\nAfter\n\nShort end."),
])
def test_nothing_of_the_article_is_lost(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html", [
    "<x>" * 60_000 + "<h1></h1>" * 60_000, "<div>" * 60_000 + "</p>" * 60_000, "<li>" * 100_000 + "</ul>" * 100_000,
    "<table>" * 50_000 + "</b></td>" * 50_000, "<a href='" * 50_000, "<" * 200_000, "<p class=" * 100_000,
], ids=["headings", "ends", "items", "cells", "quotes", "signs", "attributes"])
def test_hostile_pages_take_time_by_their_length(html):
    start = time.process_time()
    main_text(html)
    assert time.process_time() - start < 4


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(main_text(page("<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"))) == 5000 * (len(PROSE) + 1) - 2
    assert main_text("< " * 50_000 + "x").endswith("< x")


def test_rows(spark):
    rows = [(1, "u", page("<p>ä b</p>")), (2, None, None), (None, "v", ""), (1, "u", page("<p>ä b</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_texts(pages).collect()), key=str)
    assert got == sorted([(1, "u", "ä b", 3), (1, "u", "ä b", 3), (2, None, "", 0), (None, "v", "", 0)], key=str)
    found, name = extracted(pages.withColumn("text", F.lit(5)))
    assert name == "text_" and {r.text for r in found.collect()} == {5}
    assert main_texts(pages.limit(0)).collect() == []
