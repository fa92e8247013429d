"""Main text of pages of several makes, of broken markup, and of the fixture pages."""

from __future__ import annotations

import html
import random
import re
import time

import pytest

from millrace.llm.main_text import SHORT, WORDS, classified, cut, main_text, page_blocks, page_row
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
STOPS = WORDS["STOP_WORDS"]


def text_of(source: str | None) -> str:
    return page_row(classified(source, STOPS))[0]


def prose(r: random.Random, n: int) -> str:
    words = ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for"]
    return " ".join(r.choice(words) if r.random() < 0.45 else "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(3, 9))) for _ in range(n)).capitalize() + "."


def page(seed: int) -> tuple[str, str]:
    """A page of one of several makes, and its article."""
    r = random.Random(seed)
    head, paragraphs = prose(r, 6), [prose(r, r.choice((3, 40, 70, 120))) for _ in range(r.randint(3, 8))]
    paragraphs[r.randrange(len(paragraphs))] = prose(r, 90)
    text = " ".join([head, *paragraphs])
    menu = "<ul>" + "".join(f'<li><a href="/{k}">{prose(r, 2)}</a></li>' for k in range(6)) + "</ul>"
    body = f"<h1>{head}</h1>" + "".join(f"<p>{p}" + r.choice(("</p>", "\n")) for p in paragraphs)
    notice = f'<div class="cookie-notice"><p>{prose(r, 60)}</p><button>Accept</button></div>'
    comments = f'<section id="comments"><h2>{prose(r, 2)}</h2><div class="comment"><p>{prose(r, 80)}</p></div></section>'
    form = f'<form action="/s"><label>{prose(r, 12)}</label><input name="q"><select><option>{prose(r, 30)}</option></select><textarea>{prose(r, 60)}</textarea></form>'
    aside = r.choice((f"<aside><h3>More</h3><p>{prose(r, 60)}</p></aside>", f'<div class="page-sidebar"><p>{prose(r, 60)}</p></div>'))
    advert = f'<div id="AdBox-3">{prose(r, 70)}</div><script>if (a < b) document.write("<p>{prose(r, 50)}</p>")</script>'
    footer = f"<footer><p>&copy; 2024 {prose(r, 50)}</p></footer>"
    top = f'<header><div class="logo">{prose(r, 2)}</div><p>{prose(r, 40)}</p></header>'
    frame = r.choice(('<article class="post">{}</article>', '<main id="content">{}</main>', '<div role="main">{}</div>', '<div class="story">{}</div>'))
    inner = body + (comments if r.random() < 0.5 else "")
    parts = [top, f"<nav>{menu}</nav>" if r.random() < 0.5 else f'<div class="site-menu">{menu}</div>', notice, advert, frame.format(inner), form, aside, comments, footer]
    return f"<!DOCTYPE html><html><head><title>{head}</title><style>p > b {{}}</style></head><body class='has-sidebar'>{''.join(parts)}</body></html>", text


@pytest.mark.parametrize("seed", range(60))
def test_pages_of_several_makes(seed):
    source, text = page(seed)
    assert text_of(source) == text


def test_fixture_pages(spark):
    """The pages' articles, cut out by their tags."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op12_main_text"](spark, SF).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]]["html"], re.DOTALL)[1]
        expected = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert (r["text"], r["n_chars"], r["url"]) == (expected, len(expected), pages[r["page_id"]]["url"])


def test_references_white_space_and_inline_tags():
    body = "<p>A&amp;B &lt;i&gt; &#233;&#x1F600; &nbsp; caf&eacute; un<b>brok</b>en\n\t two<br>lines &amp;amp; 5 < 6 &unknown; " + "and it is of the " * 12 + "</p>"
    assert text_of(f"<article>{body}</article>") == ("A&B <i> é😀 café unbroken two lines &amp; 5 < 6 &unknown; " + "and it is of the " * 12).strip()


def test_first_pass():
    """Labels of blocks by length, stop words and links."""
    long, short = "it is of the " * 30, "it is so"
    source = f"<div><p>{long}</p><p>{short}</p><p>{'zebra ' * 40}</p><p><a href=x>{'one of the links ' * 8}</a></p></div><div><p>{'it is of the ' * 8}</p></div>"
    assert [b.label for b in classified(source, STOPS)] == ["text", "open", "boilerplate", "boilerplate", "near"]
    assert all(len(b.text) < SHORT for b in cut(f"<p>{short}</p>"))


def test_second_pass():
    """Open blocks inherit: text between text, boilerplate between boilerplate, a heading from what follows it."""
    good, bad, some = f"<p>{'it is of the ' * 30}</p>", f"<p><a href=x>{'link of links ' * 9}</a></p>", "<p>Short one.</p>"
    kept = lambda source: [b.kept for b in classified(source, STOPS)]
    assert kept(good + some + good) == [True, True, True]
    assert kept(bad + some + bad) == [False, False, False]
    assert kept(bad + some + good) == [False, False, True]
    assert kept(bad + "<h2>Heading</h2>" + good + some) == [False, True, True, True]
    assert kept(some + some) == [False, False]
    assert kept(f"<article>{some}{some}</article>") == [True, True]
    assert kept(bad + f"<article>{some}{bad}{some}</article>" + bad) == [False, True, False, True, False]


@pytest.mark.parametrize("source", ["", "   ", "<", "</", "<p", "<p class=\"x", "<!--", "<!-- a", "<script>", "<script>x", "<![CDATA[", "<?php", "<a href='>'", "a<b", "<p>&", "<>", "</>", "<div " * 50, "</div>" * 50, "&#xD800;&#0;&#1114112;", "\x00<p>\x00</p>", "<style></style", "<li><li></ul><p></li>", "<table><td>x<tr>y", "<a><a></a></b>"])
def test_broken_markup(source):
    assert isinstance(text_of(source), str)
    good = "it is of the " * 30
    assert good.strip() in text_of(f"<p>{good}</p>" + source)


def test_quotes_that_do_not_close():
    good = "it is of the " * 30
    assert text_of(f"<p title=\"a>{good}</p><p class='b'>{good}</p>").count("it is of the") >= 30
    assert text_of(f'<div data-x="1 > 0"><p>{good}</p></div>') == good.strip()


@pytest.mark.parametrize("piece", ['<a "', "<a '\">", "<div>", "</section>", "<li>", "<!--", "<script>", "<p><b>", "<div></p>", "<", "&amp", "<div hidden><a>"])
def test_long_pages_in_linear_time(piece):
    """Pages of a megabyte of one piece, whatever it is."""
    began = time.process_time()
    text_of("<section>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20


def test_hidden_and_unread():
    good = "it is of the " * 30
    source = f"<article><div hidden><p>{good}</p></div><p>{good}</p><div style='display: none'>{good}</div><noscript>{good}</noscript><svg><text>{good}</text></svg><span aria-hidden=true>x</span></article>"
    assert text_of(source) == good.strip()


def test_rows(spark):
    """Nulls, repeated rows and ids, an empty table, further columns that clash."""
    good = "it is of the " * 30
    rows = [(1, "u", None, "x", 5), (None, None, f"<p>{good}</p>", None, None), (1, "u", None, "x", 5), (3, "v", "", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, c0 int")
    got = main_text(pages)
    assert got.columns == ["page_id", "url", "c0", "text", "n_chars", "n_blocks", "n_kept"]
    assert sorted(got.collect(), key=str) == sorted([(1, "u", 5, "", 0, 0, 0), (None, None, None, good.strip(), len(good.strip()), 1, 1), (1, "u", 5, "", 0, 0, 0), (3, "v", 1, "", 0, 0, 0)], key=str)
    assert page_blocks(pages).select("page_id", "block", "label", "kept").collect() == [(None, 0, "text", True)]
    assert main_text(pages.limit(0)).count() == page_blocks(pages.limit(0)).count() == 0
    assert len(main_text(spark.createDataFrame([("<p>" + "it is of the text " * 300_000,)], "html string")).first()["text"]) > 5_000_000
