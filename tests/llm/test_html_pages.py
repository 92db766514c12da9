"""Main text of pages that leave out end tags, name classes oddly or mix furniture into an article."""

from __future__ import annotations

import pytest

from sievelight.llm import html_text

WORDS = "The real text of the page is here and goes on for a while."
BODY = f"<p>{WORDS}</p><p>And it goes on for long, as texts do.</p>"
WANT = f"{WORDS}\nAnd it goes on for long, as texts do."


@pytest.mark.parametrize(
    "page",
    [
        f"<table><tr><td class=nav><a href=/>Home</a> Words of a menu<td>{BODY}</table>",
        f"<div class='content with-sidebar'>{BODY}</div>",
        f"<div class='share-price'>{BODY}</div>",
        f"<div id=content><p class='cookie-notice'>We use cookies here</p>{BODY}</div>",
        f"<article>{BODY}<p class=advert>Buy this thing now</article>",
        f"<body><header><h1>My Site of many words</h1></header>{BODY}</body>",
        f"<body><div class='top-nav-bar'>Home and away</div>{BODY}<div id='ad-slot-3'>Buy now</div></body>",
        f"<article>{BODY.replace('<p>And', '<p class=lead><span class=ad>Click <span>here</span> now</span>And')}</article>",
        f"<ul class=menu><li>One thing<li>Other thing</ul>{BODY}<button>Press",
        f"<head><title>T</title><div>{BODY}</div>",
        f"<div class='no-comments'>{BODY}</div><div class=comments><p>I like this text a lot, thanks</p></div>",
        f"<div>{BODY}</div><p hidden>Not shown at all",
    ],
)
def test_page(page):
    assert html_text.main_text(page) == WANT


def test_region_decides():
    """Text beside the greatest region is left out without any name of furniture, and a header of an article is in."""
    links = "<p>" + "<a href=/x>See that other page</a><br><a href=/y>and this one</a><br>" * 12 + "</p>"
    assert html_text.main_text(f"<p>Some words</p>{links}{BODY}{links}<p>Few words</p>") == WANT
    assert html_text.main_text(f"<article><header><h1>Title of it</h1></header>{BODY}</article>") == "Title of it\n" + WANT


def test_broken_tags():
    assert html_text.main_text(f'<p class="x>{WORDS}') == WORDS
    assert html_text.main_text("one two a<b then c>d three four") == "one two ad three four"
    long = "word " * 1_000_000
    assert html_text.main_text(f"<div><p>{long}</p></div>") == long.strip()


def test_columns(spark):
    pages = spark.createDataFrame([(1, "<p>one two three", "kept", "t", 5), (1, None, None, None, None)], "page_id long, body string, html string, text string, n_chars int")
    got = html_text.extract_text(pages, "body").orderBy("n_chars").collect()
    assert [(r.text, r.n_chars, r.html) for r in got] == [("", 0, None), ("one two three", 13, "kept")]
