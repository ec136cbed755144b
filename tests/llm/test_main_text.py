"""Main text of pages: known articles in many kinds of page, and the pages of the tables against a plain reading."""

from __future__ import annotations

import html
import random
import re

import pytest

from lanternlog.llm import main_text
from lanternlog.llm.main_text import mark

LONG = "The quick brown fox jumps over the lazy dog and then goes on for quite a while longer than menus do."
MENU = "<nav><ul>" + "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(6)) + "</ul></nav>"
SIDE = f'<aside><h3>See also</h3><p>{LONG}</p><ul><li><a href="/x">x</a></li></ul></aside>'
COMMENTS = f'<section id="comments"><h2>2 comments</h2><article class="comment"><p>{LONG}</p></article></section>'
FOOT = "<footer>&copy; somebody &middot; <a href=/>home</a></footer>"
COOKIE = f'<div class="cookie-banner" role="alert"><p>{LONG}</p><button>OK</button></div>'
FORM = f"<form action=/s><label>Search</label><input name=q><p>{LONG}</p></form>"


def page(body: str, head: str = "<title>T</title><style>p{}</style><script>var t='</p>';</script>") -> str:
    return f'<!DOCTYPE html><html lang="en"><head>{head}</head><body>{body}</body></html>'


CASES = {
    "plain": (page(f"{MENU}<article><h1>Head</h1><p>{LONG}</p><p>Be.</p></article>{FOOT}"), ["Head", LONG, "Be."]),
    "unclosed": (f"<body>{MENU}<article><h1>A</h1><p><b>B.<br><p>{LONG}</p><p>C", ["A", "B.", LONG, "C"]),
    "all round": (
        page(f"<header><h1>Site</h1></header>{MENU}{COOKIE}{SIDE}<main><article><p>Short.</p></article></main>{FORM}{COMMENTS}{FOOT}"),
        ["Short."],
    ),
    "inside": (
        page(f'<article><h1>A</h1>{COOKIE}<p>One.</p><div class="ad">{LONG}</div><p>Two.</p>{SIDE}{FORM}{COMMENTS}{FOOT}</article>'),
        ["A", "One.", "Two."],
    ),
    "nested article is a comment": (page(f"<article><p>{LONG}</p><article><p>{LONG} Not.</p></article></article>"), [LONG]),
    "article header": (page(f"<article><header><h1>A</h1></header><p>{LONG}</p></article>"), ["A", LONG]),
    "main only": (page(f"{MENU}<main><h1>A</h1><p>{LONG}</p></main>{FOOT}"), ["A", LONG]),
    "role": (page(f'{MENU}<div role="main"><h1>A</h1><p>b</p></div><div role="contentinfo">{LONG}</div>'), ["A", "b"]),
    "whole page in a form": (page(f"<form>{MENU}<article><p>{LONG}</p></article></form>"), [LONG]),
    "menu never closed": (f"<body><nav><ul><li><a href=/>x</a><article><p>{LONG}</p></article>", [LONG]),
    "no article": (
        page(f'<div class="top"><a href=/>a</a><a href=/>b</a></div><div><h1>A</h1><p>{LONG}</p><p>Be.</p><p>{LONG}</p></div>{COMMENTS}'),
        ["A", LONG, "Be.", LONG],
    ),
    "between clusters": (page(f"<div><p>{LONG}</p></div><div><p>Be.</p></div><div><p>{LONG}</p></div>"), [LONG, "Be.", LONG]),
    "names that tell what a page has": (page(f'<div class="page with-sidebar"><p>{LONG}</p></div>'), [LONG]),
    "references": (page("<article><p>a &amp; b &lt;p&gt; &eacute; &#233; &#x1F600; &amp;amp;</p></article>"), ["a & b <p> é é 😀 &amp;"]),
    "white space": (page("<article><p>\n a\t b&nbsp;\r\n c <br> d </p>\n\n<p> </p></article>"), ["a b c d"]),
    "inline script": (page("<article><p>a<script>document.write('<p>x</p>')</script> b</p></article>"), ["a b"]),
    "comment": (page("<article><p>a<!-- <p>no</p> --> b</p><!-- ad 1 --></article>"), ["a b"]),
    "comment cut off": (f"<article><p>{LONG}</p><!-- to be", [LONG]),
    "tag cut off": (f'<article><p>{LONG}</p><p class="', [LONG]),
    "script cut off": (f"<article><p>{LONG}</p><script>var a = 1;", [LONG]),
    "odd declarations": (f"<![if !IE]><article><![foo[<p>{LONG}</p><!x></article><![CDATA[x]]>", [LONG]),
    "lists and tables": (
        page("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table><dl><dt>g<dd>h</dl></article>"),
        list("abcdefgh"),
    ),
    "stray end tags": (page("<article></div><p>a</p></p></span>b</article>"), ["a", "b"]),
    "less than": (page("<article><p>a < b and c > d</p></article>"), ["a < b and c > d"]),
    "hidden": (page('<article><p>a</p><p hidden>b</p><p style="display: none">c</p></article>'), ["a"]),
    "inline advert": (page('<article><p>a <span class="ad">b</span> c</p></article>'), ["a", "c"]),
    "no head end": ("<html><head><title>T</title><body><article><p>a</p></article>", ["a"]),
    "text alone": ("just text", ["just text"]),
    "only menus": (page(MENU + FOOT), []),
    "empty": ("", []),
    "only markup": (page("<article><p></p></article>"), []),
}


@pytest.mark.parametrize("name", CASES)
def test_article(name):
    text, want = CASES[name]
    assert main_text.main_text(text).split("\n") == (want or [""])


def test_shuffled_pages():
    """Articles of random blocks among random other parts, closed or not, come back whole."""
    rng = random.Random(7)
    word = lambda: rng.choice(["be", "of the", "naïve &", "<x>", "longer words", "été", "a" * 40, "#$%"])
    for _ in range(400):
        blocks = [" ".join(word() for _ in range(rng.choice([1, 2, 30]))) for _ in range(rng.randint(1, 12))]
        inside = ""
        for i, block in enumerate(blocks):
            tag = rng.choice(["p", "h2", "li", "div"]) if i else "h1"
            inside += rng.choice(["", "\n", "<!-- x -->", '<div class="advert">buy <b>now</b></div>'])
            text = html.escape(block).replace(" ", rng.choice([" ", "\n", " <br> ", "&#32;"]))
            inside += f"<{tag}>{rng.choice(['', '<b>'])}{text}" + ("" if tag in ("p", "li") and rng.random() < 0.5 else f"</{tag}>")
        others = [MENU, SIDE, COOKIE, FORM, COMMENTS, f'<div class="ad">{LONG}</div>', "<script>if (a<b) {}</script>"]
        before, after = rng.sample(others, 3), rng.sample(others, 3)
        text = page("".join(before) + f"<article>{inside}</article>" + "".join(after) + FOOT)
        assert main_text.main_text(text).split("\n") == [" ".join(b.split()) for b in blocks]


def test_smoothing_and_marks():
    marked = mark(page(f"{MENU}<div><p>{LONG}</p><p>{LONG}</p></div>"))
    assert marked.content.tolist() == [False] * 6 + [True] * 2
    assert marked.ratio[:6].tolist() == [0.0] * 6 and (marked.smoothed[6:] > marked.smoothed[:5].max()).all()


def test_long_page():
    """Time grows with the length: 200,000 open tags, and a long block."""
    deep = "<div><b><i>" * 70_000 + "<p>a" + "</div>" * 70_000
    assert main_text.main_text(f"<article>{deep}<p>{'b ' * 500_000}</article>") == "a\n" + "b " * 499_999 + "b"


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(main_text.extract(pages).collect(), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG)), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert main_text.extract(pages.where("false")).count() == 0
    assert [tuple(r)[:3] for r in main_text.lines(pages).collect()] == [(1, 1, LONG)]


def test_tables(spark):
    """Every page of the table, against a reading that knows how these pages are written."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    assert len(got) == pages.count()
    for row in pages.collect():
        inside = re.search(r"<article>(.*)</article>", row.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", inside)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert got[row.page_id] == "\n".join(b for b in plain if b), row.page_id
