"""Markup that scanners trip over, hostile pages, and pages generated around a known article."""

from __future__ import annotations

import html
import random
import time

import pytest

from basketry.llm import html_extract
from basketry.llm.html_extract import main_text

LINE = "The owner of the house was not at home when we came, so that all of us had to wait for him in the garden until it was dark and the rain had stopped."


@pytest.mark.parametrize(
    "page",
    [
        "<svg width=1 /><iframe src=x />{}",
        "<svg><path d='M0 0'></svg>{}",
        "<head><title>T</title>{}",
        "<video-player><button-x>{}</button-x></video-player>",
        '<div class="search-results">{}</div>',
        '<div class="social-history">{}</div>',
        "<script>var a = '<p>no</p>'</script>{}",
        "<script>if (a < b) c()</script >{}<script>",
        "<iframe src=x>{}",
        "<noscript>{}",
        '<p class=x">{}',
        "<a name=top>{}",
        "<title>a title<title>another</title>{}",
        "<!-- a > b --><!doctype html>{}",
        "<script></scripty></script>{}",
        "<SVG/><Style>p {{}}</STYLE>{}",
    ],
)
def test_no_article_is_lost(page):
    for inner in (f"<p>{LINE}</p>", f"<article><p>{LINE}</p></article>"):
        assert main_text(page.format(inner)) == LINE


def test_stray_angle_brackets_are_text():
    assert main_text(f"<article><p>{LINE} a <! b and a </ c, a < b, {LINE}</p></article>") == f"{LINE} a <! b and a </ c, a < b, {LINE}"


def test_sentences_about_rights_stay_and_notices_go():
    said = "Copyright 2020 was the year in which all of it had to be agreed by us."
    assert main_text(f"<article><p>{LINE}</p><p>{said}</p><p>© 2020 Example Inc.</p></article><footer>Copyright 2020 Example</footer>") == f"{LINE}\n{said}"


@pytest.mark.parametrize("name", ["ad", "ad-banner", "adBox", "comments", "comment-list", "cookie_notice", "sidebar-right", "newsletter-signup", "related posts", "social-share"])
def test_named_parts_go(name):
    assert main_text(f'<div class="{name}"><p>{LINE} And more.</p></div><article><p>{LINE}</p></article>') == LINE


@pytest.mark.parametrize("part", ["<script ", "<svg>", '<p a="', "<button>", "</div><div>", "<p>", "<div></p>", "<title>", "<!--", "<a b='", "</ ", "<!x", "<script></scripty", "<a href=x>", "&amp;", "İ<svg>"])
def test_time_is_linear_in_the_page(part):
    start = time.process_time()
    main_text(part * 20_000)
    assert time.process_time() - start < 5


def generated(r: random.Random) -> tuple[str, str]:
    """A page and its main text: an article of known blocks, written in many ways, among parts that are not."""
    word = lambda: r.choice("the of and to in was it that with for his house garden river stone & < > é 漢 \" ' ©x".split())
    line = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    write = lambda t: r.choice([html.escape(t), html.escape(t).replace("é", "&eacute;").replace(" ", r.choice([" ", "\n\t", "&nbsp;", "<br>", " <b> </b>"]), 1)])
    want, body = [], []
    for _ in range(r.randint(1, 6)):
        t = line(40, 120)
        want.append(t)
        body.append(r.choice([f"<p>{write(t)}</p>", f"<P CLASS='lead'>{write(t)}", f"<div><p>{write(t)}</p></div>", f"<blockquote>{write(t)}</blockquote>", f"<pre>{write(t)}</pre>"]))
        if r.random() < 0.4:
            body.append(r.choice(["<script>let a = '<p>x</p>'</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", "<svg/>", f"<aside><p>{line(40, 60)}</p></aside>", f'<div class="ad">{line(40, 60)}</div>', f"<form><label>{line(40, 60)}</label><input></form>"]))
    menu = "".join(f"<li><a href='/{k}'>{word()}</a>" for k in range(r.randint(1, 9)))
    top = r.choice(["", f"<nav><ul>{menu}</ul></nav>", f"<header><h1>Site</h1><ul>{menu}</ul></header>", f"<div role='navigation'>{line(40, 60)}</div>"])
    end = r.choice(["", f"<footer>{line(40, 60)}</footer>", f"<section id='comments'><p>{line(40, 60)}</p></section>", f"<div class='cookie-notice'><p>{line(40, 60)}</p></div>"])
    tag = r.choice(["article", "main"])
    return f"<html><head><title>{word()}</title>{r.choice(['</head>', ''])}<body>{top}<{tag}>{''.join(body)}</{tag}>{end}", "\n".join(want)


def test_generated_pages_give_their_article():
    r = random.Random(4)
    for _ in range(400):
        page, want = generated(r)
        assert main_text(page) == want, page


def test_tables_of_pages(spark):
    """Empty table, repeated rows, null and repeated ids, a very long page, columns of the operator's own names."""
    long = f"<article>{f'<p>{LINE}</p>' * 20_000}</article>"
    rows = [(1, "u", f"<p>{LINE}</p>", "own"), (1, "u", f"<p>{LINE}</p>", "own"), (None, None, None, None), (2, "v", long, "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "text as n_chars", "text as _key")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", LINE, len(LINE))] * 2 + [(None, None, "", 0), (2, "v", "\n".join([LINE] * 20_000), 20_000 * (len(LINE) + 1) - 1)], key=str)
    assert html_extract.extract(df.limit(0)).count() == 0
