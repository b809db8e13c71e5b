"""Pages whose wrappers, not their parts, look like forms, menus or readers' comments."""

from __future__ import annotations

import pytest

from basketry.llm.html_extract import main_text

A = "The first paragraph of the story says what has happened to the town and who was there when it did, and it is long enough to count."
B = "The second one tells that it was not for the first time, and that those who have lived in the town know how it came to be so."
NAV = '<nav><a href="/">Home</a> <a href="/b">News</a></nav>'
TEXT = f"{A}\n{B}"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><form id="aspnetForm" action="/x">{NAV}<div><p>{A}</p><p>{B}</p></div><footer>All rights of the site are with us and with no one else.</footer></form></body>',
        f'<body>{NAV}<div class="search-page"><p>{A}</p><p>{B}</p></div></body>',
        f'<body><div class="page-sidebar-right">{NAV}<p>{A}</p><p>{B}</p></div></body>',
        f'<body><article><p>{A}</p><p><a href="/b">{B}</a></p></article></body>',
        f'<body><article><p>{A}</p><p>{B}</p></article><ol class="commentlist"><li>{A} I do not think that this is so, as I have been there.</li></ol></body>',
        f'<body><div><p>{A}</p><p>{B}</p></div><ol class="commentlist">' + f"<li>{A} I do not think so, as I was there.</li>" * 9 + "</ol></body>",
        f'<body><div><p>{A}</p><p>{B}</p></div><form><p>Your name</p><input><p>The mail that we do not show to the others on this page</p></form></body>',
    ],
)
def test_wrappers(page):
    assert main_text(page) == TEXT


def test_formulas_are_text():
    page = f"<article><p>{A} It is <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.</p><p>{B}</p></article>"
    assert main_text(page) == f"{A} It is x=2.\n{B}"


def test_an_open_comment_holds_the_rest():
    assert main_text(f"<article><p>{A}</p><!-- <p>{B}</p></article>") == A
