"""Pages that leave out end tags, and pages of other languages."""

from __future__ import annotations

import pytest

from basketry.llm.html_extract import main_text

LINE = "The owner of the house was not at home when we came, so that all of us had to wait for him in the garden until it was dark and the rain had stopped."
POLISH = "Nowoczesne budownictwo drewniane rozwija się szybko dzięki tanim surowcom, lecz wymaga starannego projektowania oraz regularnej konserwacji każdego elementu konstrukcji."


@pytest.mark.parametrize(
    "head",
    ["<head><title>T</title><meta charset=utf-8>", "<head><title>T</title><script>a='<p>'</script><body>", "<head><title>T<body>", "<head><title>T</title></head><body><button>Share", "<head><title>T</title></head><body><button>Share<button><div>Send</div></button>"],
)
def test_unclosed_head_title_and_button_lose_no_text(head):
    assert main_text(f"<html>{head}<article><p>{LINE}</p></article></html>") == LINE


def test_closed_buttons_go_whole():
    assert main_text(f"<button><div>{LINE}</div></button><article><p>{LINE}</p><button>Share</button></article>") == LINE


def test_a_page_of_another_language_is_not_empty():
    page = f"<html><body><nav><a href=/>Start</a> <a href=/o>O nas</a></nav><div><p>{POLISH}</p><p>{POLISH}</p></div><footer>Wszelkie prawa zastrzeżone dla właściciela strony internetowej oraz współpracowników</footer></body></html>"
    assert main_text(page) == f"{POLISH}\n{POLISH}"
