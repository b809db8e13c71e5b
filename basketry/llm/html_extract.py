"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by what they
are made of: the share of stop words, the length, the share of text inside links, and what
they stand in (an article, or a menu, footer, sidebar, form, notice, advert or comment, by
tag, role, class or id). Short blocks that these rules cannot tell are ambiguous; in the
second pass they inherit the label of the nearest decided block, one in the same surroundings
first, and a heading looks ahead before it looks back. The whole page is read, once, in the
order of its tags, in time linear in its length. Markup that is broken or not closed ends at the
next tag, a script or frame without an end tag at the next block; self-closed ones hold nothing.
As in browsers a comment that is not closed holds the rest of the page.
Tag names count whole, so a custom element is no element of its first part. A head may stay
open: what it holds beside scripts, styles and the title is no text or, as in browsers, the
body's. On a page of a language without known stop words length and links decide.
What a page is wrapped in says little: a form that holds most of the running text is no form, and
where nothing is left of a page, the outermost named parts that hold most of it count by their text.
An end tag is looked for among the ``DEEP`` innermost open tags; beyond them it closes nothing, so
what follows keeps the surroundings of the deepest open tag.

Defined cases: a null or empty page has an empty text; a page without a decided block keeps
its ambiguous ones; repeated rows, null or repeated page_ids give a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from basketry.llm.workspace import map_rows

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could do for from had has have he her his how
    i if in into is it its just like more my no not of on one or other our out over she so some than that the their them
    then there these they this to up was we were what when which who will with would you your
    als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit
    nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur
    au aux avec ce cette dans de du elle en est et il je la le les leur lui mais ne nous ou par pas plus pour que qui sa se
    ses son sont sur un une vous
    al como con del el ella entre esta este fue ha hay las lo los me muy o para pero por sin sobre su sus también una y ya""".split()
)
#: Tags that start and end a block, whose whole content goes, and that hold no article.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
    thead tr ul""".split()
)
RAW_TAGS = frozenset("script style noscript template textarea select svg annotation annotation-xml iframe object canvas audio video".split())
#: The same, but their end tag is not waited for beyond the next one of their kind.
OPEN_TAGS = frozenset(("title", "button"))
POOR_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
POOR_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
POOR_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup
    promo promoted recommended related reply replies respond search share sharing sidebar sidebars signup social sponsor
    sponsored subscribe subscription teaser toolbar widget widgets""".split()
)
#: Words that say nothing of what a named part of a page holds. A name speaks against its text only if all its words do, or these.
PLAIN_NAMES = frozenset(
    """area articles aria bar block body bottom box btn button card cards col column container content desktop entries entry fixed form
    global group head header holder icon icons inline inner input item items js label layout left link links list mobile module
    news outer overlay page panel popular post posts primary region right row secondary section site slot slots sticky stories
    text thread title top unit wrap wrapper zone""".split()
)
GOOD_TAGS = frozenset(("article", "main"))
#: Names of what readers write, however much of a page that is.
READERS = frozenset("comment comments disqus reply replies respond".split())

LONG, SHORT = 140, 70  # characters
DEEP = 512  # open tags that an end tag is looked for among: as deep as browsers nest, and no page costs its square
MANY_STOP_WORDS, FEW_STOP_WORDS = 0.2, 0.05
MANY_LINKS = 0.5

_tag = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_attrs = re.compile(r"(?:[^<>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|))*")
_next_block = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})(?=[\s/>])", re.I)
_names = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_parts = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_rights = re.compile(r"©|\(c\)\s|copyright\s*(?:©|\(c\)|\d{4})", re.I)
_void = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An open block-level tag: what it stands in, and how much running text it holds."""

    __slots__ = ("tag", "bad", "main", "up", "chars", "poor", "good")

    def __init__(self, tag: str, bad: str, main: bool, up: Node | None):
        self.tag, self.bad, self.main, self.up, self.chars = tag, bad, main, up, 0
        self.poor = self.good = False


@dataclass
class Block:
    tag: str
    node: Node
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    label: bool | None = None

    @property
    def poor(self) -> bool:
        return self.node.poor

    @property
    def good(self) -> bool:
        return self.node.good


def _surroundings(tag: str, attrs: str) -> tuple[str, bool]:
    """What speaks against a tag's text (``sure``, ``form`` or ``name``, else nothing), and whether it is marked as main text."""
    named, roles = set(), set()
    for kind, value in _names.findall(attrs):
        value = value.strip("\"'")
        if kind.lower() == "role":
            roles.add(value.lower())
        else:
            for name in value.split():
                words = {"comment" if p.lower().startswith("comment") else p.lower() for p in _parts.findall(name)}
                if words & POOR_NAMES and words <= POOR_NAMES | PLAIN_NAMES:
                    named |= words
    main = tag in GOOD_TAGS or "main" in roles
    if tag in POOR_TAGS - {"form"} or roles & POOR_ROLES - {"form"}:
        return "sure", main
    by_name = bool(named & POOR_NAMES) and tag not in ("html", "body", "article", "main")
    if by_name and named & READERS:
        return "sure", main
    return "form" if tag == "form" or "form" in roles else "name" if by_name else "", main


def settle(nodes: list[Node]) -> None:
    """``poor`` and ``good`` of nodes that come after what they stand in."""
    for n in nodes:
        poor, good = (n.up.poor, n.up.good) if n.up else (False, False)
        n.poor = poor or bool(n.bad) or (n.tag == "header" and not good)
        n.good = good or n.main and not n.poor


class Scanner:
    """The tags of a page in order: where each begins and ends, its name, whether it closes, its attributes."""

    def __init__(self, page: str):
        self.page, self.low = page, page.lower()
        if len(self.low) != len(page):  # a letter whose lower case is longer
            self.low = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
        self.block = -1
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Place of ``what`` from ``at`` on, or -1; what is missing once is missing further on."""
        if what in self.missing:
            return -1
        found = self.low.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def next_block(self, at: int) -> int:
        if self.block < at:
            m = _next_block.search(self.page, at)
            self.block = m.start() if m else len(self.page)
        return self.block

    def end_of(self, name: str, at: int) -> int:
        """Where the content of a tag without text of its own ends, its end tag included."""
        stop = self.find(f"</{name}", at)
        while stop >= 0 and self.low[stop + 2 + len(name) : stop + 3 + len(name)].strip(" \t\r\n\f/>"):
            stop = self.find(f"</{name}", stop + 2)
        again = self.find(f"<{name}", at) if name in OPEN_TAGS else -1
        if stop < 0 or 0 <= again < stop:
            return self.next_block(at)
        close = self.find(">", stop)
        return close + 1 if close >= 0 else len(self.page)

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            m = _tag.match(page, start)
            if not m:
                at = start + 1
                if page.startswith("<!--", start):
                    stop = self.find("-->", start + 2)
                    at = stop + 3 if stop >= 0 else len(page)
                elif page[at : at + 1] in ("!", "?") and page[at + 1 : at + 2].strip():
                    stop = self.find(">", start)
                    at = stop + 1 if stop >= 0 else len(page)
                else:
                    continue
                yield start, at, "", False, ""
                continue
            name, close = m[1].lower(), page[start + 1] == "/"
            end = _attrs.match(page, m.end()).end()
            attrs, at = page[m.end() : end], end + page.startswith(">", end)
            if not close and (name in RAW_TAGS or name in OPEN_TAGS) and not attrs.endswith("/"):
                at = self.end_of(name, at)
                name = ""
            yield start, at, name, close, attrs


def blocks(page: str) -> tuple[list[Block], list[Node]]:
    found: list[Block] = []
    root = Node("", "", False, None)
    nodes, stack = [root], [root]
    block, links, at = Block("", root), 0, 0

    def end(tag: str) -> Block:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        if block.text:
            found.append(block)
            block.node.chars += max(0, len(block.text) - block.link_chars)
        return Block(tag, stack[-1])

    def take(text: str) -> None:
        if text:
            block.parts.append(text)
            if links:
                block.link_chars += len(text.strip())

    for start, stop, tag, close, attrs in Scanner(page).tags():
        take(page[at:start])
        at = stop
        if tag == "br":
            block.parts.append(" ")
        elif tag == "a":
            links = int(not close and "href" in attrs.lower())
        elif tag not in BLOCK_TAGS:
            continue
        elif close:
            for i in range(len(stack) - 1, max(0, len(stack) - DEEP), -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            block = end("")
        else:
            if tag in ("p", "li") and stack[-1].tag == tag:  # the end tag was left out
                stack.pop()
            if tag not in _void and not attrs.endswith("/"):
                stack.append(Node(tag, *_surroundings(tag, attrs), stack[-1]))
                nodes.append(stack[-1])
            block = end(tag)
    take(page[at:])
    end("")
    for n in reversed(nodes[1:]):
        n.up.chars += n.chars
    return found, nodes


def first_pass(b: Block, article: bool, known: bool = True) -> bool | None:
    """Main text, not, or None where the block's own make-up does not tell; stop words tell nothing if the page's language is not ``known``."""
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(1, len(words))
    share = b.link_chars / max(1, len(b.text))
    sentence = b.good and b.tag == "p" and len(b.text) >= SHORT and stops >= MANY_STOP_WORDS and b.text[-1] in ".!?"  # as a link, still the article's
    if b.poor or share > MANY_LINKS and not sentence or (article and not b.good):
        return False
    if len(b.text) < LONG and _rights.match(b.text) and not (b.good and stops >= MANY_STOP_WORDS):  # a sentence of the article may begin so
        return False
    if b.tag[:1] == "h" and b.tag[1:].isdigit():
        return None
    if b.good:
        return True if len(b.text) >= SHORT or stops >= MANY_STOP_WORDS and len(words) >= 5 else None
    if len(b.text) < SHORT:
        return None
    if stops >= MANY_STOP_WORDS:
        return True
    if len(b.text) >= LONG and share < 0.2:
        return True if not known or stops >= FEW_STOP_WORDS else None
    return None if not known or stops >= FEW_STOP_WORDS else False


def knows(found: list[Block]) -> bool:
    """Whether the page's running text holds more than next to no known stop words."""
    words = [w.strip(".,;:!?\"'()") for b in found if not b.poor and len(b.text) >= SHORT and b.link_chars <= MANY_LINKS * len(b.text) for w in b.text.lower().split()]
    return not words or sum(w in STOP_WORDS for w in words) >= FEW_STOP_WORDS * len(words)


def second_pass(found: list[Block]) -> None:
    """Ambiguous blocks inherit from the nearest decided ones; what an article only embeds (an advert) lends nothing."""
    first = [b.label for b in found]
    decided = [i for i, label in enumerate(first) if label is not None]
    before: list[dict[bool, int]] = []
    last: dict[bool, int] = {}
    for i, b in enumerate(found):
        before.append(dict(last))
        if first[i] is not None and not (b.good and b.poor):
            last[b.good] = i
    after: list[dict[bool, int]] = [{} for _ in found]
    last = {}
    for i in range(len(found) - 1, -1, -1):
        after[i] = dict(last)
        if first[i] is not None and not (found[i].good and found[i].poor):
            last[found[i].good] = i
    for i, b in enumerate(found):
        if first[i] is not None:
            continue
        if not decided:
            b.label = True
            continue
        near = [(abs(i - j), k, first[j]) for k, j in ((1, before[i].get(b.good)), (0 if b.tag[:1] == "h" else 2, after[i].get(b.good))) if j is not None]
        heading = [n for n in near if n[1] == 0]
        b.label = (heading or sorted(near))[0][2] if near else b.good


def judge(found: list[Block]) -> None:
    """Both passes over a page's blocks."""
    kept = sum(len(b.text) for b in found if b.good and not b.poor)
    article = kept > 0 and 4 * kept >= sum(len(b.text) for b in found if not b.poor)
    known = knows(found)
    for b in found:
        b.label = first_pass(b, article, known)
    second_pass(found)


def main_text(page: str | None) -> str:
    found, nodes = blocks(page or "")
    wide = [n for n in nodes if n.bad and 2 * n.chars > nodes[0].chars]
    for n in wide:
        if n.bad == "form":
            n.bad = ""
    settle(nodes)
    judge(found)
    if not any(b.label for b in found) and any(n.bad == "name" for n in wide):
        for n in wide:
            if n.bad == "name" and not (n.up and n.up.poor):
                n.bad = ""
        settle(nodes)
        judge(found)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page (page_id, url, html)."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        text = [main_text(p) for p in b["html"]]
        return pd.DataFrame({"url": b["url"].to_numpy(), "text": text, "n_chars": [len(t) for t in text]})

    return map_rows(pages, "page_id", ["url", "html"], lambda: run, "url string, text string, n_chars long")
