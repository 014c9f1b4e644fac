"""Main text of web pages: flat text blocks and a decision tree.

A page is cut into flat blocks of text at its block-level tags. A block's features
are its number of words and link density and those of the blocks before and after
it, whether it and the next one are headings, whether its element's tag or role
names another part or the main part of a page, and whether its text closes an
article (a heading of comments, a copyright line). Classes and ids aren't looked
at. A decision tree (CART, Gini impurity) trained on the small labelled table below
tells article text from the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import column, pick, pieces

# Names of HTML elements and roles.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NESTED = frozenset("a article aside blockquote body dd details dialog div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header html label li main menu nav ol p search section span table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag of its own name, or else to the end of the page.
RAW = frozenset("iframe noframes noscript script style textarea title".split())
#: What these hold is no text of the page, if they are closed.
SKIPPED = frozenset("annotation annotation-xml applet audio button canvas datalist map object select svg template video".split())
FOREIGN = frozenset("foreignobject math svg".split())
#: Start tags that end an svg or math element they stand in, as in the HTML standard.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()) | frozenset("article aside figure footer header main nav section".split())
OTHER_TAGS = frozenset("aside dialog footer head menu nav search".split())
MAIN_TAGS = frozenset("article main".split())
OTHER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
MAIN_ROLES = frozenset("article main".split())
#: Headings of reader comments.
CLOSING = re.compile(
    r"(?:\d+\s+)?(?:reader )?(?:comments?|commentaires?|kommentare?|comentarios?)(?:\s*\(\d+\))?[:.!]*"
    r"|(?:leave|post|add|write) a (?:comment|reply)[:.!]*|laisser un commentaire[:.!]*|kommentar (?:schreiben|hinterlassen)[:.!]*|dejar? un comentario[:.!]*",
    re.I,
)
COPYRIGHT = re.compile(r"\s*(?:copyright\s*)?©", re.I)

#: Blocks labelled by hand: words, link density, words and link density before, words and link
#: density after, heading, next heading, other part, main part, closing; then 1 for article text.
LABELLED = """
# other parts by tag or role, short and long, at any place
1 1.0 1 1.0 1 1.0 0 0 1 0 0 0
6 1.0 0 0.0 5 1.0 0 0 1 0 0 0
2 1.0 1 1.0 14 0.0 0 0 1 -1 0 0
14 0.0 1 1.0 12 0.0 0 1 1 0 0 0
25 0.0 2 1.0 12 0.0 0 0 1 0 0 0
60 0.0 30 0.0 80 0.0 0 0 1 1 0 0
120 0.0 60 0.0 0 0.0 0 0 1 -1 0 0
12 0.1 90 0.0 0 0.0 0 0 1 0 0 0
30 0.0 80 0.0 25 0.0 0 0 1 1 0 0
4 0.0 30 0.0 20 0.0 1 0 1 1 0 0
3 0.0 10 1.0 20 0.0 1 0 1 0 0 0
200 0.0 3 0.0 0 0.0 0 0 1 0 0 0
# outside the main part of a page that has one
14 0.0 1 1.0 12 0.0 0 1 0 -1 0 0
40 0.0 80 0.0 30 0.0 0 0 0 -1 0 0
5 0.0 60 0.0 20 0.0 1 0 0 -1 0 0
9 0.0 60 0.0 0 0.0 0 0 0 -1 0 0
2 1.0 2 1.0 2 1.0 0 0 0 -1 0 0
90 0.0 3 0.0 60 0.0 0 0 0 -1 0 0
# comments, copyright lines
2 0.0 80 0.0 3 1.0 1 0 0 0 1 0
2 0.0 60 0.0 40 0.0 1 0 0 1 1 0
40 0.0 3 0.5 30 0.0 0 0 0 0 1 0
60 0.0 40 0.0 50 0.0 0 0 0 1 1 0
15 0.0 60 0.0 0 0.0 0 0 0 0 1 0
9 0.1 90 0.0 0 0.0 0 0 0 0 1 0
8 0.0 3 1.0 0 0.0 0 0 0 1 1 0
# within the main part: text, headings, short lines, links in text
10 0.0 14 0.0 100 0.0 1 0 0 1 0 1
4 0.0 0 0.0 40 0.0 1 0 0 1 0 1
2 0.0 8 0.0 2 0.0 1 0 0 1 0 1
2 0.0 2 0.0 32 0.0 0 0 0 1 0 1
100 0.0 10 0.0 60 0.0 0 0 0 1 0 1
30 0.1 60 0.0 40 0.0 0 0 0 1 0 1
12 0.0 60 0.0 3 0.0 0 1 0 1 0 1
2 0.0 60 0.0 80 0.0 0 0 0 1 0 1
1 0.0 3 0.0 12 0.1 0 0 0 1 0 1
5 0.0 60 0.0 0 0.0 0 0 0 1 0 1
3 0.0 0 0.0 0 0.0 0 0 0 1 0 1
6 0.0 12 0.0 6 0.0 0 0 0 1 0 1
8 0.5 60 0.0 70 0.0 0 0 0 1 0 1
2 1.0 60 0.0 70 0.0 0 0 0 1 0 1
7 1.0 90 0.0 60 0.0 1 0 0 1 0 1
40 0.4 60 0.0 70 0.0 0 0 0 1 0 1
9 0.0 1 1.0 60 0.0 0 0 0 1 0 1
6 0.0 1 1.0 60 0.0 1 0 0 1 0 1
25 0.0 1 1.0 2 1.0 0 0 0 1 0 1
500 0.0 10 0.0 12 0.1 0 0 0 1 0 1
20 0.0 100 0.0 10 0.0 0 0 0 1 0 1
4 0.0 150 0.0 200 0.0 0 0 0 1 0 1
7 0.0 90 0.0 30 0.0 1 0 0 1 0 1
6 0.0 60 0.0 3 1.0 0 0 0 1 0 1
15 0.0 20 0.0 6 1.0 0 0 0 1 0 1
12 0.0 1 1.0 30 0.0 0 0 0 1 0 1
# within the main part: menus, lists of links
1 1.0 0 0.0 1 1.0 0 0 0 1 0 0
1 1.0 1 1.0 1 1.0 0 0 0 1 0 0
2 1.0 1 1.0 10 0.0 0 1 0 1 0 0
2 1.0 60 0.0 2 1.0 0 0 0 1 0 0
8 0.9 60 0.0 9 0.9 0 0 0 1 0 0
8 0.9 9 0.9 0 0.0 0 0 0 1 0 0
3 1.0 3 1.0 60 0.0 0 0 0 1 0 0
1 1.0 0 0.0 60 0.0 0 0 0 1 0 0
# without any mark-up to go by: menus, lists of links
5 1.0 0 0.0 4 1.0 0 0 0 0 0 0
1 1.0 1 1.0 1 1.0 0 0 0 0 0 0
2 1.0 1 1.0 40 0.0 0 0 0 0 0 0
2 1.0 1 1.0 10 0.0 0 1 0 0 0 0
3 1.0 60 0.0 3 1.0 0 0 0 0 0 0
9 0.9 60 0.0 9 0.9 0 0 0 0 0 0
14 0.8 10 0.9 10 0.9 0 0 0 0 0 0
20 0.7 30 0.0 20 0.7 0 0 0 0 0 0
12 0.5 20 0.6 14 0.5 0 0 0 0 0 0
40 0.6 20 0.6 20 0.6 0 0 0 0 0 0
4 1.0 60 0.0 0 0.0 0 0 0 0 0 0
2 1.0 25 0.0 3 0.0 0 0 0 0 0 0
# the same: headings of such lists, lines among them, adverts and notices before the title
4 0.0 60 0.0 3 1.0 1 0 0 0 0 0
3 0.0 9 0.9 9 0.9 1 0 0 0 0 0
4 0.0 1 1.0 2 1.0 0 0 0 0 0 0
3 0.0 60 0.0 1 1.0 0 0 0 0 0 0
2 0.0 30 0.0 2 1.0 0 0 0 0 0 0
3 0.0 2 1.0 3 1.0 0 0 0 0 0 0
9 0.2 5 1.0 0 0.0 0 0 0 0 0 0
5 0.0 4 1.0 6 0.4 0 0 0 0 0 0
6 0.0 2 1.0 0 0.0 0 0 0 0 0 0
5 0.0 1 1.0 6 0.0 0 1 0 0 0 0
8 0.0 1 1.0 10 0.0 0 1 0 0 0 0
11 0.0 1 1.0 2 0.0 0 1 0 0 0 0
16 0.0 2 1.0 9 0.0 0 1 0 0 0 0
12 0.0 1 1.0 20 0.0 0 1 0 0 0 0
14 0.0 1 1.0 30 0.0 0 1 0 0 0 0
12 0.0 2 1.0 2 1.0 0 0 0 0 0 0
16 0.0 1 1.0 1 1.0 0 0 0 0 0 0
4 0.0 0 0.0 2 1.0 0 0 0 0 0 0
2 0.0 0 0.0 1 1.0 1 0 0 0 0 0
# the same: comments among names, dates and links to answer them
25 0.0 3 0.6 1 1.0 0 0 0 0 0 0
14 0.0 4 0.8 2 1.0 0 0 0 0 0 0
12 0.0 3 0.3 1 1.0 0 0 0 0 0 0
18 0.0 4 0.3 2 1.0 0 0 0 0 0 0
3 0.3 20 0.0 12 0.0 0 0 0 0 0 0
4 0.4 60 0.0 30 0.0 0 0 0 0 0 0
4 0.5 1 1.0 25 0.0 0 0 0 0 0 0
3 0.7 2 1.0 14 0.0 0 0 0 0 0 0
# the same: article text
80 0.0 5 0.0 60 0.0 0 0 0 0 0 1
60 0.0 80 0.0 40 0.0 0 0 0 0 0 1
40 0.1 60 0.0 30 0.0 0 0 0 0 0 1
25 0.0 40 0.0 25 0.0 0 0 0 0 0 1
18 0.0 50 0.0 40 0.0 0 0 0 0 0 1
12 0.0 40 0.0 50 0.0 0 0 0 0 0 1
6 0.0 60 0.0 50 0.0 0 0 0 0 0 1
3 0.0 60 0.0 70 0.0 0 0 0 0 0 1
2 0.0 45 0.0 30 0.0 0 0 0 0 0 1
1 0.0 20 0.0 6 0.0 0 0 0 0 0 1
35 0.2 2 1.0 60 0.0 0 0 0 0 0 1
50 0.0 2 1.0 3 1.0 0 0 0 0 0 1
30 0.0 6 1.0 45 0.0 0 0 0 0 0 1
22 0.0 2 1.0 22 0.0 0 0 0 0 0 1
20 0.0 2 0.0 2 0.9 0 0 0 0 0 1
19 0.0 4 0.0 1 1.0 0 0 0 0 0 1
22 0.0 60 0.0 3 1.0 0 0 0 0 0 1
10 0.0 50 0.0 2 1.0 0 0 0 0 0 1
14 0.0 30 0.0 1 1.0 0 0 0 0 0 1
150 0.0 0 0.0 0 0.0 0 0 0 0 0 1
30 0.0 0 0.0 0 0.0 0 0 0 0 0 1
30 0.0 1 1.0 9 0.0 0 1 0 0 0 1
45 0.0 2 1.0 4 0.0 0 1 0 0 0 1
30 0.0 60 0.0 5 0.0 0 1 0 0 0 1
4 0.0 60 0.0 5 0.0 0 1 0 0 0 1
20 0.0 5 0.0 3 0.0 0 1 0 0 0 1
22 0.0 1 0.0 2 0.0 0 1 0 0 0 1
14 0.0 8 0.0 5 0.0 0 1 0 0 0 1
45 0.1 1 0.0 1 0.0 0 1 0 0 0 1
23 0.0 2 0.5 1 0.0 0 1 0 0 0 1
12 0.0 5 0.0 14 0.0 0 0 0 0 0 1
2 0.0 2 0.0 32 0.0 0 0 0 0 0 1
9 0.0 9 0.0 20 0.0 0 0 0 0 0 1
17 0.0 40 0.0 15 0.0 0 0 0 0 0 1
7 0.0 30 0.0 12 0.0 0 0 0 0 0 1
3 0.0 30 0.0 15 0.0 0 0 0 0 0 1
70 0.25 60 0.1 50 0.0 0 0 0 0 0 1
40 0.0 110 0.0 2 0.0 0 0 0 0 0 1
8 0.0 80 0.0 12 0.0 0 0 0 0 0 1
1 0.0 120 0.0 9 0.0 0 0 0 0 0 1
23 0.0 75 0.0 23 0.0 0 0 0 0 0 1
2 0.0 200 0.0 1 0.0 0 0 0 0 0 1
90 0.0 150 0.0 200 0.0 0 0 0 0 0 1
15 0.0 100 0.0 5 0.0 0 0 0 0 0 1
300 0.0 90 0.0 16 0.0 0 0 0 0 0 1
6 0.0 12 0.3 45 0.0 0 0 0 0 0 1
# the same: titles and headings of article text
8 0.0 2 1.0 60 0.0 1 0 0 0 0 1
5 0.0 80 0.0 70 0.0 1 0 0 0 0 1
9 0.0 0 0.0 50 0.0 1 0 0 0 0 1
3 0.0 1 1.0 40 0.0 1 0 0 0 0 1
1 0.0 1 1.0 23 0.0 1 0 0 0 0 1
20 0.0 2 1.0 12 0.0 1 0 0 0 0 1
8 0.0 120 0.0 18 0.0 1 0 0 0 0 1
6 0.0 2 1.0 2 0.5 1 0 0 0 0 1
4 0.0 2 1.0 3 0.6 1 0 0 0 0 1
10 0.0 10 0.0 10 0.0 1 0 0 0 0 1
2 0.0 11 0.0 2 0.0 1 0 0 0 0 1
10 0.0 4 0.0 20 0.0 1 0 0 0 0 1
"""

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"(?:^|\s)(role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|$))", re.I)
#: What an element is: another part, a main part, or one that is another part only if the page's text isn't in it.
OTHER, MAIN, INNER = 1, 2, 3


def _kind(tag: str, attrs: str, inside_main: bool, inside_article: bool) -> int:
    """OTHER, MAIN, INNER or 0 for what an element's tag and role say about what it holds.

    INNER are forms, which some sites put around all, and articles within an article,
    which are comments by the HTML standard.
    """
    kind = OTHER if tag in OTHER_TAGS or (tag == "header" and not inside_main) else MAIN if tag in MAIN_TAGS else INNER if tag == "form" else 0
    if attrs and not attrs.isspace():
        for name, value in _ATTRIBUTE.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return OTHER
            if name == "role":
                kind = OTHER if value in OTHER_ROLES else MAIN if value in MAIN_ROLES else INNER if value == "form" else kind
    return INNER if kind == MAIN and tag == "article" and inside_article else kind


def _tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(begin, end, tag, whether an end tag, attributes) of each tag; comments and raw text with its tags have no name."""
    out, foreign, at, skipped = [], [], 0, False
    while match := _TOKEN.search(page, at):
        begin, at = match.span()
        tag = (match["tag"] or match["tag2"] or "").lower()
        closing, attrs = bool(match["end"] or match["end2"]), (match["attrs"] if match["tag"] else match["attrs2"]) or ""
        if tag in SKIPPED or (foreign and tag in RAW):
            skipped = True
        elif tag in RAW and not closing:
            end = _RAW_ENDS[tag].search(page, at)
            tag, at = "", end.end() if end else len(page)
        if tag in FOREIGN:
            if closing and tag in foreign:
                del foreign[len(foreign) - 1 - foreign[::-1].index(tag) :]
            elif not closing and not attrs.endswith("/") and (foreign or tag != "foreignobject"):
                foreign.append(tag)
        elif tag in BREAKOUT:
            while foreign and foreign[-1] != "foreignobject":
                foreign.pop()
        out.append((begin, at, tag, closing, attrs))
    return _unskipped(out) if skipped else out


def _unskipped(tokens: list[tuple[int, int, str, bool, str]]) -> list[tuple[int, int, str, bool, str]]:
    """The tokens with each closed element of no text as one; a skipped element that isn't closed in its parent is empty."""
    stack: list[tuple[str, int]] = []
    n_open: Counter = Counter()
    ends: dict[int, tuple[int, int]] = {}  # a start: the first token after the element, and where its text begins

    def pop() -> tuple[str, int]:
        n_open[stack[-1][0]] -= 1
        return stack.pop()

    for i, (begin, end, tag, closing, attrs) in enumerate(tokens):
        inside = n_open["svg"] + n_open["math"] > 0
        if not closing and inside and tag in BREAKOUT and next(t for t, _ in reversed(stack) if t in FOREIGN) != "foreignobject":
            while n_open["svg"] + n_open["math"] and stack[-1][0] != "foreignobject":
                t, k = pop()
                if t == "svg":
                    ends[k] = (i, begin)
        if tag in VOID or not (tag in NESTED or tag in SKIPPED or tag in FOREIGN or (inside and tag in RAW)):
            continue
        if not closing:
            if not (attrs.endswith("/") and (inside or tag in FOREIGN)):
                stack.append((tag, i))
                n_open[tag] += 1
        elif n_open[tag]:
            while True:
                t, k = pop()
                if t == tag:
                    break
            if tag in SKIPPED or tag in RAW:
                ends[k] = (i + 1, end)
    out, i = [], 0
    while i < len(tokens):
        after, end = ends.get(i, (i + 1, tokens[i][1]))
        out.append((tokens[i][0], end, *tokens[i][2:]))
        i = after
    return out


def _flat(page: str) -> tuple[list[tuple[str, int, float, int, bool, bool, int]], list[int], int]:
    """The blocks that have text: (text, words, link density, heading's level, in another part, in a main part, inner part); the inner parts' parents; the number of main parts."""
    out: list[tuple[str, int, float, int, bool, bool, int]] = []
    parents = [0]
    stack: list[tuple[str, int, int]] = []
    parts: list[str] = []
    heads: list[int] = []
    linked = other = main = links = articles = inner = n_main = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                n = len(text)
                out.append((text, text.count(" ") + 1, min(1.0, linked / n), heads[-1] if heads else 0, other > 0, main > 0, inner))
            parts.clear()
        linked = 0

    def leave(tag: str, kind: int, before: int) -> None:
        nonlocal other, main, links, articles, inner
        other -= kind == OTHER
        main -= kind == MAIN
        links -= tag == "a"
        articles -= tag == "article"
        if tag[0] == "h" and tag[1:].isdigit():
            heads.pop()
        inner = before

    at = 0
    for begin, end, tag, closing, attrs in _tokens(page):
        if begin > at:
            parts.append(page[at:begin])
            if links:
                linked += begin - at
        at = end
        if tag in BLOCKS:
            close()
        if tag in VOID or tag not in NESTED:
            continue
        if closing:
            if any(t == tag for t, *_ in reversed(stack)):
                while True:
                    t, *rest = stack.pop()
                    leave(t, *rest)
                    if t == tag:
                        break
            continue
        if tag in ("p", "li", "a", "body") and stack and (stack[-1][0] == tag or tag == "body"):
            while stack and (stack[-1][0] == tag or tag == "body"):
                leave(*stack.pop())
        kind = _kind(tag, attrs, main > 0, articles > 0)
        stack.append((tag, kind, inner))
        if kind == INNER:
            parents.append(inner)
            inner = len(parents) - 1
        n_main += kind == MAIN and main == 0
        other += kind == OTHER
        main += kind == MAIN
        links += tag == "a"
        articles += tag == "article"
        if tag[0] == "h" and tag[1:].isdigit():
            heads.append(int(tag[1:]))
    parts.append(page[at:])
    close()
    return out, parents, n_main


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, int, bool]]:
    """(text, words, link density, heading, in another part, main, closing) of each block that has text.

    main is 1 in a page's main parts and -1 outside, if they hold most of its text,
    or a twentieth of what is outside if there is one only; else it is 0 everywhere. Text is what isn't in links or other parts. An inner
    part is another part unless it holds most of the page's text.
    """
    flat, parents, n_main = _flat(page)
    plain = [0.0 if other else n * (1 - density) for _, n, density, _, other, *_ in flat]
    held = [0.0] * len(parents)
    for words, (*_, inner) in zip(plain, flat, strict=True):
        held[inner] += words
    for i in range(len(parents) - 1, 0, -1):
        held[parents[i]] += held[i]
    apart = [False] * len(parents)
    for i in range(1, len(parents)):
        apart[i] = apart[parents[i]] or 2 * held[i] <= held[0]
    within = sum(w for w, (*_, main, inner) in zip(plain, flat, strict=True) if main and not apart[inner])
    outside = sum(w for w, (*_, main, inner) in zip(plain, flat, strict=True) if not main and not apart[inner])
    mostly = (20 if n_main == 1 else 1) * within > outside
    out, closed, seen = [], 0, False
    for text, n, density, level, other, main, inner in flat:
        says = n <= 8 and density < 0.5 and CLOSING.fullmatch(text) is not None
        if level:
            closed = level if says and seen else 0 if level <= closed else closed
        seen = seen or (n >= 20 and density < 0.5)
        closing = closed > 0 or (says and seen) or (n <= 40 and COPYRIGHT.match(text) is not None)
        out.append((text, n, density, level > 0, other or apart[inner], (1 if main else -1) if mostly else 0, closing))
    return out


def features(found: list[tuple[str, int, float, bool, bool, int, bool]]) -> np.ndarray:
    """A row for each block, in the columns of LABELLED; before the first block and after the last one are none of 0 words."""
    if not found:
        return np.empty((0, 11))
    own = np.array([f[1:3] for f in found], dtype=float)
    edge, heading = np.zeros((1, 2)), np.array([[f[3]] for f in found], dtype=float)
    marks = np.array([f[4:] for f in found], dtype=float)
    return np.hstack((own, np.vstack((edge, own[:-1])), np.vstack((own[1:], edge)), heading, np.vstack((heading[1:], edge[:, :1])), marks))


def grow(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 8) -> tuple:
    """A tree as nested (feature, threshold, at most, above), with labels as leaves."""
    label = int(2 * y.sum() >= len(y))
    if depth == 0 or y.min() == y.max():
        return (label,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            if least <= left.sum() <= len(y) - least:
                impurity = sum(n * p * (1 - p) for n, p in ((left.sum(), y[left].mean()), ((~left).sum(), y[~left].mean())))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut), left)
    if best is None:
        return (label,)
    _, f, cut, left = best
    return (f, cut, grow(x[left], y[left], least, depth - 1), grow(x[~left], y[~left], least, depth - 1))


@cache
def tree() -> tuple:
    table = np.array([row.split() for row in LABELLED.strip().splitlines() if row[0] != "#"], dtype=float)
    return grow(table[:, :-1], table[:, -1])


def classify(x: np.ndarray, node: tuple | None = None) -> np.ndarray:
    node = tree() if node is None else node
    if len(node) == 1:
        return np.full(len(x), node[0] == 1)
    f, cut, low, high = node
    left = x[:, f] <= cut
    out = np.empty(len(x), dtype=bool)
    out[left], out[~left] = classify(x[left], low), classify(x[~left], high)
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return " ".join(b[0] for b, keep in zip(found, classify(features(found)), strict=True) if keep)


def _extract(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pages in pieces(batches, "html"):
            text = [main_text(p.decode("utf-8", "replace")) for p in pages]
            yield pa.RecordBatch.from_arrays([*(column(rows, n) for n in names), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*names, "text", "n_chars"])

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns to keep of pages(html string), and text and n_chars of the main text.

    A null or empty page, and one without article text, has an empty text. Pages
    need not be well-formed, and may be of any length; repeated rows give repeated
    results, an empty table none. Other columns, whatever their names, aren't looked at.
    """
    pages = pick(pages, *keep, "html")
    schema = ", ".join(f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in keep)
    return pages.mapInArrow(_extract(list(keep)), f"{schema}, text string, n_chars long")
