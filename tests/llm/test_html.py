"""HTML extraction against labelled pages and a slow version that works block by block."""

import html.parser
import re
from collections import Counter

import duckdb
import pytest

from relcheck.llm import op04_html_extraction as op04

DIR = "/root/testdata/sf0.01"
TEXT = "Much was written on this in the last year, and some of it was read by those who ought to have read it."
SHORT = "A shorter text that some reader left here on a rainy day"


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site for many purposes that you may like to read about</p></div><article><h1>Head &amp; line</h1>
    <p>First <b>bo</b>ld&nbsp;para&#8230; <script>var x = "</p>";</script>with text<p>Second<br>line</article><aside class="sidebar">More to read in the side bar of this very page</aside>
    <section id="comments"><p>A reader's comment that is long enough to look like text of an article, or nearly so</p></section><form><label>Name</label></form><footer>&copy; us</footer>"""
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<p>" + "word " * 30), (4, None, "<<>><p>" + "word " * 30), (5, "u", "<!-- " * 50)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in op04.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    long = ("word " * 30).strip()
    assert got[0] == (1, "Head & line First bold para… with text Second line", 50)
    assert got[1:3] == [(2, "", 0), (3, "", 0)] and got[4] == (4, long, len(long)) and got[5] == (5, "", 0)


def test_html_skips_no_more_than_the_element():
    rest = {
        '<p>a</p><video-js id="x"></video-js><p>rest</p>': "a rest",
        "<map-view><p>a</p></map-view><button-group><p>rest</p></button-group>": "a rest",
        '<p>a</p><svg class="i" /><p>rest</p>': "a rest",
        "<p>a</p><svg><title/><path><p>rest</p>": "a rest",
        "<svg><style>p{}</style><text>no</text></svg><p>a <svg><a><text>no</text></a></svg>rest</p>": "a rest",
        "<svg><foreignObject><p>no</p></foreignObject></svg><p>rest</p>": "rest",
        "<p>x <math><mi>a</mi><mo>+</mo><mi>b</mi></math> y</p>": "x a+b y",
        "<p>a<title>no</title ><p>b<script>'<p>no'</scripty>no</script>c<style>no": "a bc",
        "<p>a<select><option>no</select><button><p>no</button> b</p>": "a b",
    }
    for tag in ("applet", "audio", "button", "canvas", "datalist", "map", "object", "select", "template", "video"):
        rest |= {f"<p>a</p><{tag}><p>rest</p>": "a rest", f"<p>a</p><div><{tag}></div><p>rest</p><{tag}>no</{tag}><p>end</p>": "a rest end", f"<p>a</p><{tag}><p>rest</p><{tag}>no</{tag}>": "a rest"}
    for page, text in rest.items():
        assert " ".join(b[0] for b in op04.blocks(page)) == text, page


def test_html_odd_tables(spark):
    long = TEXT + " word" * 300_000
    rows = [(1, "u", f"<p>{long}</p>", "x", 1), (1, "u", f"<p>{long}</p>", "x", 1), (None, None, "<p>" + TEXT, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in op04.extract(table).collect()), key=repr)
    assert got == [(1, "u", long, len(long)), (1, "u", long, len(long)), (None, None, TEXT, len(TEXT))]
    assert op04.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["page has-sidebar", "post comments-open", "no-menu", "trending-story", "sidebar", "comments", "category-social", "ad-free"])
def test_html_names_say_nothing(name):
    for tag in ("div", "section", "body"):
        assert op04.main_text(f'<{tag} class="{name}" id="{name}"><p>{TEXT}</p><p>{TEXT}</p></{tag}>') == f"{TEXT} {TEXT}"
    assert op04.main_text(f'<article><h2 id="{name}">Head</h2><p>{TEXT}</p><section id="{name}"><p>{SHORT}</p></section></article>') == f"Head {TEXT} {SHORT}"


def test_html_parts():
    assert op04.main_text(f'<form id="aspnetForm"><ul><li><a>Home</a><li><a>News</a></ul><h1>Head</h1><p>{TEXT}</p><form><label>Name</label></form></form>') == f"Head {TEXT}"
    assert op04.main_text(f"<main><ul><li><a>Home</a><li><a>News</a><li><a>Sport</a></ul><h1>Head</h1><p>{TEXT}</p><p>Yes.</p><p>{TEXT}</p></main><p>{TEXT}</p>") == f"Head {TEXT} Yes. {TEXT}"
    for part in ("nav", "aside", "footer", "dialog", 'div role="banner"', "div hidden", 'div style="display: none"', 'div aria-hidden="true"'):
        assert op04.main_text(f"<div><{part}><p>{TEXT}</p></{part.split()[0]}><h1>Head</h1><p>{TEXT}</p></div>") == f"Head {TEXT}", part
    # An article in an article is a comment; teasers in a side bar are no main part.
    assert op04.main_text(f"<article><p>{TEXT}</p><p>{TEXT}</p><article><p>{SHORT}</p></article></article>") == f"{TEXT} {TEXT}"
    assert op04.main_text(f"<div><article><h3>One</h3></article><article><h3>Two</h3></article></div><div><p>{TEXT}</p><p>{TEXT}</p></div>").endswith(f"{TEXT} {TEXT}")
    # Comments, by their heading; a heading of as high a rank ends them.
    assert op04.main_text(f"<div><h1>Head</h1><p>{TEXT}</p><h2>2 Comments</h2><h4>Ann</h4><p>{TEXT}</p><p>{SHORT}</p></div><p>© us, all rights reserved</p>") == f"Head {TEXT}"
    assert op04.main_text(f"<div><h1>Head</h1><h2>Comments</h2><p>{TEXT}</p></div>") == f"Head Comments {TEXT}"
    assert op04.main_text(f"<div><h1>Head</h1><p>{TEXT}</p><h2>Comments</h2><p>{SHORT}</p><h2>Then</h2><p>{TEXT}</p></div>") == f"Head {TEXT} Then {TEXT}"


PAGES = {
    "news": ("<div id=top><a href=/>Daily</a> <a href=/login>Sign in</a></div><div><ul><li><a>World</a><li><a>Sport</a><li><a>Arts</a></ul></div><div><span>Sponsored: buy two get one</span></div><div><h2>{h}</h2><p>{a}</p><div>{b}</div><p>So.</p><p>{a} <a>More of this</a> {b}</p></div><div><h3>Related</h3><ul><li><a>Another story of the day</a><li><a>One more of them</a></ul></div><div>© Daily</div>", "{h} {a} {b} So. {a} More of this {b}"),
    "table": ("<table><tr><td><a>Home</a></td><td><a>About us</a></td></tr><tr><td><h1>{h}</h1>{a}<br>{b}<br><br>Yes.<br>{a}</td></tr><tr><td><a>Contact</a> | <a>Imprint</a></td></tr></table>", "{h} {a} {b} Yes. {a}"),
    "blog": ("<header><h1><a>My blog</a></h1></header><div><h1>{h}</h1><div>By <a>Ann</a></div><p>{a}</p><h2>Then</h2><p>{b}</p><ul><li>{a}<li>Short one<li>{b}</ul><div><a>Share</a> <a>Print</a></div></div><div><h2>Leave a reply</h2><p>{a}</p><form><label>Name</label></form></div>", "{h} {a} Then {b} {a} Short one {b}"),
    "forum": ("<div><a>Forum</a> <a>Rules</a> <a>Search</a></div><div><h1>{h}</h1><p>{a}</p><p>{b}</p></div><div><a>ann</a> 3 May</div><div>{s}</div><div><a>Reply</a></div><div><a>bob</a> 4 May</div><div>{s}</div><div><a>Reply</a></div>", "{h} {a} {b}"),
}


def labelled():
    """(page, its text) of hand-made layouts without a main part, a class or an id that says which is which."""
    parts = {"h": "A head of some words", "a": TEXT, "b": "The second of the two paragraphs is a bit shorter than the first of them is, but not by much.", "s": SHORT}
    return [(page.format(**parts), text.format(**parts)) for page, text in PAGES.values()]


def given(strip=()):
    """(page, its text) of the given pages, with some of their tags made div, and classes and ids taken off."""
    for (page,) in duckdb.sql(f"select html from '{DIR}/pages.parquet'").fetchall():
        text = " ".join(b[0] for b in op04.blocks(page[page.index("<article>") : page.index("</article>")]))
        if strip:
            page = re.sub(rf"<(/?)(?:{'|'.join(strip)})\b", r"<\1div", re.sub(r'\s(?:class|id)="[^"]*"', "", page))
        yield page, text


def scores(pages):
    """Precision and recall of words."""
    both = found = wanted = 0
    for page, text in pages:
        got, want = Counter(op04.main_text(page).split()), Counter(text.split())
        both, found, wanted = both + (got & want).total(), found + got.total(), wanted + want.total()
    return both / found, both / wanted


def test_html_scores():
    assert scores(given()) == (1, 1)
    precision, recall = scores(given(("article", "main")))
    assert precision > 0.999 and recall > 0.999
    precision, recall = scores(given(("article", "main", "nav", "footer")))
    assert precision > 0.99 and recall > 0.99
    precision, recall = scores(labelled())
    assert precision > 0.95 and recall > 0.95


class Slow(html.parser.HTMLParser):
    """Blocks of well-formed pages, by the standard library's parser; features and the tree for one block at a time."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.stack, self.found, self.raw, self.linked, self.parts = [], [], "", 0, 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join(html.unescape(self.raw).split())
        if text:
            tags = [t for t, _ in self.stack]
            main = [i for i, t in enumerate(tags) if t in ("article", "main")]
            other = any(t in op04.OTHER_TAGS or (t == "header" and not (main and main[0] < i)) for i, t in enumerate(tags))
            level = next((int(t[1]) for t in reversed(tags) if re.fullmatch("h[1-6]", t)), 0)
            inner = [n for t, n in self.stack if t == "form" or (t == "article" and tags.count("article") > 1 and [m for u, m in self.stack if u == "article"][0] != n)]
            self.found.append([text, len(text.split()), min(1, self.linked / len(text)), level, other, bool(main), inner])
        self.raw, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in op04.BLOCKS:
            self.end()
        if tag in op04.VOID or tag not in op04.NESTED | op04.RAW:
            return
        if tag in ("p", "li", "a") and self.stack and self.stack[-1][0] == tag:
            self.stack.pop()
        self.parts += tag in ("article", "main") and not any(t in ("article", "main") for t, _ in self.stack)
        self.stack.append((tag, object()))

    def handle_endtag(self, tag):
        if tag in op04.BLOCKS:
            self.end()
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def add(self, text):
        if not any(t in op04.RAW for t, _ in self.stack):
            self.raw += text
            self.linked += len(text) * any(t == "a" for t, _ in self.stack)

    handle_data = add

    def handle_entityref(self, name):
        self.add(f"&{name};")

    def handle_charref(self, name):
        self.add(f"&#{name};")

    def text(self):
        def plain(keep):
            return sum(n * (1 - d) for _, n, d, _, other, main, inner in self.found if not other and keep(main, inner))

        def other(b):
            return b[4] or any(2 * plain(lambda _, inner: part in inner) <= plain(lambda *_: True) for part in b[6])  # noqa: B023

        there = lambda inner: not any(2 * plain(lambda _, i: part in i) <= plain(lambda *_: True) for part in inner)  # noqa: B023, E731
        mostly = (20 if self.parts == 1 else 1) * plain(lambda main, inner: main and there(inner)) > plain(lambda main, inner: not main and there(inner))
        out, closed, seen = [], 0, False
        for i, b in enumerate(self.found):
            says = b[1] <= 8 and b[2] < 0.5 and bool(op04.CLOSING.fullmatch(b[0]))
            if b[3] and says and seen:
                closed = b[3]
            elif b[3] and b[3] <= closed:
                closed = 0
            seen = seen or (b[1] >= 20 and b[2] < 0.5)
            closing = closed > 0 or (says and seen) or (b[1] <= 40 and bool(op04.COPYRIGHT.match(b[0])))
            before = self.found[i - 1] if i else [0] * 4
            after = self.found[i + 1] if i + 1 < len(self.found) else [0] * 4
            row = [b[1], b[2], before[1], before[2], after[1], after[2], b[3] > 0, after[3] > 0, other(b), (1 if b[5] else -1) if mostly else 0, closing]
            node = op04.tree()
            while len(node) > 1:
                node = node[2] if row[node[0]] <= node[1] else node[3]
            if node[0]:
                out.append(b[0])
        return " ".join(out)


def test_html_slow_version():
    pages = [p for p, _ in labelled()] + [p for i, (p, _) in enumerate(given()) if i % 5 == 0]
    pages += [p for i, (p, _) in enumerate(given(("article", "nav"))) if i % 5 == 0]
    pages += [f"<form><h1>Head</h1><p>{TEXT}</p></form>", f"<article><p>{TEXT}</p><article><p>{SHORT}</p></article><form><p>{SHORT}</p></form></article>"]
    for page in pages:
        assert op04.main_text(page) == Slow(page).text()


def test_html_tree_is_cart():
    table = [[float(x) for x in row.split()] for row in op04.LABELLED.strip().splitlines() if row[0] != "#"]

    def impurity(rows):
        p = sum(r[-1] for r in rows) / len(rows)
        return len(rows) * p * (1 - p)

    def check(node, rows):
        if len(node) == 1:
            assert node[0] == int(2 * sum(r[-1] for r in rows) >= len(rows))
            return
        best = min(impurity([r for r in rows if r[f] <= v]) + impurity([r for r in rows if r[f] > v]) for f in range(11) for v in sorted({r[f] for r in rows})[:-1])
        low, high = [r for r in rows if r[node[0]] <= node[1]], [r for r in rows if r[node[0]] > node[1]]
        assert abs(impurity(low) + impurity(high) - best) < 1e-9
        check(node[2], low)
        check(node[3], high)

    check(op04.tree(), table)
    assert all(op04.classify(op04.np.array([r[:-1]]))[0] == bool(r[-1]) for r in table)
