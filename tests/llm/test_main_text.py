"""Main text of pages without article, of names made of words, of hidden parts, and against a plain version that tries all regions."""

import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from weftflow.llm import html_main

P = "<p>The harbour of the town was built by local merchants and later sold to others.</p>"
LINE = "The harbour of the town was built by local merchants and later sold to others."


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]


@pytest.fixture(scope="module")
def weights(pages):
    return html_main.learn(pages)


def test_links_in_paragraphs(weights):
    line = "<p>The <a>harbour</a> of <a>Lerwick</a> was built in <a>1815</a> by local <a>merchants</a> and later sold.</p>"
    assert html_main.extract(f"<body><div>{line * 4}</div></body>", weights) == "\n".join(["The harbour of Lerwick was built in 1815 by local merchants and later sold."] * 4)


@pytest.mark.parametrize(("page", "lines"), [
    ("".join(f"<div>this is block {i}</div>" for i in range(20)), [f"this is block {i}" for i in range(20)]),
    (P + "<ul>" + "".join(f'<li><a href="#">linked item {i}</a></li>' for i in range(6)) + "</ul>" + P, [LINE, *(f"linked item {i}" for i in range(6)), LINE]),
    ("".join(f'<div class="post"><div class="author">user {i}</div><div>some words of a post here</div></div>' for i in range(6)), [x for i in range(6) for x in (f"user {i}", "some words of a post here")]),
    ("".join(f"<section><h3>Part {i}</h3><p>Some words of a section.</p></section>" for i in range(4)), [x for i in range(4) for x in (f"Part {i}", "Some words of a section.")]),
    ("<ul><li><a>Home</a></li><li><a>About us</a></li><li><a>News</a></li></ul>" + P * 2 + "<ul><li><a>Imprint</a></li><li><a>Contact</a></li></ul>", [LINE, LINE]),
])
def test_pages_without_article(weights, page, lines):
    assert html_main.extract(f"<html><body>{page}</body></html>", weights) == "\n".join(lines)


@pytest.mark.parametrize("page", ["<nav><a>About us</a></nav><footer>Imprint</footer>", "<form><h1>Sign in</h1><label>Name</label><input><label>Password</label></form>", '<div class="menu"><a>Home</a></div>', "", "<p></p>"])
def test_pages_without_text(weights, page):
    assert html_main.extract(page, weights) == ""


@pytest.mark.parametrize(("name", "stays"), [
    *((n, False) for n in ("ad-slot", "sponsored-box", "share-buttons", "comment-list", "disqus_thread", "comment-17", "main-nav")),
    *((n, True) for n in ("layout has-sidebar", "no-comments", "with-banner", "elementor-widget elementor-widget-text-editor", "entry-header", "list-item", "wrapper")),
])
def test_names_made_of_words(weights, name, stays):
    assert ("within" in html_main.extract(f'<article>{P}<div class="{name}">words within</div>{P}</article>', weights)) is stays
    assert ("within" in html_main.extract(f'<div>{P}<div id="{name}">words within</div>{P}</div>', weights)) is stays


def test_hidden_parts(weights):
    hidden = '<p hidden>gone</p><div style="color: red; DISPLAY : none">gone</div><div hidden="until-found"><b>gone</b></div><i style=visibility:hidden>gone</i>'
    shown = '<p title="hidden none" class="hidden">stays</p><p style="float:none">here</p>'
    assert html_main.extract(f"<div>{P}{hidden}{shown}{P}</div>", weights) == f"{LINE}\nstays\nhere\n{LINE}"


def test_forms_around_pages(weights):
    """A form that holds a page's own parts is its frame; one within it isn't."""
    page = f"<form id=f><header>Top of the page</header><div>{P}</div><footer>Low</footer></form>"
    assert html_main.extract(page, weights) == LINE
    assert html_main.extract(f"<div>{P}<form><label>Your mail address</label></form></div><footer>Low</footer>", weights) == LINE


def test_articles_renamed(pages, weights):
    """With each article a div that holds links, a list and a nested div as well, pages keep what they had, and the new text."""
    words, kept, whole = 0, 0, []
    for page in pages:
        want = html_main.extract(page, weights)
        assert html_main.extract(re.sub(r"<(/?)article", r"<\1div", page), weights) == want
        if page.count("<article>") == 1:
            head, _, body = page.partition("<article>")
            added = '<div><div>nested text</div></div><ul><li><a href="/a">one item</a></li><li><a href="/b">other item</a></li></ul><p>see <a href="/c">this page</a></p>'
            body = body.replace("</h1>", f"</h1>{added}", 1).replace("</article>", "</div>", 1)
            got, lines = html_main.extract(f"{head}<div>{body}", weights), want.split("\n")
            expected = Counter("\n".join([*lines, "nested text", "one item", "other item", "see this page"]).split())
            words, kept = words + expected.total(), kept + (expected & Counter(got.split())).total()
            whole.append(got.split("\n") == [lines[0], "nested text", "one item", "other item", "see this page", *lines[1:]])
            assert not Counter(got.split()) - expected
    assert kept >= 0.99 * words and sum(whole) >= 0.9 * len(whole) > 0  # a short title before links may be cut off


class Plain(HTMLParser):
    """Tokens of a well-formed page: (score, text or None, block)."""

    def __init__(self, weights):
        super().__init__(convert_charrefs=True)
        self.weights, self.stack, self.found, self.block = weights, [], [], 0

    def tag(self, name, score):
        self.block += name in html_main.BLOCKS
        self.found.append((score, " " if name == "br" else None, self.block))

    def score(self, name):
        if any(n == "script" or h for n, h, _ in self.stack) or name == "script":
            return 0.0
        return html_main.LEAST_TAG if any(n == "article" for n, _, _ in self.stack) or name == "article" else self.weights.tags.get(name, html_main.OTHER_TAG)

    def handle_starttag(self, name, attrs):
        attrs = dict(attrs)
        named = [name] * (name == "nav") + [f".{c}" for c in (attrs.get("class") or "").split()]
        if name != "br":
            self.stack.append((name, "hidden" in attrs, sum(self.weights.names.get(n, html_main.prior(n)) for n in named)))
            self.tag(name, self.score(name) if not any(h for _, h, _ in self.stack) else 0.0)
        else:
            self.tag(name, self.score(name))

    def handle_endtag(self, name):
        if name == "br":
            return
        self.tag(name, self.score(name) if not any(h for _, h, _ in self.stack) else 0.0)
        self.stack.pop()

    def handle_data(self, data):
        around = self.stack[max([i for i, (n, _, _) in enumerate(self.stack) if n == "article"], default=0) :]
        least = min([w for n, _, w in around], default=0.0)
        shown = not any(n == "script" or h for n, h, _ in self.stack)
        self.found.append((len(data.split()) * max(0.0, html_main.WORD + html_main.NAMED * min(0.0, least)) if shown else 0.0, data if shown else "", self.block))


def plain(page, weights):
    parser = Plain(weights)
    parser.feed(page)
    parser.close()
    found = parser.found
    sums = {(i, j): sum(x[0] for x in found[i:j]) for i in range(len(found)) for j in range(i + 1, len(found) + 1)}
    best = max(sums.values(), default=0.0)
    if best <= 0:
        return ""
    near = [k for k, v in sums.items() if v > best - 1e-9]
    i, j = min(near, key=lambda k: (k[0], -k[1]))
    blocks = {}
    for score, text, block in found[i:j]:
        if text and (score > 0 or text.isspace()):
            blocks[block] = blocks.get(block, "") + text
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks.values()) if x)


def made(rng, depth=0, article=True):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.5 or depth > 3:
            out.append(" ".join(rng.choice(["word", "&amp;", "Größe", "a&nbsp;b"]) for _ in range(rng.randint(1, 6))) + rng.choice(["", " ", "<br>"]))
        else:
            name = rng.choice(["div", "div", "span", "ul", "section", "nav", "script", *["article"] * (article and not depth)])
            attrs = rng.choice(["", "", ' class="ad"', ' class="comment-list x"', ' class="has-sidebar"', " hidden"]) if name in ("div", "span") else ""
            out.append(f"<{name}{attrs}>{'var x = 1' if name == 'script' else made(rng, depth + 1, False)}</{name}>")
    return "".join(out)


def test_against_all_regions(weights):
    rng = random.Random(7)
    some = 0
    for _ in range(400):
        page = made(rng)
        want = plain(page, weights)
        some += bool(want)
        assert html_main.extract(page, weights) == want, page
    assert some > 200
