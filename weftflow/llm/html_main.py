"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; a linear scan finds the contiguous region with the
greatest sum, of equal ones the first and longest. Weights are learned from labelled pages, those with exactly one article
element, as log odds of standing inside and outside of the article:

- of each kind of tag, between MOST_TAG and LEAST_TAG, those seen seldom drawn towards OTHER_TAG. So no tag costs more than a word is
  worth, and text that is full of links, lists or short blocks holds together, also in a page without article; a list of single
  linked words costs more than it is worth, and is left out at the ends. Within an article or main element every tag scores LEAST_TAG.
- of each name in class, id and role, and of the tags that HTML has for other parts (nav, footer, ...). The words of an element
  score less by NAMED times the least such sum among the elements around them, those beyond the next article or main element
  aside, but not less than nothing. So a menu, notice or advert is worth nothing, however long it is, and is left out within the
  region without parting it, while one name never costs an article around which it stands. Names that fewer than LEAST_SEEN labelled elements have start from a
  prior: PART where HTML tells of another part of a page, or the name is made of words for such a part and for its shape
  (`ad-slot`, but not `has-sidebar`), else 0. A form around a menu, header, footer or article is the page's frame and no part of it.

An article within another one, as readers' comments often are, is judged as any element. A page that is a menu or form alone has no
main text. What browsers don't show is no text: scripts and the like, elements with `hidden`, and styles that hide.

Character references are decoded, white space within a block becomes one space, and blocks are joined by a line feed.

Nulls: null html is empty and gives an empty text; a page without words too. Repeated rows are extracted each. Pages that
break off, unclosed and stray tags are read as browsers do, roughly: an unclosed part ends with the element around it. Time grows
with a page's length, not with its depth. Extra columns are left behind, whatever their names. Without labelled pages there are
the priors; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, map_in_arrow, slices

#: Labelled pages that the weights are learned from, at most; elements with a name from which on its learned weight counts.
TRAIN_PAGES, LEAST_SEEN = 400, 3
#: Of a word; of tags at most, at least, and of tags that no labelled page has; tags of a kind that weigh as much as that prior.
WORD, LEAST_TAG, MOST_TAG, OTHER_TAG, SHRINK = 0.2, -0.01, -0.12, -0.05, 10
#: Prior of names of other parts; how much of a name's weight each word below it gets.
PART, NAMED = -4.0, 0.1

# Names of HTML.
SILENT = {"script", "style", "noscript", "template", "title", "textarea", "svg", "math", "iframe", "object", "canvas", "select", "button", "head"}
RAW = ("script", "style", "textarea", "title")
PARTS = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"}
# Words in class, id and role that name parts other than the article.
PART_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disqus", "footer",
    "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "reactions", "related", "replies", "search", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "toolbar",
}
# Words that names of parts also have, for their place or shape.
SHAPE_WORDS = {"area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "container", "form", "global", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "posts", "primary", "right", "row", "secondary", "site", "slot", "thread", "top", "unit", "widget", "wrap", "wrapper"}
# Parts of a whole page, so that a form which holds one is no form alone.
FRAMED = {"nav", "header", "footer", "main", "article"}

# An attribute: a quote opens a string right after the equals sign only, any other quote is a character like the rest.
ATTRIBUTE = r"""(?:=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*(?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^\s>"'][^\s>]*|(?=>)|$))?"""
TOKEN = re.compile(rf"""<!--(?:>|->|.*?(?:-->|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|{ATTRIBUTE})*)(?:>|$)|([^<]+|<)""", re.S)
ATTRIBUTES = re.compile(ATTRIBUTE)
NAMING = re.compile(rf"""(?P<name>class|id|role)\s*=\s*(?:"([^"]*)|'([^']*)|([^\s>"'][^\s>]*))|{ATTRIBUTE}""", re.I)


@dataclass
class Weights:
    tags: dict[str, float] = field(default_factory=dict)
    names: dict[str, float] = field(default_factory=dict)  # of a tag in PARTS as it is, of a class, id or role after a dot

    def of(self, names: tuple[str, ...]) -> float:
        """The sum over an element's names."""
        return sum(self.names[n] if n in self.names else prior(n) for n in names)


def prior(name: str) -> float:
    words = {w for w in re.split(r"[-_]+", name[1:]) if w and not w.isdigit()} if name[0] == "." else set()
    return PART if name in PARTS or words & PART_WORDS and words <= PART_WORDS | SHAPE_WORDS else 0.0


def is_hidden(attributes: str) -> bool:
    """Whether an element's own attributes hide it."""
    if "hidden" not in attributes.lower() and "none" not in attributes.lower():
        return False
    for m in ATTRIBUTES.finditer(attributes):
        key, _, value = m[0].lower().partition("=")
        style = re.sub(r"\s+", "", value) if key.strip() == "style" else ""
        if key.strip() == "hidden" or re.search(r"(?:^|[\"';])(?:display:none|visibility:hidden)", style):
            return True
    return False


def names_of(name: str, attributes: str) -> tuple[str, ...]:
    """What an element is named: its tag where HTML has it for another part, and its classes, ids and roles."""
    own = (name,) if name in PARTS else ()
    if not attributes or "=" not in attributes or name in ("html", "body", "main", "article"):
        return own
    found = ("".join(x or "" for x in m.groups()[1:]).lower() for m in NAMING.finditer(attributes) if m["name"])
    return own + tuple(dict.fromkeys(f".{x}" for value in found for x in value.split()))


@dataclass(slots=True)
class Open:
    """An open element; what holds for all that it holds."""

    name: str
    silent: bool
    article: bool  # within an article or main element, or one itself
    weight: float  # the least of the elements around, this one included, from the next article or main element on
    paragraph: int  # place of the open paragraph that a block would end, or -1
    names: tuple[str, ...]
    at: int = -1  # place of its tag in the page


@dataclass(slots=True)
class Token:
    kind: str  # word, open, close
    name: str  # of a tag
    silent: bool  # it stands in an element that isn't shown, or begins or ends one
    article: bool
    weight: float
    block: int  # blocks begun before it
    text: str = ""  # decoded, with the white space at its ends
    names: tuple[str, ...] = ()
    held: bool = False  # the element that it begins holds an article or main element


ROOT = Open("", False, False, 0.0, -1, ())


def tokens(page: str, weights: Weights, frames: frozenset[int] = frozenset()) -> list[Token]:
    """Words and tags in page order. `frames` are the places of forms that hold the page's own parts; they are looked for in a pass before."""
    out: list[Token] = []
    open_, begun, count = [ROOT], [-1], Counter()  # elements, their tokens, and how many of a name are open
    block, at, articles, framing = 0, 0, 0, set()

    def leave(size: int) -> Open:
        """End elements until `size` are left; the last one ended."""
        while len(open_) > size:
            last = open_.pop()
            count[last.name] -= 1
            begun.pop()
        return last

    while at < len(page):
        found = TOKEN.match(page, at)
        at = found.end()
        close, name, attributes, text = found.groups()
        top = open_[-1]
        if text is not None:
            if out and out[-1].kind == "word":
                out[-1].text += text if text == "<" else html.unescape(text)
            else:
                out.append(Token("word", "", top.silent, top.article, top.weight, block, html.unescape(text)))
            continue
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            block += 1
        if close:
            if count[name]:
                while open_[-1].name != name:
                    leave(len(open_) - 1)
                top = leave(len(open_) - 1)
            out.append(Token("close", name, top.silent or name in SILENT, top.article, top.weight, block))
            continue
        if name in CLOSES_P and top.paragraph >= 0:  # an open paragraph ends before a block
            leave(top.paragraph)
        if name in ("li", "dt", "dd", "option", "tr", "td", "th") and open_[-1].name == name:
            leave(len(open_) - 1)
        top, named = open_[-1], names_of(name, attributes)
        if name == "form" and found.start() in frames:
            named = ()
        if name in FRAMED and count["form"]:
            framing.update(o.at for o in open_ if o.name == "form")
        whole = name in ("article", "main")
        # what stands around an article doesn't count against it, but within another one and, after main's first, within main
        fresh = whole and not (count["article"] or name == "article" and articles and count["main"])
        if fresh:
            for i in begun[1:]:
                out[i].held = True
        articles += name == "article"
        own = Open(name, top.silent or name in SILENT or is_hidden(attributes), top.article or whole, 0.0 if fresh else min(top.weight, weights.of(named)), len(open_) if name == "p" else -1 if name in BLOCKS else top.paragraph, named, found.start())
        out.append(Token("open", name, own.silent, own.article, own.weight, block, names=named))
        if name not in VOID and not attributes.rstrip().endswith("/"):
            open_.append(own)
            begun.append(len(out) - 1)
            count[name] += 1
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(page, at)
                at = end.start() if end else len(page)
    return out if framing <= frames else tokens(page, weights, frames | framing)


def scores_of(found: list[Token], weights: Weights) -> np.ndarray:
    """A score for each token, that of a run of words for all of them."""
    out = np.zeros(len(found))
    for i, t in enumerate(found):
        if t.silent:
            continue
        if t.kind == "word":
            out[i] = len(t.text.split()) * max(0.0, WORD + NAMED * min(0.0, t.weight))
        else:
            out[i] = LEAST_TAG if t.article else weights.tags.get(t.name, OTHER_TAG)
    return out


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """The half-open range with the greatest sum, of equal ones the first that ends last; empty where no score is positive."""
    if not len(scores) or scores.max() <= 0:
        return 0, 0
    best, now, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores.tolist()):
        if now <= 0:
            now, start = 0.0, i
        now += x
        if now > best or (now == best and start == found[0]):
            best, found = now, (start, i + 1)
    return found


def extract(page: str | None, weights: Weights) -> str:
    found = tokens(page or "", weights)
    scores = scores_of(found, weights)
    begin, end = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for i in range(begin, end):
        token = found[i]
        if token.kind == "word" and (scores[i] > 0 or not token.silent and token.text.isspace()):
            blocks.setdefault(token.block, []).append(token.text)
        elif token.name == "br":
            blocks.setdefault(token.block, []).append(" ")
    joined = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(b for b in joined if b)


def learn(pages: list[str]) -> Weights:
    """Weights from pages with exactly one article element; other pages say nothing. An element around the article counts as inside."""
    tags, names = (Counter(), Counter()), (Counter(), Counter())
    for page in pages:
        found = tokens(page, Weights())
        if sum(t.kind == "open" and t.name == "article" for t in found) != 1:
            continue
        within = False
        for t in found:
            if t.name == "article":
                within = t.kind == "open"
            if t.kind != "word":
                tags[within or t.name == "article"][t.name] += 1
            if t.kind == "open":
                names[within or t.held].update(t.names)
    total = [sum(c.values()) + 1 for c in tags]
    odds = lambda counts, k: float(np.log((counts[1][k] + 0.5) / total[1]) - np.log((counts[0][k] + 0.5) / total[0]))

    def tag(k: str) -> float:
        seen = tags[0][k] + tags[1][k]
        return (seen * min(LEAST_TAG, max(MOST_TAG, odds(tags, k))) + SHRINK * OTHER_TAG) / (seen + SHRINK)

    return Weights(
        {k: tag(k) for k in tags[0].keys() | tags[1].keys()},
        {k: odds(names, k) for k in names[0].keys() | names[1].keys() if names[0][k] + names[1][k] >= LEAST_SEEN},
    )


def fit(pages: DataFrame, rows: int = TRAIN_PAGES) -> Weights:
    """Weights from at most `rows` labelled pages, drawn by a hash of the page. Not many more than `rows` reach the driver, whatever the table's size."""
    pick = F.xxhash64("html")
    labelled = pages.select("html").filter(F.lower("html").contains("<article"))
    sample = labelled.filter(hash_share(pick, labelled.count(), 2 * rows)).orderBy(pick, "html").limit(rows)
    return learn([r["html"] for r in sample.collect()])


def main_text(pages: DataFrame, weights: Weights, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(keys, text string) of each row."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # a number for each kind of tag and each name on TRAIN_PAGES pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([extract(x, shared.value) for x in batch.column(len(keys)).to_pylist()], pa.string())
            yield pa.record_batch([*batch.columns[:-1], texts], [*keys, "text"])

    rows = pages.select(*keys, F.col(html_col).cast("string").alias("_html"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1])
    return map_in_arrow(rows, run, f"{kinds}, text string")
