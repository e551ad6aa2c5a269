"""Main-text extraction from web pages (operator 6).

A page becomes a tree of block elements; what stands between two block borders is a text leaf.  Every node gets
features: text and link lengths of its subtree and their density, marks and words, attribute tokens of itself and of
what it stands in, depth, and statistics of its siblings.  Gradient-boosted trees give each node a log-odds of being
main text.  Decoding takes the choice of nodes with the largest sum of log-odds among those that are free of
contradiction: a node is kept only together with all that it stands in.

No labelled pages are given, so the trees learn from what pages say about themselves: text inside an article or main
element, or one with such an attribute token, and outside navigation, footers, asides, forms, adverts, notices and
comments, is main text; on a page without such an element, long running text outside those is.  Each sampled node
is learned in four ways: as it is; without the features of element names and attribute tokens, so that the trees also
know main text by its form; with some links in main text; and, whatever its form, as something that stands in an
aside or an element with such a token, which is never main text.  Fitting reads a bounded sample of different pages,
drawn by hash over all of them; copies of a page count once.

Text: character references decoded, white space inside a leaf as one space, trimmed; leaves in page order, joined
by one space.  Defined cases: a null or empty page has empty text; broken markup is read as far as it goes, unclosed
elements end with what they stand in; a page without any main text has empty text; rows are neither merged nor lost;
other columns pass unchanged.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.llm.boosting import Boosted
from retentia.llm.common import fresh, text_steps, texts_of

#: Element names of the HTML standard, by what they mean here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
BLOCK = {"html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "li", "main", "menu", "nav", "ol", "p",
         "pre", "search", "section", "select", "summary", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "ul", "button", "svg",
         "object", "option", "hr"}
MAIN = {"article", "main"}
ASIDE = {"nav", "footer", "header", "aside", "form", "menu", "button", "select", "option", "dialog", "fieldset", "head", "search", "svg", "object"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RUNNING = {"p", "blockquote", "pre", "dd", "figcaption", "td"}
LISTS = {"ul", "ol", "li", "dl", "dt", "menu"}
#: An element that begins ends these open ones, up to the nearest of those that hold them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
#: Attribute tokens (of class, id and role) that tell main text from the rest.
GOOD_TOKENS = {"article", "content", "main", "post", "entry", "story", "body", "text", "articlebody", "maincontent"}
BAD_TOKENS = {"ad", "ads", "advert", "advertisement", "advertising", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
              "navigation", "menu", "menubar", "sidebar", "aside", "footer", "header", "masthead", "breadcrumb", "breadcrumbs", "comment", "comments",
              "respond", "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "cookie", "cookies", "consent", "notice",
              "gdpr", "popup", "modal", "overlay", "subscribe", "subscription", "newsletter", "signup", "login", "widget", "toolbar", "pagination",
              "pager", "copyright", "legal", "disclaimer", "search", "form", "alert", "skip", "complementary", "contentinfo", "toc", "byline", "tags"}

#: Pages that the trees are fitted on, and nodes of a page among them.
FIT_PAGES, FIT_NODES = 600, 120

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_EVEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")


class Node:
    """A block element, or a leaf of text (tag ``#text``)."""

    __slots__ = ("tag", "parent", "children", "good", "bad", "text", "link", "index", "depth", "tags")

    def __init__(self, tag: str, parent: Node | None, tokens: set[str]) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.good, self.bad = len(tokens & GOOD_TOKENS), len(tokens & BAD_TOKENS)
        self.text, self.link, self.tags = "", 0, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def tokens_of(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    out: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        out.update(_TOKEN.findall((m[1] or m[2] or m[3] or "").lower()))
    return out


class Tags:
    """The tags of a page one after another, in time proportional to its length whatever its markup.

    A quoted attribute value may hold ``>``; where the quotes do not come out even, the tag ends at the first ``>``.
    A comment that is not closed goes to the end; any other ``<`` with no ``>`` after it is text.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.even = True  # no tag has had quotes that do not come out even
        self.dead: set[int] = set()  # quotes from which no tag ends outside quotes
        self.cdata = True  # a CDATA section may still be closed

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the first tag from ``at`` on; other markup has no name."""
        page = self.page
        while (lt := page.find("<", at)) >= 0:
            if self.even and (m := _EVEN.match(page, lt)):
                return lt, m.end(), m[1] != "", m[2].lower(), m[3]
            mark = page[lt + 1:lt + 2]
            if mark == "!" or mark == "?":
                end = self._other(lt)
                if end >= 0:
                    return lt, end, False, "", ""
            elif lt > self.last:
                self.even = False
            else:
                closes = mark == "/"
                name = _NAME.match(page, lt + 1 + closes)
                if name:
                    self.even = False
                    end = self._end(name.end())
                    return lt, end, closes, name[0].lower(), page[name.end():end - 1]
            at = lt + 1
        return None

    def _other(self, lt: int) -> int:
        """The end of a comment, a CDATA section, a declaration or an instruction; -1 if it is none."""
        page = self.page
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            return end + 3 if end >= 0 else len(page)
        if self.cdata and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            if end >= 0:
                return end + 3
            self.cdata = False
        return page.find(">", lt) + 1 if lt < self.last else -1

    def _end(self, at: int) -> int:
        """After the ``>`` of the tag whose attributes begin at ``at``; there is one, since ``at`` is not behind the last."""
        page, tried, place = self.page, [], at
        while (stop := _STOP.search(page, place)) and stop.start() not in self.dead:
            if stop[0] == ">":
                return stop.end()
            tried.append(stop.start())
            close = page.find(stop[0], stop.end())
            if close < 0:
                break
            place = close + 1
        self.dead.update(tried)
        return page.find(">", at) + 1


def parse(page: str) -> list[Node]:
    """Nodes in page order; the first is the root."""
    root = Node("#root", None, set())
    nodes, stack = [root], [(root.tag, root)]  # open elements with the block that each belongs to
    opened: dict[str, list[int]] = {}  # of each name, where it stands in the stack
    pieces: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = "".join(pieces)
        pieces.clear()
        if text and not text.isspace():
            leaf = Node("#text", stack[-1][1], set())
            leaf.text, leaf.link = text, links
            nodes.append(leaf)
        links = 0

    def close(at: int) -> None:
        """Ends the open elements from ``at`` on."""
        if any(t in BLOCK for t, _ in stack[at:]):
            flush()
        for t, _ in stack[at:]:
            opened[t].pop()
        del stack[at:]

    def nearest(names: set[str]) -> int:
        """The place of the innermost open element of one of ``names``; 0 if none is open."""
        return max((places[-1] for n in names if (places := opened.get(n))), default=0)

    at, size, tags = 0, len(page), Tags(page)
    while at < size:
        tag = tags.next(at)
        start = tag[0] if tag else size
        if start > at:
            pieces.append(page[at:start])
            if opened.get("a"):
                links += start - at
        if tag is None:
            break
        _, at, closes, name, attributes = tag
        if not name:
            continue
        if closes:
            if opened.get(name):
                close(opened[name][-1])
            continue
        stack[-1][1].tags += 1
        if name in RAW:  # nothing in it is text
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            close_at = page.find(">", end.start()) if end else -1
            at = close_at + 1 if close_at >= 0 else size
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK:
            ended, limit = ENDS.get(name, ({"p"}, {"button", "table", "td", "th", "object"}))
            while (k := nearest(ended)) > nearest(limit):
                close(k)
                if name != "tr":
                    break
            flush()
            if name in VOID:
                continue
            node = Node(name, stack[-1][1], tokens_of(attributes))
            nodes.append(node)
        elif name in VOID:
            continue
        else:
            node = stack[-1][1]
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, node))
    flush()
    for i, n in enumerate(nodes):
        n.index = i
    return nodes


FEATURES = ["depth", "siblings", "place among siblings", "own text", "text", "link share", "text a tag", "marks a word", "words", "share of page",
            "place in page", "leaf", "siblings' text", "share of parent", "letters a word",
            # what names and attributes say; the rest is form
            "main", "aside", "heading", "running", "list", "good tokens", "bad tokens", "in main", "in aside", "in good", "in bad"]
NAMED = FEATURES.index("main")


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node."""
    n = len(nodes)
    text, link, tags, words, marks = ([0] * n for _ in range(5))
    start = [0] * n
    at = 0
    for i, x in enumerate(nodes):
        start[i] = at
        tags[i] = x.tags
        if x.text:
            t = x.text
            text[i], link[i], words[i] = len(t), x.link, t.count(" ") + 1
            marks[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
            at += len(t)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        for a in (text, link, tags, words, marks):
            a[p] += a[i]
    page = max(1, text[0])
    inside = [(0, 0, 0, 0)] * n
    rows = []
    log = math.log1p
    for i, x in enumerate(nodes):
        p = x.parent
        up = inside[p.index] if p else (0, 0, 0, 0)
        own = (x.tag in MAIN, x.tag in ASIDE, x.good > 0, x.bad > 0)
        inside[i] = tuple(a or b for a, b in zip(up, own))
        family = len(p.children) if p else 1
        others = (text[p.index] - text[i]) / max(1, family - 1) if p else 0
        tag = x.tag if x.text == "" else (p.tag if p else "")
        rows.append((x.depth, family, 0, log(len(x.text)), log(text[i]), link[i] / max(1, text[i]), log(text[i] / (tags[i] + 1)),
                     marks[i] / max(1, words[i]), log(words[i]), text[i] / page, start[i] / page, x.tag == "#text", log(others),
                     text[i] / max(1, text[p.index] if p else page), min(30, text[i] / max(1, words[i])),
                     own[0], own[1], tag in HEADINGS, tag in RUNNING, tag in LISTS, x.good, x.bad, *up))
    out = np.array(rows, np.float64).reshape(n, len(FEATURES))
    for x in nodes:
        for k, c in enumerate(x.children):
            out[c.index, 2] = k / len(x.children)
    return out


def weak_labels(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    """1 for main text and what holds it, by the page's own marks."""
    f = {name: x[:, k] for k, name in enumerate(FEATURES)}
    leaf = f["leaf"] > 0
    out_of = (f["in aside"] > 0) | (f["in bad"] > 0) | (f["aside"] > 0) | (f["bad tokens"] > 0)
    within = (f["in main"] > 0) & ~out_of
    if not (within & leaf).any():
        within = (f["in good"] > 0) & ~out_of
    if not (within & leaf).any():
        within = ~out_of & (f["words"] > math.log1p(12)) & (f["link share"] < 0.3)
    label = (within & leaf).astype(np.float64)
    for i in range(len(nodes) - 1, 0, -1):
        if label[i]:
            label[nodes[i].parent.index] = 1
    return label


def kept_leaves(nodes: list[Node], logit: np.ndarray) -> list[Node]:
    """Leaves of the best choice of nodes in which every kept node's parent is kept."""
    gain = logit.tolist()
    gain[0] = max(gain[0], 0.0)
    for i in range(len(nodes) - 1, 0, -1):  # children before parents
        if gain[i] > 0:
            gain[nodes[i].parent.index] += gain[i]
    kept = [False] * len(nodes)
    out = []
    for i, n in enumerate(nodes):
        kept[i] = gain[i] > 0 and (n.parent is None or kept[n.parent.index])
        if kept[i] and n.tag == "#text":
            out.append(n)
    return out


def main_text(page: str, model: Boosted) -> str:
    nodes = parse(page)
    if len(nodes) == 1:
        return ""
    leaves = kept_leaves(nodes, model.logit(features(nodes)))
    return " ".join(t for t in (" ".join(decoded(n.text).split()) for n in leaves) if t)


_LONG_NUMBER = re.compile(r"&#(?:0*([0-9]{8,})|[xX]0*([0-9a-fA-F]{8,}));?")


def decoded(text: str) -> str:
    """``text`` with its character references decoded; a number beyond all characters is the replacement character."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_NUMBER.sub(_short, text)
    return html.unescape(text)


def _short(m: re.Match) -> str:
    digits = (m[1] or m[2]).lstrip("0")
    if len(digits) >= 8:
        return "\ufffd"
    return f"&#{'' if m[1] else 'x'}{digits or '0'};"


def fit(pages: DataFrame, page: str = "html", fit_pages: int = FIT_PAGES) -> Boosted:
    """The trees, fitted on the ``fit_pages`` different pages whose markup has the smallest hashes (all, if fewer)."""
    rows = pages.select(F.col(page).alias("html")).filter("html IS NOT NULL").withColumn("draw", F.xxhash64("html"))
    cut = rows.select("draw").distinct().orderBy("draw").limit(fit_pages).agg(F.max("draw")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, at in zip(texts_of(batch, "html"), batch.column(1).to_pylist()):
                nodes = parse(text)
                x = features(nodes)
                y = weak_labels(nodes, x)
                some = np.unique(np.linspace(0, len(nodes) - 1, FIT_NODES).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at, np.int64)), pa.array(y[some]), pa.array(list(x[some]), pa.list_(pa.float64()))],
                                                 names=["draw", "y", "x"])

    drawn = rows.filter(F.col("draw") <= F.lit(cut).cast("long")).dropDuplicates(["draw"])  # copies are one page
    got = drawn.select("html", "draw").mapInArrow(run, "draw long, y double, x array<double>").orderBy("draw", "y", "x").collect()  # fit_pages x FIT_NODES rows
    x, y = np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got])
    at = FEATURES.index
    rng = np.random.Generator(np.random.PCG64(17))
    plain, linked, off = x.copy(), x.copy(), x.copy()
    plain[:, NAMED:] = 0
    main = y > 0
    linked[main, at("link share")] = rng.uniform(0, 0.4, int(main.sum()))
    which = rng.integers(0, 4, len(x))
    for k, name in enumerate(("aside", "bad tokens", "in aside", "in bad")):
        off[which == k, at(name)] = 1
    return Boosted.fit(np.concatenate([x, plain, linked, off]), np.concatenate([y, y, y, np.zeros(len(y))]), trees=60)


def extract(df: DataFrame, model: Boosted, page: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of ``page`` as the column ``out`` (underscores in front if the name is taken)."""
    out = fresh(out, df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, page):
                got = [main_text(t, model) for t in texts_of(part, page)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)
