"""Main text of web pages by composite text density.

A page becomes a small tree of elements and runs of text. What is never part of an article (scripts, forms, menus, page
headers, footers, asides, and elements whose class, id or role says advert, notice, comments and the like) is cut off. Of
every node left, the composite text density is its characters per tag, raised or lowered by how many of them are links,
relative to the body. Of the nodes in the body the one whose children's densities sum highest holds the article. The least
density on the way from the body to it is the threshold for branches beside it: a branch at or over it gives its own
highest node too. Text of the chosen nodes is put out block by block.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style textarea title xmp iframe noembed noframes".split()}
#: Elements that end a paragraph and start a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split()
)
#: Start tag -> open elements that it closes, unless one of the fences was opened later.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_FENCES = frozenset("table td th caption button object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of an article.
CUT = frozenset(
    "head script style noscript template iframe noembed noframes xmp svg canvas object embed audio video map nav menu footer aside form search "
    "fieldset legend label input button select option datalist textarea output progress meter dialog title applet".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words of classes and ids that mark what is beside an article.
CUT_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies toolbar copyright skip".split()
)
#: With one of these before them, such words tell about a page's layout.
LAYOUT = frozenset("has with no without".split())
#: Elements that marks of class and id don't cut.
WHOLE = frozenset("html body main article".split()) | HEADINGS

#: Comment, other declaration, or tag; group 5 is the rest of a tag whose attributes, if any, are plainly quoted.
MARKUP = re.compile(r"""<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*+)((?:\s++[a-zA-Z-]++="[^"<>]*+")*+\s*+/?>)?)""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
STOP = re.compile(r"""[>"']""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """Nodes in page order; a node's parent has a smaller number. Node 0 is the root; runs of text are nodes without a name."""

    def __init__(self, html: str) -> None:
        self.names, self.parents, self.attributes, self.texts = ["html"], [-1], [""], [""]
        self.open, self.places = [0], defaultdict(list)
        self._read(html)

    def _add(self, name: str, attributes: str = "", text: str = "") -> int:
        self.names.append(name)
        self.parents.append(self.open[-1])
        self.attributes.append(attributes)
        self.texts.append(unescape(text) if "&" in text else text)
        return len(self.names) - 1

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.places[self.names[self.open.pop()]].pop()

    def _last(self, names) -> int:
        """Depth of the last opened element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and (name == "html" or self.places["body"]):
            return
        if name in BLOCKS:
            if self.places["p"] and (p := self.places["p"][-1]) > self._last(P_FENCES):
                self._close(p)
            if name == "body" and self.places["head"]:
                self._close(self.places["head"][-1])
        if name in CLOSES and (at := self._last(CLOSES[name][0])) > self._last(CLOSES[name][1]):
            self._close(at)
        node = self._add(name, attributes)
        if name not in VOID:
            self.places[name].append(len(self.open))
            self.open.append(node)

    def _read(self, html: str) -> None:
        at, text_from, unclosed, places = 0, 0, set(), self.places
        while m := MARKUP.search(html, at):
            if text_from < m.start():
                self._add("", text=html[text_from : m.start()])
            comment, bogus, slash, name, rest = m.groups()
            if comment:
                end = html.find("-->", m.start() + 2)
                at = text_from = len(html) if end < 0 else end + 3
                continue
            at = text_from = m.end() if rest else tag_end(html, m.end(), unclosed)
            if bogus:
                continue
            name = name.lower()
            if slash:
                if places[name]:
                    self._close(places[name][-1])
                continue
            self._start(name, rest[:-1] if rest else html[m.end() : at - 1])
            if name in RAW:
                end = RAW[name].search(html, at)
                at = text_from = end.start() if end else len(html)
        if text_from < len(html):
            self._add("", text=html[text_from:])


def tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """Place after the first > outside quotes. A quote opens after = only; one that nothing closes is no quote."""
    before = at
    while stop := STOP.search(html, at):
        at = stop.end()
        quote = stop.group()
        if quote == ">":
            return at
        if quote not in unclosed and html[before : stop.start()].rstrip().endswith("="):
            closing = html.find(quote, at)
            if closing < 0:
                unclosed.add(quote)
            else:
                at = closing + 1
        before = at
    return len(html)


def marked(attributes: str) -> bool:
    """Whether classes, id or role say that an element is no part of an article, or it is hidden."""
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), unescape(m.group(2) or m.group(3) or m.group(4) or "")
        if key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in WORDS.findall(one)]
                if any(w in CUT_WORDS and not LAYOUT & set(words[:i]) for i, w in enumerate(words)):
                    return True
        elif key == "role" and value.lower() in CUT_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            return True
    return False


def kept_nodes(page: Page) -> list[bool]:
    """False for nodes that are cut off, with all below them.

    A marked element that holds a main or an unmarked article stays: marks of wrappers tell about the page. A header inside
    an article keeps its headings only; outside, it goes.
    """
    n, names, parents = len(page.names), page.names, page.parents
    marks = [bool(a) and name not in ("html", "body", "main") and marked(a) for name, a in zip(names, page.attributes, strict=True)]
    holds = [name == "main" or name == "article" and not mark for name, mark in zip(names, marks, strict=True)]
    for i in range(n - 1, 0, -1):
        if holds[i]:
            holds[parents[i]] = True
    kept, within, heading, header = [True] * n, [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        p, name = parents[i], names[i]
        within[i] = within[p] or name in ("article", "main")
        heading[i] = heading[p] or name in HEADINGS
        header[i] = header[p] or name == "header"
        out = name in CUT or name == "header" and not within[i] or marks[i] and not holds[i] and name not in HEADINGS
        kept[i] = kept[p] and not out and not (header[i] and name == "" and not heading[i])
    return kept


def densities(page: Page, kept: list[bool]) -> tuple[list[float], list[float], list[int]]:
    """(composite text density, sum of the children's, characters) of every node; nodes cut off have none.

    With C characters, T tags, L link characters, LT link tags and N = C - L below a node, each 1 where it is 0, and the
    share S of link characters in the page, the density is C / T * log(C / L * T / LT) to the base ln(C / N * L + S * C + e).
    White space doesn't count.
    """
    n, names, parents = len(page.names), page.names, page.parents
    chars, tags, link_chars, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        linked[i] = linked[parents[i]] or names[i] == "a"
        if kept[i] and not names[i]:
            chars[i] = sum(map(len, page.texts[i].split()))
            link_chars[i] = chars[i] if linked[i] else 0
    for i in range(n - 1, 0, -1):
        if kept[i]:
            p = parents[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + bool(names[i])
            link_tags[p] += link_tags[i] + (names[i] == "a")
    share = link_chars[0] / max(1, chars[0])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if kept[i] and chars[i]:
            c, t, lc, lt, other = (max(1, x) for x in (chars[i], tags[i], link_chars[i], link_tags[i], chars[i] - link_chars[i]))
            density[i] = c / t * math.log(c / lc * t / lt) / math.log(math.log(c / other * lc + share * c + math.e))
            if i:
                sums[parents[i]] += density[i]
    return density, sums, chars


def article_nodes(page: Page, kept: list[bool]) -> set[int]:
    """The chosen nodes: the one of the highest sum, and those of other branches at or over the threshold.

    A paragraph or a span is no article: the choice goes up to the nearest article or main, else to the nearest element
    that holds blocks, and on to its parent while that adds a title and little else. Beside an article only others count.
    """
    density, sums, chars = densities(page, kept)
    names, parents, n = page.names, page.parents, len(page.names)
    if not chars[0]:
        return set()
    best = max((i for i in range(n) if names[i] and kept[i]), key=lambda i: (sums[i], chars[i], -i))
    if not sums[best]:
        return {0}  # a few characters
    path = [best]
    while path[-1]:
        path.append(parents[path[-1]])
    threshold = min(density[i] for i in path)
    holds_blocks, titled = [False] * n, [False] * n
    for i in range(1, n):
        if kept[i]:
            holds_blocks[parents[i]] |= names[i] in BLOCKS
            titled[parents[i]] |= names[i] in HEADINGS
    around = next((i for i in path if names[i] in ("article", "main")), None)
    articles_only = around is not None
    if around is None:
        around = next((i for i in path if holds_blocks[i]), 0)
        while around and titled[parents[around]] and 3 * chars[around] >= 2 * chars[parents[around]]:
            around = parents[around]
    highest = list(range(n))  # the node of the highest sum in each subtree
    for i in range(n - 1, 0, -1):
        if kept[i] and names[i] and sums[highest[i]] > sums[highest[parents[i]]]:
            highest[parents[i]] = highest[i]
    chosen, on_path = {around}, set(path)
    above = set(path[path.index(around) + 1 :])
    for i in range(1, n):
        if parents[i] in above and i not in on_path and kept[i] and names[i] and chars[i] and density[i] >= threshold:
            if names[i] == "article" or not articles_only:
                chosen.add(highest[i] if names[i] != "article" and holds_blocks[highest[i]] else i)
    return chosen


def main_text(html: str | None) -> str:
    """Blocks of the article in page order, two line ends between, white space inside a block one space; empty if there is none."""
    if not html:
        return ""
    page = Page(html)
    kept = kept_nodes(page)
    chosen = article_nodes(page, kept)
    names, parents = page.names, page.parents
    taken, block = [0 in chosen], [0]
    blocks: list[list[str]] = [[]]
    ended, last = True, 0
    for i in range(1, len(names)):
        taken.append(kept[i] and (taken[parents[i]] or i in chosen))
        block.append(i if names[i] in BLOCKS else block[parents[i]])
        if names[i] in BLOCKS:
            ended = True  # also one that is cut off stands between the texts around it
        elif taken[i] and names[i] in ("br", "td", "th"):
            blocks[-1].append(" ")
        elif taken[i] and not names[i]:
            if ended or block[i] != last:
                blocks.append([])
            ended, last = False, block[i]
            blocks[-1].append(page.texts[i])
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def extracted(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with a column `into` (replaced if there): the main text of every page.

    Null and empty html, and pages without an article, have an empty text. Very long pages are read whole, in time linear
    in their length; repeated rows get the same text; an empty table stays empty; other columns, whatever their names, stay.
    """
    names = [f"c{i}" for i in range(len(pages.columns))]
    keep = [(c, a) for c, a in zip(pages.columns, names, strict=True) if c.lower() != into.lower()]
    slim = pages.toDF(*names).select(*[a for _, a in keep], F.col(names[pages.columns.index(html)]).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(a) for _, a in keep], texts], names=[*[a for _, a in keep], "text"])

    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("text", T.StringType())])
    return slim.mapInArrow(run, schema).toDF(*[c for c, _ in keep], into)


def report(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return extracted(slim).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
