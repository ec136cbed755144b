"""The article of a web page, from the events of the standard library's streaming HTML parser.

The parser's events become lines: the text of one block, its number of tags, and the element it stands in. Menus,
page headers, footers, sidebars, notices, adverts, forms, reader comments and what is hidden, by tag, role or a word
of class or id, weigh nothing. Each line's ratio of text outside links to tags is smoothed along the page by a
Gaussian; lines at or above one standard deviation of the smoothed ratios (the highest line, where none reaches it)
are clusters of content. Clusters then grow to whole regions, since short lines of an article have low ratios too: to
the ``article`` (else ``main``) they lie in where the page has one, else to the lines of the same container and to
lines between two clusters that are not mostly links.

Markup errors are read as browsers do: end tags that may be left out, blocks closed by their parents, end tags of
nothing, tags, comments and scripts that the end of the page cuts off. An ``article`` inside another is a comment.
``br`` is white space inside a block. White space is Unicode's, with the no-break space.

Null and empty html give an empty text. Repeated rows give repeated results. Other columns are ignored. A page is
worked on by itself, in time and memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Reach of the smoothing, in lines, and the threshold in standard deviations.
SIGMA, LAMBDA = 1.0, 1.0
#: Share of link characters from which a line between clusters is no content.
LINKED = 0.5

_words = lambda text: frozenset(text.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCK = _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary"
    " table tbody td tfoot th thead title tr ul"
)
SILENT = _words(
    "script style noscript template iframe object svg head title textarea select button canvas audio video datalist noframes"
    " noembed frameset"
)
IN_HEAD = _words("base link meta title style script noscript template head")
#: What stands in a block of its own between tables' cells cannot be closed from inside.
SCOPE = _words("table td th caption template object")
TABLE = _words("table tbody thead tfoot tr td th caption")
#: Start tags that end an open element, and what shields it.
ENDS = {
    "li": (_words("li"), _words("ul ol menu dir")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "tr": (_words("tr"), _words("table")),
    "td": (_words("td th"), _words("table")),
    "th": (_words("td th"), _words("table")),
    "tbody": (_words("tbody thead tfoot"), _words("table")),
    "tfoot": (_words("tbody thead tfoot"), _words("table")),
}
NO_P = _words("body head html li dd dt td th tr tbody thead tfoot caption legend summary title figcaption")
CONTAINER = _words("body main article section div td th center html")

#: Around an article these may stand by mistake (or, as forms, by habit): an article inside clears them.
WRAP = _words("nav header form search menu")
APART = _words("aside footer dialog fieldset")
ROLES_WRAP = _words("navigation banner search form menu menubar toolbar tablist")
ROLES_APART = _words("complementary contentinfo alert alertdialog dialog status note doc-footnote")
HEADER_NAMES = _words("header masthead topbar")
NAMES_WRAP = _words("nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar search form login signup")
NAMES_APART = _words(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored promo promotion banner"
    " cookie cookies consent gdpr notice notices popup modal overlay paywall"
    " sidebar sidebars aside widget widgets related recommended recommendations trending"
    " footer footers colophon copyright"
    " comment comments commentlist respond disqus replies discussion"
    " share sharing social newsletter subscribe subscription"
)
#: First words of names that tell what a page has, not what the element is.
ABOUT = _words("with no has without not hide show")

_NONE, _WRAP, _APART = 0, 1, 2
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|[0-9]+")


def _kind(tag: str, attrs: dict[str, str | None], in_article: bool) -> int:
    """Whether an element is no content by its tag, role, state or names."""
    if tag in ("html", "body"):
        return _NONE
    style = (attrs.get("style") or "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return _APART
    role = (attrs.get("role") or "").strip().lower()
    kind = _APART if tag in APART or role in ROLES_APART else _NONE
    if not kind and (tag in WRAP and not (tag == "header" and in_article) or role in ROLES_WRAP):
        kind = _WRAP
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not parts or parts[0] in ABOUT:
            continue
        if not NAMES_APART.isdisjoint(parts):
            return _APART
        if not NAMES_WRAP.isdisjoint(parts) or not in_article and not HEADER_NAMES.isdisjoint(parts):
            kind = max(kind, _WRAP)
    return kind


@dataclass
class Line:
    """A block's text with the element it begins in, the tags since the line before, and its characters in links."""

    element: int
    text: str
    tags: int
    linked: int


class Page(HTMLParser):
    """Lines and elements of a page. An element is (tag, parent, kind); element 0 stands for the page."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, int, int]] = [("html", 0, _NONE)]
        self.roots: dict[str, list[int]] = {"article": [], "main": []}
        self.lines: list[Line] = []
        self._stack: list[int] = [0]
        self._open: Counter[str] = Counter()
        self._silent = 0
        self._text: list[str] = []
        self._at = self._tags = self._linked = 0
        self.feed(html)
        self.close()
        self._end_line()

    # lines -------------------------------------------------------------------------------

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append(Line(self._at, text, self._tags, min(self._linked, len(text))))
            self._tags = 0
        self._text.clear()
        self._linked = 0

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if not self._text or not self._text[0]:
            if data.isspace():
                return
            self._text.clear()
            self._at = self._stack[-1]
        self._text.append(data)
        if self._open["a"]:
            self._linked += len(data)

    # elements ----------------------------------------------------------------------------

    def _push(self, tag: str, attrs: dict[str, str | None]) -> None:
        inside = self._open["article"] + self._open["main"] > 0
        kind = _kind(tag, attrs, inside)
        if tag == "article" and self._open["article"]:
            kind = _APART  # an article in an article is a comment on it
        if kind and tag not in BLOCK:
            self._end_line()
        here = len(self.elements)
        self.elements.append((tag, self._stack[-1], kind))
        if tag == "article" or "articlebody" in (attrs.get("itemprop") or "").lower().split():
            self.roots["article"].append(here)
        elif tag == "main" or (attrs.get("role") or "").strip().lower() == "main":
            self.roots["main"].append(here)
        self._stack.append(here)
        self._open[tag] += 1
        self._silent += tag in SILENT

    def _pop(self) -> None:
        tag, _, kind = self.elements[self._stack.pop()]
        self._open[tag] -= 1
        self._silent -= tag in SILENT
        if kind:
            self._end_line()

    def _close(self, tags: frozenset[str], shields: frozenset[str], inline: bool = False) -> None:
        """Close the innermost open one of ``tags`` with all inside it, unless a shield lies between."""
        if not any(self._open[t] for t in tags):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.elements[self._stack[depth]][0]
            if tag in tags:
                while len(self._stack) > depth:
                    self._pop()
                return
            if tag in shields or inline and tag in BLOCK:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if self._open["head"] and tag not in IN_HEAD:
            self._close(frozenset(("head",)), frozenset())
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in BLOCK:
            self._end_line()
            if tag not in NO_P:
                self._close(frozenset("p"), SCOPE | {"button"})
            if tag in ENDS:
                self._close(*ENDS[tag])
        elif tag == "a":
            self._close(frozenset("a"), SCOPE)
        if tag not in VOID:
            self._push(tag, dict(attrs))

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCK:
            self._end_line()
        if tag in VOID:
            self.handle_data(" " if tag == "br" else "")
        elif tag in ("body", "html"):
            return  # what follows still belongs to the page
        elif tag in BLOCK or tag in SILENT:
            self._close(frozenset((tag,)), frozenset(("table",)) - {tag} if tag in TABLE else SCOPE - {tag})
        else:
            self._close(frozenset((tag,)), SCOPE, inline=True)

    # the parser's own methods: what the page's end cuts off is dropped, odd declarations are comments -------

    def _whole(self, end: int) -> int:
        return len(self.rawdata) if end < 0 else end

    def parse_starttag(self, i: int) -> int:
        return self._whole(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._whole(super().parse_endtag(i))

    def parse_pi(self, i: int) -> int:
        return self._whole(super().parse_pi(i))

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.rawdata.startswith(("<!-->", "<!--->"), i):
            return self.rawdata.index(">", i) + 1
        return self._whole(super().parse_comment(i, report))

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        return self._whole(self.rawdata.find(">", i + 2) + 1 or -1)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian's weighted means along the lines; beyond the ends nothing counts."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.square(np.arange(-reach, reach + 1)) / (2 * sigma * sigma))
    cut = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[cut] / np.convolve(np.ones(len(values)), kernel)[cut]


@dataclass
class Marked:
    """Lines of a page with what the method found of each."""

    lines: list[Line]
    ratio: np.ndarray
    smoothed: np.ndarray
    content: np.ndarray


def mark(html: str) -> Marked:
    """Which lines of a page are its article."""
    page = Page(html)
    lines, elements = page.lines, page.elements
    none = np.zeros(0)
    if not lines:
        return Marked([], none, none, none.astype(bool))

    cleared = [_APART + 1] * len(elements)  # kinds below it are no content
    for kind, names in ((_APART, "article"), (_NONE, "main")):
        for root in page.roots[names]:
            if elements[root][2] == _NONE:
                at = elements[root][1]
                while at and cleared[at] > kind:
                    cleared[at] = kind
                    at = elements[at][1]
    # a wrap is cleared by an article or main inside, what stands apart by a main only
    apart, root, container = [False] * len(elements), [-1] * len(elements), [0] * len(elements)
    found = {names: set(at) for names, at in page.roots.items()}
    for e, (tag, parent, kind) in enumerate(elements):
        if e:
            held = cleared[e]
            counts = kind == _WRAP and held > _APART or kind == _APART and held > _NONE
            apart[e] = apart[parent] or counts
        container[e] = e if tag in CONTAINER else container[parent]
    names = next((n for n in ("article", "main") if any(not apart[r] for r in found[n])), None)
    if names:
        for e, (_, parent, _) in enumerate(elements):
            root[e] = root[parent] if e and root[parent] >= 0 else e if e in found[names] else -1

    where = np.array([line.element for line in lines])
    open_ = ~np.array(apart)[where]
    if names:
        open_ &= np.array(root)[where] >= 0
    size = np.array([len(line.text) for line in lines])
    linked = np.array([line.linked for line in lines])
    ratio = np.where(open_, np.maximum(size - linked, 0) / np.maximum([line.tags for line in lines], 1), 0.0)
    smoothed = smooth(ratio)
    content = np.zeros(len(lines), bool)
    if open_.any():
        content = open_ & (smoothed >= min(LAMBDA * smoothed.std(), smoothed[open_].max()))
        if names:
            region = np.array(root)[where]
            content = open_ & np.isin(region, region[content])
        else:
            region = np.array(container)[where]
            clusters = np.flatnonzero(content)
            between = (np.arange(len(lines)) > clusters[0]) & (np.arange(len(lines)) < clusters[-1])
            content = open_ & (np.isin(region, region[content]) | between & (linked < LINKED * size))
    return Marked(lines, ratio, smoothed, content)


def main_text(html: str) -> str:
    """The article of a page: its blocks in page order, one a line; empty if there is none."""
    marked = mark(html)
    return "\n".join(line.text for line, kept in zip(marked.lines, marked.content) if kept)


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each page."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html.as_py()) for html in batch.column("html")]
            sizes = pa.array([len(text) for text in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), sizes],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return _rows(pages).mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars bigint")


def lines(pages: DataFrame) -> DataFrame:
    """Rows (page_id, line, text, ratio, smoothed, content): every line of every page with what decided on it."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, html in zip(batch.column("page_id"), batch.column("html")):
                found = mark(html.as_py())
                n = len(found.lines)
                columns = [
                    pa.array([page_id.as_py()] * n, batch.schema.field("page_id").type),
                    pa.array(np.arange(1, n + 1), pa.int64()),
                    pa.array([line.text for line in found.lines], pa.string()),
                    pa.array(found.ratio, pa.float64()),
                    pa.array(found.smoothed, pa.float64()),
                    pa.array(found.content, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "line", "text", "ratio", "smoothed", "content"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, line bigint, text string, ratio double, smoothed double, content boolean"
    return _rows(pages).mapInArrow(marked, schema)
