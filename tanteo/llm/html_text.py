"""HTML extraction with site template removal.

A page is read once, inside a task, into text blocks; each block knows the element subtrees around it that could be site template,
by their hashes. Spark counts in how many different pages of a host each subtree stands and deletes subtrees that recur. A box (div,
section and so on) is template in ``MIN_PAGES`` different pages, however many the host has, and so is a paragraph, heading, list or
other text block of ``LONG`` words or more. Shorter text blocks ("Yes.", "Summary") recur by chance where pages are many: they must
stand in ``MIN_SHARE`` of the host's different pages as well. On a small host, either is template in ``FEW_PAGES`` different pages
that are ``MOST`` of the host's. Pages with the same text count once, so copies of one article on a host do not turn it into template.

What can never be article text is dropped while reading: scripts, styles, menus, headers and footers of the page, sidebars,
controls. A form, and an element whose class or id says notice, advert, menu and so on, is dropped when the page is read: not if it
is what the page is about, holding the ``main`` element or most of the page's words and all of its article (a form: any article). A
class says so by a whole name, or one whose every part does ("cookie-banner"; not "no-sidebar", "social-history"), unless another
class of the element says content. Reader comments are always dropped. A page with an ``article`` or ``main`` element keeps only
what is inside the outermost ones; there, items, rows and cells are counted only as parts of their list or table.

Character references are decoded, white space in a block becomes one blank, blocks stand in page order, joined by a newline;
a ``br`` is white space. Unclosed and wrongly nested elements are read as browsers read them, as far as blocks are concerned; a
page cut off in the middle yields what it has. Time grows with the length of a page, however deep its elements are nested.

A null or empty page has an empty text. Repeated rows stay and are one page in the counts. A null URL has the empty host. Only
the id, URL and HTML columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tanteo.llm.store import stored
from tanteo.llm.text import chunks

MIN_PAGES, MIN_SHARE = 10, 0.2
FEW_PAGES, MOST = 3, 0.5
LONG = 8
#: Template subtrees sent to every task at once (8 bytes each); where there are more, each page is joined to its own.
MAX_SENT = 4_000_000

_DROPPED = {
    "script", "style", "noscript", "template", "nav", "aside", "head", "title", "menu", "dialog", "button", "select", "textarea",
    "iframe", "object", "embed", "svg", "canvas", "audio", "video", "map", "datalist", "input",
}
#: Page furniture outside an article; inside one, a header holds the title.
_FRAME = {"header", "footer"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
_MAIN = {"article", "main"}
_BOXES = {"div", "section", "figure", "details", "fieldset", "center", "blockquote", "address"}
#: Parts of class names and ids that mark what is not article text; those that say comments; those that say nothing by themselves; and
#: names that say content.
_LABELS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside widget footer masthead share sharing social related recommended recommendations pagination pager toolbar skip "
    "search".split()
)
_COMMENTS = frozenset("comment comments commentlist respond replies reply disqus".split())
_NEUTRAL = frozenset("list box bar wrap wrapper container area buttons links posts left right top bottom inner section block form".split())
_CONTENT = frozenset("content article post entry story main body text".split())
_PARTED = re.compile(r"[-_]+")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Parts of a list or table: without one of them, an article's table would say something else.
_PARTS = {"li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup", "figcaption", "legend", "summary", "optgroup", "option"}
#: Elements that end an open paragraph.
_ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_SPACE = re.compile(r"\s+")
_COMMENT_END = re.compile(r"--!?>")
_HOST = re.compile(r"[^/]*//([^/?#]*)")


def _label(names: str) -> str:
    """What a class and id say: comments, aside, or nothing (empty)."""
    found = ""
    for name in names.lower().split():
        if name in _CONTENT:
            return ""
        parts = set(filter(None, _PARTED.split(name))) - _NEUTRAL
        if parts and parts <= _COMMENTS:
            found = "comments"
        elif parts and parts <= _LABELS | _COMMENTS and not found:
            found = "aside"
    return found


class _Reader(HTMLParser):
    """Collects blocks (text, inside an article, box, doubtful element) and boxes and doubtful elements as trees: each knows the one
    around it. A box is hashed once, when it closes, from its own tags and words and the hashes of the boxes in it."""

    #: Their content is text up to the end tag, as in browsers.
    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int, int]] = []  # tag, dropped, article, innermost box and doubtful element (-1: none)
        self.count: dict[str, int] = {}
        self.box_parent: list[int] = []
        self.box_hash: list[int] = []
        self.box_words: list[int] = []
        self.hashing: dict[int, xxhash.xxh3_64] = {}
        self.doubt_parent: list[int] = []
        self.doubt_kind: list[str] = []
        self.doubt_main: list[bool] = []
        self.blocks: list[tuple[str, bool, int, int]] = []
        self.text: list[str] = []

    def _at(self) -> tuple[str, bool, bool, int, int]:
        return self.open[-1] if self.open else ("", False, False, -1, -1)

    def _flush(self) -> None:
        if not self.text:
            return
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if text:
            _, _, article, box, doubt = self._at()
            self.blocks.append((text, article, box, doubt))
            if box >= 0:
                self.box_words[box] += text.count(" ") + 1

    def _note(self, what: str | bytes) -> None:
        box = self._at()[3]
        if box >= 0:
            self.hashing[box].update(what)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """Where the comment at ``i`` ends; one that never ends hides the rest of the page, which is fed as a whole."""
        for whole in ("<!-->", "<!--->"):
            if self.rawdata.startswith(whole, i):
                return i + len(whole)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P:
            self._close_open("p", {"button", "td", "th", "table", "li"} | _BOXES | _MAIN)
        if tag in _SIBLINGS:
            for sibling in _SIBLINGS[tag]:
                self._close_open(sibling, _LIMITS[tag])
        if tag not in _INLINE:
            self._flush()
        if tag == "br":
            self.text.append(" ")
        _, dropped, article, box, doubt = self._at()
        kind = ""
        if not dropped:
            named = dict(attrs)
            dropped = (
                tag in _DROPPED or (tag in _FRAME and not article) or (tag == "footer")
                or (named.get("role") or "").lower() in _ROLES or "hidden" in named or (named.get("aria-hidden") or "") == "true"
            )
            if not dropped and tag not in ("html", "body", *_MAIN):
                kind = _label(f"{named.get('class') or ''} {named.get('id') or ''}") or ("form" if tag == "form" else "")
            article = article or (tag in _MAIN and not dropped)
        if tag in _VOID:
            return
        self._note(f"<{tag}>")
        if tag == "main" or tag == "article":
            # what is around it learns of it when the page has been read
            if doubt >= 0 and not dropped and (tag == "main" or self.doubt_kind[doubt] == "form"):
                self.doubt_main[doubt] = True
        if kind:
            self.doubt_parent.append(doubt)
            self.doubt_kind.append(kind)
            self.doubt_main.append(False)
            doubt = len(self.doubt_parent) - 1
        if not dropped and tag not in ("html", "body", *_MAIN) and tag not in _INLINE and not (article and tag in _PARTS):
            self.box_parent.append(box)
            self.box_hash.append(int(tag not in _BOXES))
            self.box_words.append(0)
            box = len(self.box_parent) - 1
            self.hashing[box] = xxhash.xxh3_64(tag)
        self.open.append((tag, dropped, article, box, doubt))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self._flush()
        if tag not in _VOID:
            self._close_open(tag, {"body", "html"} if tag in ("html", "body") else {"table"} if tag in ("td", "tr", "th") else set())

    def _close_open(self, tag: str, limits: set[str]) -> None:
        """Close the innermost open ``tag`` and what is open inside it, unless one of ``limits`` stands between."""
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag not in _INLINE:
                    self._flush()
                # an unclosed inline element goes on in the next block; only its mark-up is lost
                self._pop(i)
                return
            if self.open[i][0] in limits:
                return

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            tag, _, _, box, _ = self.open.pop()
            self.count[tag] -= 1
            if box in self.hashing and self._at()[3] != box:
                digest = self.hashing.pop(box).intdigest()
                short_text = self.box_hash[box] and self.box_words[box] < LONG
                # the lowest bit: a short text block, which recurs by chance
                self.box_hash[box] = digest & ~1 | bool(short_text)
                parent = self.box_parent[box]
                if parent >= 0:
                    self.hashing[parent].update(digest.to_bytes(8, "little"))
                    self.box_words[parent] += self.box_words[box]

    def handle_data(self, data: str) -> None:
        if self._at()[1]:
            return
        self.text.append(data)
        words = _SPACE.sub(" ", data)
        if words.strip():
            self._note(words)

    def finish(self) -> Page:
        self.close()
        self._flush()
        self._pop(0)
        n = len(self.doubt_parent)
        words, in_article, main = [0] * n, [0] * n, self.doubt_main
        total = article_total = 0
        for text, article, _, doubt in self.blocks:
            size = text.count(" ") + 1
            total += size
            article_total += size * article
            if doubt >= 0:
                words[doubt] += size
                in_article[doubt] += size * article
        # an element lies behind the one around it: sums go up from the end, decisions down from the front
        for i in range(n - 1, -1, -1):
            up = self.doubt_parent[i]
            if up >= 0:
                words[up] += words[i]
                in_article[up] += in_article[i]
                main[up] = main[up] or (main[i] and (self.doubt_kind[up] == "form" or self.doubt_kind[i] != "form"))
        gone = [False] * n
        for i, (up, kind) in enumerate(zip(self.doubt_parent, self.doubt_kind, strict=True)):
            most = 2 * words[i] > total and in_article[i] == article_total
            gone[i] = (up >= 0 and gone[up]) or kind == "comments" or not (main[i] or most)
        kept = [(t, article, box) for t, article, box, doubt in self.blocks if doubt < 0 or not gone[doubt]]
        inside = any(article for _, article, _ in kept)
        kept = [(t, box) for t, article, box in kept if article or not inside]
        return Page([t for t, _ in kept], [box for _, box in kept], self.box_parent, self.box_hash)


class Page(NamedTuple):
    """Texts of the blocks that count, the innermost box of each (-1: none), and each box's parent and hash; parents come first."""

    texts: list[str]
    boxes: list[int]
    parents: list[int]
    hashes: list[int]


def read(html: str | None) -> Page:
    reader = _Reader()
    reader.feed(html or "")
    return reader.finish()


def _needed(page: Page) -> tuple[list[int], list[int], list[int]]:
    """The boxes around the blocks that count, numbered anew: box of each block, parents, hashes."""
    number: dict[int, int] = {}
    for box in page.boxes:
        while box >= 0 and box not in number:
            number[box] = -1
            box = page.parents[box]
    order = sorted(number)
    number = {box: i for i, box in enumerate(order)} | {-1: -1}
    return [number[b] for b in page.boxes], [number[page.parents[b]] for b in order], [page.hashes[b] for b in order]


def _signed(value: int) -> int:
    return value - (1 << 63)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, page, texts, at, parents, boxes): each page read; ``host`` and ``page`` are digests of the host and the text,
    ``boxes`` the hashes of its subtrees together with its host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                rows: list[tuple] = []
                for url, html in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    found = read(html)
                    at, parents, hashes = _needed(found)
                    host = xxhash.xxh3_64_intdigest(host_of(url))
                    # the host is part of a box's hash, its lowest bit stays
                    boxes = [_signed(xxhash.xxh3_64_intdigest(h.to_bytes(8, "little"), host) & ~1 | h & 1) for h in hashes]
                    rows.append((_signed(host), _signed(xxhash.xxh3_64_intdigest("\n".join(found.texts))), found.texts, at, parents, boxes))
                columns = [list(c) for c in zip(*rows, strict=True)]
                types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                    names=["page_id", "url", "host", "page", "texts", "at", "parents", "boxes"])

    kind = pages.schema["page_id"].dataType.simpleString()
    columns = "host bigint, page bigint, texts array<string>, at array<int>, parents array<int>, boxes array<bigint>"
    return pages.mapInArrow(run, f"page_id {kind}, url string, {columns}")


def _template(rows: DataFrame) -> DataFrame:
    """(box): the subtrees of all hosts that are template. Only numbers are shuffled."""
    # one page for each different text of a host, without its text
    first = rows.groupBy("host", "page").agg(F.min("row").alias("row"))
    sizes = first.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = rows.where(F.size("boxes") > 0).select("row", "host", F.array_distinct("boxes").alias("boxes"))
    seen = held.join(first.select("row"), "row", "left_semi").select("host", F.explode("boxes").alias("box"))
    # a box's hash holds its host: the least host digest is that of all
    often = seen.groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.min("host").alias("host")).where(F.col("n") >= FEW_PAGES)
    long = F.col("box").bitwiseAND(F.lit(1)) == 0
    recurring = (F.col("n") >= MIN_PAGES) & (long | (F.col("n") >= MIN_SHARE * F.col("pages")))
    return often.join(sizes, "host").where(recurring | (F.col("n") >= MOST * F.col("pages"))).select("box")


def _without(texts: list[str], at: list[int], parents: list[int], boxes: list[int], template: np.ndarray) -> str:
    """The text of a page without the blocks that a template subtree holds; ``template`` says which boxes are one."""
    if not template.any():
        return "\n".join(texts)
    gone = template.tolist()
    for i, up in enumerate(parents):
        gone[i] = gone[i] or (up >= 0 and gone[up])
    return "\n".join(t for t, box in zip(texts, at, strict=True) if box < 0 or not gone[box])


def _cleaned(rows: DataFrame, sent: Broadcast | None) -> DataFrame:
    """(page_id, url, text); template subtrees are those ``sent``, or each page's own in the column ``template``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("texts", "at", "parents", "boxes")]
            flat = batch.column("boxes").flatten().to_numpy(zero_copy_only=False)
            if sent is None:
                own = [set(t or ()) for t in batch.column("template").to_pylist()]
                marks = [np.fromiter((b in t for b in boxes), bool, len(boxes)) for boxes, t in zip(lists[3], own, strict=True)]
            else:
                known = sent.value
                place = np.searchsorted(known, flat)
                found = known[np.minimum(place, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
                marks = np.split(found, np.cumsum([len(b) for b in lists[3]])[:-1]) if len(lists[3]) else []
            texts = [_without(*row) for row in zip(*lists, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", max_sent: int = MAX_SENT) -> DataFrame:
    """(page_id, url, text) of every page."""
    given = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    # numbered when written: every later step reads the same numbers
    rows = stored(_pages(given).withColumn("row", F.monotonically_increasing_id()))
    template = stored(_template(rows))
    if template.count() <= max_sent:
        known = np.sort(np.fromiter((r[0] for r in template.toLocalIterator()), np.int64))
        return _cleaned(rows.drop("row", "host", "page"), pages.sparkSession.sparkContext.broadcast(known))
    own = rows.select("row", F.explode(F.array_distinct("boxes")).alias("box")).join(template, "box").groupBy("row").agg(F.collect_list("box").alias("template"))
    return _cleaned(rows.join(own, "row", "left").drop("row", "host", "page"), None)
