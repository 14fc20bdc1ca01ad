"""Main text of web pages by line-block distribution.

Markup is stripped first: scripts, styles, comments and the containers of ``DROPPED`` (menus, page headers, footers,
sidebars, forms) and of class names or roles that say the same give no text; character references are decoded; each
block element and line break ends a line.  Then the line-block distribution: the text lengths of ``WINDOW``
consecutive lines are summed, a zone of text begins where the sum surges to ``SURGE`` characters and ends where it
dives below; text inside a zone stays, short lines included.  Text of links weighs nothing.  Where the page marks its
text with an article (or main) element, only the lines in the largest such element weigh, each as much as a surge,
so the zone is that element.  Zones with less than a third of the largest zone's text are boilerplate.

Defined results: null, empty and text-less pages give an empty text and 0 characters; pages are handled row by row;
other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import column, map_batches

WINDOW = 3
SURGE = 80
# Element names by their role.
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg math object select head canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button dialog menu fieldset label datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "br option caption".split()
)
ANCHOR = frozenset(("article", "main"))
HEADING = re.compile(r"h[1-6]$")
SAME_CLOSES = frozenset("li dt dd tr td th option p".split())
_WORDS = (
    "ads?|advert\\w*|adsense|adbox|banner|sponsor\\w*|promo\\w*|sidebar|side-bar|nav|navbar|navigation|menu|breadcrumbs?|"
    "pagination|pager|footer|site-header|page-header|masthead|topbar|comments?|commentlist|comment-list|respond|replies|"
    "cookies?|consent|gdpr|notice|notification|alert|newsletter|subscribe|signup|login|share|sharing|social|related|"
    "recommended|popup|modal|widget|toolbar|skip-link"
)
_CLASS = re.compile(rf"(?:{_WORDS})(?:[-_].*)?$|(?!(?:has|with|no|without|hide)[-_]).+[-_](?:{_WORDS})$")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _unwanted(name: str, attrs: str, anchored: bool) -> bool:
    """Whether an element's name, class, id, role or visibility keeps its text out."""
    if name in DROPPED or name == "header" and not anchored:
        return True
    if not attrs.strip() or name in ("html", "body", "article", "main"):
        hidden_only = name in ("article",) and attrs.strip()
        if not hidden_only:
            return False
    for m in _ATTR.finditer(attrs):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if kind in ("class", "id") and any(_CLASS.match(c) for c in value.split()):
            return True
        if kind == "role" and value in _ROLES or kind == "style" and _HIDDEN.search(value):
            return True
        if kind == "hidden" and name not in ("html", "body") or kind == "aria-hidden" and value == "true":
            return True
    return False


class Lines:
    """The text lines of a page: text, characters outside links, heading or not, number of the anchor element."""

    def __init__(self, page: str) -> None:
        self.lines: list[tuple[str, int, bool, int]] = []
        self.stack: list[tuple[str, bool, int]] = []  # name, opens an unwanted part, anchor opened
        self.open: Counter[str] = Counter()
        self.unwanted = self.links = self.anchors = self.anchor = 0
        self.heading = False
        self.held: list[str] = []
        self.linked = 0
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        if self.held:
            text = " ".join(html.unescape("".join(self.held)).split())
            if text:
                self.lines.append((text, max(0, len(text) - self.linked), self.heading, self.anchor))
            self.held, self.linked = [], 0

    def _text(self, text: str) -> None:
        if text and not self.unwanted:
            self.held.append(text)
            if self.links:
                self.linked += len(text)

    def _push(self, name: str, unwanted: bool) -> None:
        anchor = 0
        if name in ANCHOR and not unwanted and not self.unwanted and (not self.anchor or name == "article"):
            self.anchors += 1
            anchor, self.anchor = self.anchor or -1, self.anchors
        self.stack.append((name, unwanted, anchor))
        self.open[name] += 1
        self.unwanted += unwanted

    def _pop_to(self, name: str) -> None:
        while self.stack:
            top, unwanted, anchor = self.stack.pop()
            self.open[top] -= 1
            self.unwanted -= unwanted
            if anchor:
                self.anchor = max(anchor, 0)
            if top == name:
                return

    def _tag(self, closing: bool, name: str, attrs: str) -> None:
        if name in BLOCK:
            self._flush()
            self.heading = bool(HEADING.match(name)) and not closing
        if name == "a":
            self.links = 0 if closing else 1
        if closing:
            if self.open[name]:
                self._pop_to(name)
            return
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            return
        if name in BLOCK and name != "br" and self.stack and self.stack[-1][0] == "p":
            self._pop_to("p")
        if name in SAME_CLOSES and self.stack and self.stack[-1][0] == name:
            self._pop_to(name)
        unwanted = _unwanted(name, attrs, bool(self.anchor))
        if name in BLOCK or unwanted or self.unwanted:
            self._push(name, unwanted)

    def _read(self, page: str) -> None:
        at, tag = 0, _TAG
        while (start := page.find("<", at)) >= 0:
            self._text(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
                continue
            m = tag.match(page, start)
            if m is None and tag is _TAG and page[start + 1 : start + 2].isalpha():
                tag = _PLAIN_TAG  # a quote without its end: from here on tags end at the next ">"
                m = tag.match(page, start)
            if m is None:
                if page[start + 1 : start + 2] in ("!", "?", "/"):
                    end = page.find(">", start)
                    at = len(page) if end < 0 else end + 1
                elif page[start + 1 : start + 2].isalpha() and page.find(">", start) < 0:
                    at = len(page)  # a tag that the page's end cuts off
                else:
                    self._text("<")
                    at = start + 1
                continue
            name, at = m[2].lower(), m.end()
            if not m[1] and name in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                if end is None and name == "head":
                    continue
                at = len(page) if end is None else end.end()
                continue
            self._tag(bool(m[1]), name, m[3])
        self._text(page[at:])


def zones(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, last + 1) of the zones between a surge and a dive of the sliding sums.

    Every line inside a window that reaches ``surge`` (or the largest sum, if none does) belongs to a zone; lines
    without weight at its ends do not.
    """
    sums = [sum(weights[k : k + window]) for k in range(max(1, len(weights) - window + 1))]
    need = min(surge, max(sums, default=0))
    if need <= 0:
        return []
    out: list[list[int]] = []
    for k, s in enumerate(sums):
        if s >= need:
            if out and k <= out[-1][1]:
                out[-1][1] = min(k + window, len(weights))
            else:
                out.append([k, min(k + window, len(weights))])
    for z in out:
        while z[0] < z[1] and not weights[z[0]]:
            z[0] += 1
        while z[0] < z[1] and not weights[z[1] - 1]:
            z[1] -= 1
    return [(a, b) for a, b in out]


def main_text(page: str) -> str:
    """The main text of one page, its blocks joined by line feeds."""
    lines = Lines(page).lines
    if not lines:
        return ""
    sizes: Counter[int] = Counter()
    for text, _, _, anchor in lines:
        if anchor:
            sizes[anchor] += len(text)
    if sizes:
        best = max(sizes, key=lambda a: (sizes[a], -a))
        weights = [SURGE + len(text) if anchor == best else 0 for text, _, _, anchor in lines]
    else:
        weights = [own for _, own, _, _ in lines]
    found = zones(weights)
    if sizes:
        kept = [k for a, b in found for k in range(a, b) if weights[k]]
    else:
        mass = {z: sum(weights[z[0] : z[1]]) for z in found}
        kept = []
        for z in found:
            if 3 * mass[z] >= max(mass.values()):
                first = z[0]
                while first and lines[first - 1][2]:
                    first -= 1
                kept += range(first, z[1])
    return "\n".join(lines[k][0] for k in sorted(set(kept)))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    table = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(p) for p in column(batch, "html")]
        return {
            "page_id": column(batch, "page_id"),
            "url": column(batch, "url"),
            "text": texts,
            "n_chars": [len(t) for t in texts],
        }

    return map_batches(table, run, "page_id long, url string, text string, n_chars long")
