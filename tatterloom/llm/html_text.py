"""Main text of HTML pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

A page runs through the standard library's parser as a stream of events. Each block of text (a paragraph, heading,
list item, cell ...) is a line, with the number of its tags and the elements that it stands in. Lines in elements that
are never main text (menus, adverts, forms, comments ..., by tag, role, class or id) have ratio 0. The ratios of text
length to tags are smoothed with a Gaussian over neighbouring lines, and those above a threshold, a share of their
standard deviation, are the content cluster. The content region is the deepest element that holds (nearly) all of the
cluster's text, or the article and main elements that hold a part of it; its lines outside the excluded elements are the page's text, so a
short paragraph or a heading inside the region isn't lost to its low ratio.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tatterloom.llm.common import spread, whole

SIGMA, RADIUS, THRESHOLD, HOLDS, PART = 1.0, 2, 0.25, 0.99, 0.1

#: Tags whose text is never shown or never main text (fixed values).
DROPPED = frozenset("script style noscript template head title iframe object svg annotation annotation-xml canvas audio video map nav aside footer menu dialog select option datalist button textarea input label form".split())
MATHS = frozenset("math semantics mrow mi mo mn ms mtext msup msub msubsup mmultiscripts mfrac msqrt mroot mover munder munderover mfenced menclose mstyle mpadded mspace mtable mtr mtd".split())
INLINE = MATHS | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark what isn't main text (fixed values).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing adsbygoogle related recommended recommendations widget toolbar pagination pager copyright legal disclaimer search skip tags taboola outbrain".split()
)
COMMENTS = frozenset("comment comments commentlist replies reply respond discussion disqus reader".split())
HEADS = frozenset("header topbar".split())
CONTAINERS = frozenset("div section td center details figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may stand within a block without ending it.
SILENT = frozenset("script style noscript template select datalist button textarea input label object svg annotation annotation-xml canvas audio video map iframe".split())
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Lines(HTMLParser):
    """Collects the lines of a page: text pieces, tags, the element around, and whether it is excluded.

    Elements are numbered as they open and know the one around them, so time and space are linear in the page at any
    depth of nesting.
    """

    def __init__(self, keep_forms: bool = False):
        super().__init__(convert_charrefs=True)
        self.keep_forms = keep_forms
        self.stack: list[tuple[str, int, str, bool]] = []  # tag, element, why it is excluded, whether it stands within a block
        self.open: Counter[str] = Counter()  # open elements by tag
        self.why: Counter[str] = Counter()  # open excluded elements by reason
        self.out = self.quiet = 0  # open excluded elements, and those within a block
        self.elements: list[str] = []
        self.around: list[int] = []  # each element's parent, -1 at the top
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, element, excluded
        self.pieces: list[str] = []
        self.tags = 0

    def _reason(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in ("html", "body"):
            return ""
        names = set()
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and _HIDDEN.search(v.lower()):
                return "hidden"
            if k in ("class", "id") and v:
                names.update(_NAME.findall(v.lower()))
            if k == "role" and v in ROLES and tag not in ("article", "main"):
                return "role"
        if names & COMMENTS:
            return "comments"
        if tag in ("article", "main"):
            return ""
        if tag in DROPPED and not (self.keep_forms and tag == "form"):
            return tag
        if tag == "header" or names & HEADS:
            return "" if self.open["article"] + self.open["main"] and not names & MARKS else "header"
        return "marks" if names & MARKS else ""

    def _end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1][1] if self.stack else -1, self.out > 0))
            self.tags = 0
        self.pieces = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br" and not self.out:
            self.pieces.append(" ")
        if tag in VOID or tag in INLINE and not (attrs and self._reason(tag, attrs)):
            if tag == "hr" and not self.quiet:
                self._end_line()
            return
        if tag in ("article", "main"):
            while self.quiet:  # left open: no such element stands within a block
                self._pop()
        within = tag in INLINE or tag in SILENT or self.quiet > 0
        if not within:
            self._end_line()
            self._implied(tag)
        reason = self._reason(tag, attrs)
        if tag in ("article", "main") and not reason and self.out and not any(self.why[r] for r in ("comments", "hidden", "aside")):
            while self.stack and self.out:  # an element that was left open, or wraps the page
                self._pop()
        self.around.append(self.stack[-1][1] if self.stack else -1)
        self.stack.append((tag, len(self.elements), reason, within))
        self.elements.append(tag)
        self.open[tag] += 1
        if reason:
            self.out += 1
            self.why[reason] += 1
            self.quiet += within

    def _implied(self, tag: str) -> None:
        """Closes what an opening tag closes by itself."""
        top = self.stack[-1][0] if self.stack else ""
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        while top == "p" or top in same or tag == "body" and top == "head":
            self._pop()
            top = self.stack[-1][0] if self.stack else ""

    def _pop(self) -> None:
        tag, _, reason, within = self.stack.pop()
        self.open[tag] -= 1
        if reason:
            self.out -= 1
            self.why[reason] -= 1
            self.quiet -= within

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        block = tag not in INLINE and tag not in SILENT
        if not self.open[tag]:
            if block and not self.quiet:
                self._end_line()
            return
        if block:
            while self.quiet and self.stack[-1][0] != tag:  # elements within the block that it closes
                self._pop()
            if not self.quiet:
                self._end_line()
        while self.stack[-1][0] != tag:
            if not block and tag in INLINE and self.stack[-1][0] not in INLINE:
                return
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.pieces.append(data)
        elif not self.quiet and not self.pieces and data.strip():
            self.pieces.append("\0")  # an excluded line; its text isn't needed

    def close(self) -> None:
        super().close()
        self._end_line()


def _smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    return np.convolve(ratio, kernel / kernel.sum(), "same") if len(ratio) > 2 * RADIUS else ratio


def _region(lines: Lines) -> list[str]:
    rows = lines.lines
    kept = np.array([not out for *_, out in rows], bool)
    if not kept.any():
        return []
    size = np.array([len(t) for t, *_ in rows], float) * kept
    smooth = _smoothed(size / np.array([max(1, n) for _, n, *_ in rows])) * kept
    content = kept & (smooth >= THRESHOLD * smooth.std())
    held = np.zeros(len(lines.elements))
    for k in np.flatnonzero(content):
        if rows[k][2] >= 0:
            held[rows[k][2]] += size[k]
    for e in range(len(held) - 1, -1, -1):  # an element opens after the one around it
        if lines.around[e] >= 0:
            held[lines.around[e]] += held[e]
    total = float(size[content].sum())
    named = [e for e in np.flatnonzero(held >= PART * total).tolist() if lines.elements[e] in ("article", "main")]
    most = [e for e in np.flatnonzero(held >= HOLDS * total).tolist() if (lines.elements[e] in ("article", "main") if named else lines.elements[e] in CONTAINERS)]
    chosen = {max(most)} if most else set(named)  # the last to open of those around nearly all text is the deepest
    if chosen:
        within = np.zeros(len(held) + 1, bool)  # the last one stands for no element
        for e, parent in enumerate(lines.around):
            within[e] = e in chosen or within[parent]
        inside = [k for k, (_, _, e, out) in enumerate(rows) if not out and within[e]]
        return [rows[k][0] for k in _title(lines, inside) + inside]
    first, last = np.flatnonzero(content)[[0, -1]].tolist()  # text straight in the body: from its first line to its last
    while first and kept[first - 1] and rows[first - 1][2] >= 0 and lines.elements[rows[first - 1][2]] in HEADINGS:
        first -= 1
    return [t for t, _, _, out in rows[first : last + 1] if not out]


def _title(lines: Lines, inside: list[int]) -> list[int]:
    """The top headings right before a region that has none of its own."""
    rows = lines.lines
    top = lambda k: rows[k][2] >= 0 and lines.elements[rows[k][2]] == "h1"
    found: list[int] = []
    if not any(map(top, inside)):
        for k in range(inside[0] - 1, -1, -1):
            if rows[k][3]:
                continue
            if not top(k):
                break
            found.insert(0, k)
    return found


def main_text(html: str | None) -> str:
    """The page's main text: blocks joined by two line feeds; empty if there is none, also for null."""
    html = html or ""
    cut = html.rfind("<")
    if cut > html.rfind(">") and (html[cut + 1 : cut + 2].isalpha() or html[cut + 1 : cut + 2] in ("/", "!")):
        html = html[:cut]  # a tag that the page's end cuts off
    for keep_forms in (False, True):  # a form may wrap the whole page
        lines = Lines(keep_forms)
        lines.feed(html)
        lines.close()
        found = _region(lines)
        if found or "form" not in lines.elements:
            break
    return "\n\n".join(found)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): a row per row of pages.

    Null html counts as empty; a page without main text has an empty one. Whole pages are read, and white space
    within a block becomes one space. Repeated rows give repeated rows, an empty table an empty result; of elements
    that hold the same share of the text the one that opens last is taken. Other columns aren't read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return spread(rows).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
