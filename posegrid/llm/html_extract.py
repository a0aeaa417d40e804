"""Main text of HTML pages by text-to-tag ratios.

The standard library's streaming parser gives events; every block-level tag ends a
line. A line's ratio is its characters over its tags. Ratios of all visible lines,
menus and footers too, are smoothed with a Gaussian, and lines above a threshold of
the page's own spread cluster as content. Each element then gains the characters of
the clustered lines in it and loses those of other lines: link text and the text of
page parts wholly, other text by a fifth.

Regions: all outermost article and main elements with a gain, if together they gain
at least half as much as the best element; so such tags are a hint, and one without
content (a teaser, say) is no region. Else the smallest element within the best that
gains nearly as much. All lines of the regions are returned, except those in menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, which
tags, roles and class or id names tell. Outside an article or main element,
unclustered lines that consist mostly of links go as well.

Defined results: null html and html without content give the empty text; character
references are decoded, also without a semicolon where HTML allows it; unclosed and
stray tags are accepted; body, text, or a tag that a head can't hold ends an open
head; `<br>` is white space; inline elements never cut a line, dropped ones neither;
a tag or comment that the page's end cuts off is ignored, `<![...>` is a comment;
`/>` closes svg and math and what stands in them, nothing else; a page of any length
is read whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed lists of HTML element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td template tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu audio video frameset".split())
#: Dropped elements whose text no reader sees; it makes no line.
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas select textarea audio video frameset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist note status".split())
#: Elements that a start tag of the same kind closes.
CLOSED_BY_OWN = frozenset("p li dt dd tr td th option".split())
#: Elements that hold one block of text, too small for a region.
SMALL = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th pre blockquote figcaption caption summary legend address".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"caption", "head", "html", "body", "legend", "option", "optgroup", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "template", "noscript"}
#: Elements of other vocabularies, in which `/>` closes.
FOREIGN = ("svg", "math")
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Class and id words of page parts that are no content.
_PARTS = (
    "ad|ads|advert|adverts|advertisement|advertising|adsense|adslot|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|menubar|topbar|breadcrumb|breadcrumbs|"
    "footer|masthead|sidebar|widget|related|recommended|share|sharing|social|cookie|cookies|consent|notice|notices|gdpr|popup|modal|newsletter|subscribe|signup|login|paywall|"
    "comment|comments|commentlist|disqus|respond|pagination|pager|searchbox|toolbar|teaser"
)
_HEADERS = "header|head|pageheader|siteheader|top"
_PART = re.compile(rf"(?:{_PARTS})(?:[-_]?\d+)?$|(?:{_PARTS})[-_]|.*[-_](?:{_PARTS})(?:[-_]?\d+)?$")
_HEADER = re.compile(rf"(?:site|page|main|top|global)?[-_]?(?:{_HEADERS})(?:[-_](?:bar|wrap|wrapper|inner|container))?$")
_NEGATED = re.compile(r"(?:no|has|with|without|hide|show|is)[-_]")
#: Smoothing reach and spread in lines, share of the spread that the threshold is, share of the best gain that a region must reach.
REACH, SIGMA, THRESHOLD, HOLDS = 3, 1.0, 0.5, 0.85
#: What unclustered text without links loses, and share of the best gain from which articles are the regions.
LOSS, HINT = 0.2, 0.5
_KERNEL = [math.exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]


def _is_part(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is a page part without content."""
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "header" and not in_article:
        return True
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id"):
            for word in value.lower().split():
                if _NEGATED.match(word):
                    continue
                if _PART.match(word) or (not in_article and tag != "article" and _HEADER.match(word)):
                    return True
    return False


@dataclass
class Line:
    """Text between two block-level tags, in the innermost block element; `part` if it stands in a page part without content."""

    text: str
    tags: int
    linked: int
    element: int
    part: bool


class _Lines(HTMLParser):
    """Lines and block elements of a page, which is fed in one piece."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents: list[int] = [-1]
        self.kinds: list[str] = [""]
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, inside an article
        self.open: Counter[str] = Counter()
        self.off = 0  # depth of the stack at which a dropped part began
        self.unseen = False  # whether that part is invisible
        self.text: tuple[list[str], list[str]] = ([], [])  # of content and of page parts
        self.linked = [0, 0]
        self.tags = 0

    def end_line(self) -> None:
        for part in (0, 1):
            text = " ".join("".join(self.text[part]).split())
            if text:
                self.lines.append(Line(text, self.tags, min(self.linked[part], len(text)), self.stack[-1][1], bool(part)))
                self.tags = 0
            self.text[part].clear()
            self.linked[part] = 0

    def pop(self, tag: str) -> None:
        """Close everything down to the innermost open `tag`."""
        while True:
            name = self.stack.pop()[0]
            self.open[name] -= 1
            if len(self.stack) < self.off:
                self.off = 0
            if name == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.open["head"] and (tag == "body" or self.stack[-1][0] == "head" and tag not in IN_HEAD):
            self.close_head()
        if tag in BLOCKS:
            self.end_line()
            if tag in CLOSED_BY_OWN and self.stack[-1][0] == tag:
                self.pop(tag)
            elif tag in ENDS_P and self.open["p"]:
                self.close_p()
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        inside = self.stack[-1][2] or tag in ("article", "main")
        element = self.stack[-1][1]
        if tag in BLOCKS:
            self.parents.append(element)
            self.kinds.append("" if self.off else tag)
            element = len(self.parents) - 1
        self.stack.append((tag, element, inside))
        self.open[tag] += 1
        if not self.off and _is_part(tag, attrs, inside and tag != "article"):
            self.off, self.unseen = len(self.stack), False
            self.kinds[element] = "" if tag in BLOCKS else self.kinds[element]
        if tag in UNSEEN and self.off == len(self.stack):
            self.unseen = True

    def close_head(self) -> None:
        while self.open["head"]:
            self.pop("head")

    def close_p(self) -> None:
        """A block ends an open paragraph, with all inline elements in it, unless another block stands between."""
        for name, _, _ in reversed(self.stack):
            if name == "p":
                self.pop("p")
                return
            if name in BLOCKS:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in FOREIGN or any(self.open[f] > 0 for f in FOREIGN):
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if self.open[tag] > 0:
            self.pop(tag)

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self.close_head()
        if self.off and self.unseen:
            return
        part = 1 if self.off else 0
        self.text[part].append(data)
        if self.open["a"]:
            self.linked[part] += len(data)

    # The whole page is there, so what the parser calls incomplete is cut off by the page's end.

    def _to_end(self, k: int) -> int:
        return k if k >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return self._to_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._to_end(super().parse_endtag(i))

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._to_end(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self._to_end(super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):
            return self._to_end(self.parse_bogus_comment(i))
        return self._to_end(super().parse_html_declaration(i))


def content_lines(ratios: list[float]) -> list[bool]:
    """Which lines cluster as content: their smoothed ratio exceeds a share of the page's spread."""
    n = len(ratios)
    smooth = []
    for i in range(n):
        total = weight = 0.0
        for k in range(max(0, i - REACH), min(n, i + REACH + 1)):
            w = _KERNEL[k - i + REACH]
            total += w * ratios[k]
            weight += w
        smooth.append(total / weight)
    mean = sum(smooth) / n if n else 0.0
    spread = math.sqrt(sum((s - mean) ** 2 for s in smooth) / n) if n else 0.0
    return [s >= THRESHOLD * spread for s in smooth]


def gains(page: _Lines, chosen: list[bool]) -> list[float]:
    """What each element gains by the clustered lines in it and loses by the others."""
    out = [0.0] * len(page.parents)
    for line, ok in zip(page.lines, chosen):
        n = len(line.text)
        if line.part:
            out[line.element] -= n
        elif ok:
            out[line.element] += n
        else:
            out[line.element] -= line.linked + LOSS * (n - line.linked)
    for e in range(len(out) - 1, 0, -1):  # an element's number exceeds its parent's
        out[page.parents[e]] += out[e]
    return out


def regions(page: _Lines, gain: list[float]) -> list[int]:
    """The elements of the content: the articles with a gain, or the smallest element that gains nearly as much as the best."""
    children: list[list[int]] = [[] for _ in gain]
    hinted = [False] * len(gain)
    outer = []
    for e in range(1, len(gain)):
        children[page.parents[e]].append(e)
        hinted[e] = hinted[page.parents[e]]
        if not hinted[e] and page.kinds[e] in ("article", "main"):
            hinted[e] = True
            if gain[e] > 0:
                outer.append(e)
    at = max(range(len(gain)), key=lambda e: (gain[e], e))
    if outer and sum(gain[e] for e in outer) >= HINT * gain[at]:
        return outer
    best = gain[at]
    while page.kinds[at] in SMALL:  # a line of text is no region by itself
        at = page.parents[at]
    while True:
        below = max(children[at], key=lambda e: gain[e], default=None)
        if below is None or gain[below] < HOLDS * best or page.kinds[below] in SMALL:
            return [at]
        at = below


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    if not any(not line.part for line in page.lines):
        return ""
    chosen = content_lines([len(line.text) / max(line.tags, 1) for line in page.lines])
    inside = [False] * len(page.parents)
    for e in regions(page, gains(page, chosen)):
        inside[e] = True
    sure = [False] * len(inside)
    for e in range(1, len(inside)):
        inside[e] |= inside[page.parents[e]]
        sure[e] = sure[page.parents[e]] or page.kinds[e] in ("article", "main")
    return "\n".join(x.text for x, ok in zip(page.lines, chosen) if inside[x.element] and not x.part and (sure[x.element] or ok or x.linked <= 0.6 * len(x.text)))


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h) for h in part.column(html).to_pylist()]
                cols = [part.column(key), part.column(url), pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return df.select(F.col(key).cast("long").alias(key), url, html).mapInArrow(run, "page_id long, url string, text string, n_chars long")
