"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events into lines, one for each block of text. A line's ratio is its characters
outside links by its tags. The ratios are smoothed by a Gaussian; lines above the standard deviation of the smoothed
ratios are content, and the content lines choose the region: an article element that holds most of their text or,
without one, the innermost element that holds them all, grown outward while it meets no boilerplate. Before the first and after the last
content line, lines of low ratio that stand apart from the content go; so do lines that are links only. The short lines
within the region are text.

Tags and names of elements are evidence: what is inside a menu, advert, form or the like has the ratio 0. An element that
holds nearly the whole page is none of these, whatever its name: where nothing, or next to nothing, is left beside such
an element, the evidence on it is put aside.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML and of common page templates.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text of a page.
DROPPED = frozenset("head script style noscript template button select textarea iframe svg math object canvas audio video title".split())
#: Not the main text, unless nothing else is there.
BESIDE = frozenset("footer aside menu dialog".split())
#: Not the main text, unless it is next to all there is: these can be left open or wrap a page.
AROUND = frozenset("nav form".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall sidebar aside nav navbar navigation menu breadcrumb breadcrumbs toc footer header masthead topbar comment comments commentlist disqus respond reply replies related recommended recommendations share sharing social widget widgets pagination pager toolbar skip".split()
)
#: Hints that hold where they are most of a page, too.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: What follows a hint in the name of an element of that kind.
PARTS = frozenset("area bar block body box buttons col column container content form group holder icons inner item items link links list outer overlay panel section row slot top bottom left right wrap wrapper".split())
#: With one of these, a name tells how what is around the text is laid out.
LAYOUT = frozenset("has with no without layout".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OWNERSHIP = re.compile(r"(©|\(c\)\s|copyright\b)|.{0,80}\ball rights reserved\b", re.I)
SIGMA = 1.0
#: Beside a menu or form, or an element with a hint, with so many times the text, what is left is next to nothing.
NEXT_TO_NOTHING, NEXT_TO_HINT = 4, 40


class Page(HTMLParser):
    """Collects elements (tag, parent, why they are no main text) and lines (tags, pieces of text with their element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.why, self.last = [""], [0], [0], [0]  # element 0 holds all others
        self.stack: list[int] = [0]
        self.open: dict[str, int] = {}
        self.inside = self.links = 0
        self.lines: list[tuple[int, int, list[tuple[str, int, bool]]]] = []
        self.text: list[tuple[str, int, bool]] = []
        self.tags = 0
        self.block = [0]

    def end_line(self):
        if self.text:
            self.lines.append((self.tags, self.block[-1], self.text))
            self.text = []
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            if tag in ("p", "li", "dt", "dd", "tr") and self.open.get(tag):
                self.imply(tag)
        elif tag in ("br", "td", "th"):
            self.text.append((" ", self.stack[-1], False))
        self.tags += 1
        if tag in VOID:
            return
        n = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.why.append(self.reason(tag, attrs))
        self.last.append(n)
        self.stack.append(n)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.inside += tag in ("article", "main")
        self.links += tag == "a"
        if tag in BLOCKS:
            self.block.append(n)

    def reason(self, tag, attrs) -> int:
        """0: may be main text; 1, 2: not, unless next to nothing is left; 3: not, unless nothing is left; 4: never."""
        if tag in DROPPED:
            return 4
        if tag in BESIDE:
            return 3
        found = 1 if tag in AROUND or tag == "header" and not self.inside else 0
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true":
                return 4
            if k == "role" and v in ROLES:
                found = max(found, 2)
            elif k in ("class", "id") and v:
                for name in v.split():
                    if hint := hinted(name):
                        if hint != "header" or not self.inside:
                            found = max(found, 3 if hint in READERS else 2)
        return found

    def imply(self, tag):
        """A new paragraph or item ends the open one of the same list or section."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == tag:
                return self.cut(k)
            if self.tag[self.stack[k]] in BLOCKS:
                return None
        return None

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if not self.open.get(tag):
            return None
        for k in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[k]]
            if own == tag:
                return self.cut(k)
            if tag not in BLOCKS and own in BLOCKS:
                return None  # a stray inline end tag closes no block
        return None

    def cut(self, k):
        for n in self.stack[k:]:
            tag = self.tag[n]
            self.open[tag] -= 1
            self.inside -= tag in ("article", "main")
            self.links -= tag == "a"
            if tag in BLOCKS:
                self.block.pop()
            self.last[n] = len(self.tag) - 1
        del self.stack[k:]

    def handle_data(self, data):
        if self.tag[self.stack[-1]] not in ("script", "style"):
            self.text.append((data, self.stack[-1], self.links > 0))

    def unknown_decl(self, data):  # a CDATA section is no text of HTML
        pass


def hinted(name: str) -> str | None:
    """The hint in the name of an element: its last word, but for words like box or list."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
    if LAYOUT.intersection(words):
        return None
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    return words[-1] if words and words[-1] in HINTS else None


def parsed(html: str) -> Page:
    at = html.rfind("<")
    if at > html.rfind(">") and re.match(r"[a-zA-Z/!?]", html[at + 1 : at + 2] or "/"):
        html = html[:at]  # a tag that the page's end cuts is no text
    page = Page()
    for k in range(0, len(html), 1 << 16):
        page.feed(html[k : k + (1 << 16)])
    page.close()
    page.end_line()
    page.cut(1)
    page.last[0] = len(page.tag) - 1
    return page


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    r = int(np.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(ratios, r, mode="edge"), kernel / kernel.sum(), "valid") if len(ratios) else ratios


class Line:
    __slots__ = ("text", "linked", "tags", "block", "gone")

    def __init__(self, tags: int, block: int, pieces, gone: list[bool]):
        kept = [p for p in pieces if not gone[p[1]]]
        self.text = " ".join("".join(p[0] for p in kept).split())
        links = sum(len("".join(p[0].split())) for p in kept if p[2])
        self.linked = links >= 0.8 * len(self.text.replace(" ", "")) and links > 0
        self.gone = not self.text
        self.tags, self.block = tags, block

    def ratio(self) -> float:
        return 0.0 if self.gone or self.linked or OWNERSHIP.match(self.text) else len(self.text) / max(1, self.tags)


def gone_elements(page: Page) -> list[bool]:
    """For each element, whether it is no main text. Evidence that would leave next to nothing is put aside."""
    n = len(page.tag)
    size = [0] * n  # characters outside links in blocks of text, directly inside
    own = [0] * n  # those of them that are in no block inside
    for _, block, pieces in page.lines:
        for data, at, linked in pieces:
            if not linked and not data.isspace() and page.tag[block] != "li":
                size[at] += len(data)
                own[block] += len(data)
    why = page.why.copy()
    while True:
        top, gone, never, held, left = [0] * n, [False] * n, [False] * n, {}, 0
        for k in range(n):
            up = page.parent[k]
            top[k] = top[up] or (k if why[k] else 0)  # the outermost element with a reason, at or above
            gone[k] = bool(why[k]) or gone[up]
            never[k] = why[k] == 4 or never[up]
            if not gone[k]:
                left += size[k]
            elif not never[k]:
                held[top[k]] = held.get(top[k], 0) + size[k]
        less = lambda k, chars: (why[k] == 1 and chars > NEXT_TO_NOTHING * left) or (why[k] == 2 and chars > NEXT_TO_HINT * left) or not left  # noqa: E731, B023
        aside = [k for k, chars in held.items() if chars > own[k] and less(k, chars)]
        if not aside:
            return gone
        why[max(aside, key=lambda k: (-why[k], held[k], -k))] = 0  # noqa: B023


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by a line feed; empty if there is none."""
    if not html:
        return ""
    page = parsed(html)
    gone = gone_elements(page)
    lines = [Line(*x, gone) for x in page.lines]
    own = [x for x in lines if not x.gone]
    ratio = np.array([x.ratio() for x in lines])
    if not own:
        return ""
    smooth = smoothed(ratio)
    high = (smooth >= smooth.std()) & (ratio > 0)
    content = [x for x, h in zip(lines, high, strict=True) if h] or own
    # characters of content, and content lines, in each element
    mass, count = [0] * len(page.tag), [0] * len(page.tag)
    for x in content:
        mass[x.block] += len(x.text)
        count[x.block] += 1
    noisy = gone.copy()
    for k in range(len(page.tag) - 1, 0, -1):
        mass[page.parent[k]] += mass[k]
        count[page.parent[k]] += count[k]
        noisy[page.parent[k]] |= noisy[k] and page.why[k] != 4
    holds = lambda k, x: k <= x.block <= page.last[k]
    for kind in ("article", "main"):
        at = [k for k, t in enumerate(page.tag) if t == kind and not gone[k] and any(holds(k, x) for x in own)]
        if at:
            region = max(at, key=lambda k: (mass[k], -k))
            while (outer := next((k for k in at if k < region <= page.last[k]), None)) is not None:
                region = outer
            if 2 * mass[region] >= mass[0]:  # else the content is elsewhere, and these are teasers
                return "\n".join(x.text for x in own if holds(region, x))
    inner = region = max(k for k, c in enumerate(count) if c == len(content))  # the innermost element of all content lines
    while region and (page.tag[region] not in BLOCKS or page.tag[region] in ("p", "li", "tr") or not noisy[page.parent[region]]):
        region = page.parent[region]
    beside = page.parent[region] if region and page.tag[region] not in ("body", "html") else region
    # a heading or a short block right beside the region belongs to it
    near = [x for x in own if holds(region, x) or page.parent[x.block] == beside or x.block == beside]
    chosen = {id(x) for x in content}
    ends = [i for i, x in enumerate(near) if id(x) in chosen] or [0, len(near) - 1]
    around = {page.parent[x.block] for x in content}

    def fits(i: int, x: Line) -> bool:
        if not x.ratio():  # within the content, a paragraph or item can be one link
            return x.linked and page.tag[x.block] in ("p", "li") and ends[0] <= i <= ends[-1]
        return ends[0] <= i <= ends[-1] or page.tag[x.block] in HEADINGS or page.parent[x.block] in around or page.tag[inner] not in ("", "html", "body") and holds(inner, x)

    return "\n".join(x.text for i, x in enumerate(near) if fits(i, x)) or "\n".join(x.text for x in own)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of each row of pages, from its whole html.

    A null or empty html gives an empty text; null ids and urls and repeated rows stay; other columns are dropped.
    """
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
