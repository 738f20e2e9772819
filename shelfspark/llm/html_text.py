"""Main text of html by line-block distribution.

Markup is stripped into lines, one per block element, in stretches: within ``article`` or ``main``, outside these, and of
each element that its name, class, id or role tells for a menu, header, footer, sidebar, notice, advert or comments.
A line weighs as many characters as it has outside links, times the weight of its stretch: much within an article,
little outside one on a page that has one, next to nothing in such an element. Weights are summed over sliding windows of
lines; text surges where a window rises over the threshold and dives where it falls back to nothing. All lines
between a surge and its dive are kept, in page order. If no window of the page surges, the heaviest run of lines is. So
what an element is called decides nothing by itself: a page without marks is read by its distribution alone, a long
text outside a short article surges, and an article that stands in a wrongly named element is the heaviest run.
Scripts, styles, forms and the like hold no text of the page at all.

Defined results: null or empty html gives an empty text; html cut off anywhere gives the text so far; bytes that
look like markup but never close are dropped with what follows. Repeated rows give equal texts, an empty table no
rows. Pages are read whole, in time linear in their length, in batches bounded by bytes. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.cut import bounded_batches

WINDOW = 5
#: What a window of lines must weigh to surge.
SURGE = 50
#: Weight of a character within an article, outside one on a page that has one, and in an element named like noise.
INSIDE, OUTSIDE, NOISY = 200.0, 0.02, 0.005
#: Elements without content of their own, elements whose content is no text of the page, and blocks: fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("form noscript iframe svg button select option template object canvas dialog label head".split())
RAW = ("script", "style", "textarea", "title", "noscript", "xmp")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element of the key ends an open one of the value, as HTML lets their end tags be left out: fixed values.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that are no article; header is one of them outside of an article: fixed values.
APART = frozenset("nav footer aside menu".split())
#: Words of a class, id or role that mark what is no article wherever they stand in it, those that do if all other words
#: of the name only say where or how it stands, and these others: fixed values.
LOUD = frozenset(
    "advert adverts advertisement advertising adsense sponsored breadcrumb breadcrumbs navbar navigation sidebar cookie cookies gdpr newsletter"
    " comment comments commentlist disqus pagination masthead complementary contentinfo".split()
)
NAMED = frozenset(
    "ad ads sponsor promo promotion banner menu menubar nav header footer aside notice notices consent alert disclaimer popup modal overlay subscribe signup"
    " login share sharing social related recommended reply replies respond form search pager toolbar widget".split()
)
PLACED = frozenset(
    "site page global top bottom left right upper lower primary secondary main sub inner outer wrap wrapper container box block area section bar list item items"
    " links link group panel row col column holder fixed sticky mobile desktop the my js is text content wide narrow first last".split()
)
NEVER = frozenset("html body article main".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {name: re.compile(rf"</{name}\s*[^>]*(?:>|\Z)", re.I) for name in RAW}
OPENING = re.compile(r"</?[a-zA-Z!]")


def loud(name: str) -> bool:
    """Whether a class, id or role names what is no article: ``site-header`` does, ``article-header`` doesn't."""
    words = [w.lower() for w in WORD.findall(name)]
    return any(w in LOUD for w in words) or any(w in NAMED for w in words) and all(w in NAMED or w in PLACED for w in words)


def noisy(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is named like noise; inside: it is in ``article`` or ``main``."""
    if name in NEVER:
        return False
    if name in APART or name == "header" and not inside:
        return True
    return "=" in attributes and any(loud(w) for m in ATTRIBUTE.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split())


class Line(NamedTuple):
    """A block's text, the characters of it within links, and where it stands: ``kind`` in, out or noise, ``stretch`` its number."""

    text: str
    linked: int
    kind: str
    stretch: int


class _Lines:
    """Lines of a page while it is read."""

    def __init__(self):
        self.out: list[Line] = []
        self.text: list[str] = []  # of the block that is open
        self.linked = 0
        self.aside: list[str] = []  # of the noise that is open
        self.aside_linked = 0
        self.stack: list[tuple[str, bool, bool]] = []  # open elements, and whether noise or a dropped part starts there
        self.where: defaultdict[str, list[int]] = defaultdict(list)  # places of open elements in the stack
        self.noise = self.dropped = self.inside = self.links = self.stretch = self.noises = 0

    def flush(self, opening: bool) -> None:
        line = " ".join(entities.unescape("".join(self.text)).split()) if self.text else ""
        if line or opening:  # a block that opens upon nothing is a gap of one line
            self.out.append(Line(line, self.linked, "in" if self.inside else "out", self.stretch))
        self.text.clear()
        self.linked = 0
        if self.aside:
            line = " ".join(entities.unescape("".join(self.aside)).split())
            if line:
                self.out.append(Line(line, self.aside_linked, "noise", self.noises))
            self.aside.clear()
            self.aside_linked = 0

    def put(self, piece: str) -> None:
        if self.dropped:
            return
        if self.noise:
            self.aside.append(piece)
            self.aside_linked += len(piece) if self.links else 0
        else:
            self.text.append(piece)
            self.linked += len(piece) if self.links else 0

    def open(self, name: str, attributes: str) -> None:
        noise, dropped = noisy(name, attributes, self.inside > 0), name in DROPPED
        self.where[name].append(len(self.stack))
        self.stack.append((name, noise, dropped))
        if noise and not self.noise:
            self.noises += 1
        self.noise += noise
        self.dropped += dropped
        self.links += name == "a"
        if name in ("article", "main"):
            self.inside += 1
            self.stretch += 1

    def close(self, depth: int) -> None:
        """Closes the open elements from ``depth`` on; what ended with noise is a stretch of its own."""
        while len(self.stack) > depth:
            name, noise, dropped = self.stack.pop()
            self.where[name].pop()
            if noise and self.noise == 1 and self.aside:
                line = " ".join(entities.unescape("".join(self.aside)).split())
                if line:
                    self.out.append(Line(line, self.aside_linked, "noise", self.noises))
                self.aside.clear()
                self.aside_linked = 0
            self.noise -= noise
            self.dropped -= dropped
            self.links -= name == "a"
            if name in ("article", "main"):
                self.inside -= 1
                self.stretch += 1


def lines(page: str) -> list[Line]:
    """The lines of a page in their order; gaps are empty."""
    held = _Lines()
    at, ended = 0, False
    while not ended:
        ended = True
        for tag in TAG.finditer(page, at):
            if tag.start() > at:
                held.put(page[at : tag.start()])
            at = tag.end()
            end, name, attributes = tag.groups()
            if name is None:
                continue
            name = name.lower()
            block = name in BLOCKS
            if block:
                held.flush(not end)
            elif name == "br":
                held.put(" ")
            if end:
                if places := held.where.get(name):
                    held.close(places[-1])
                continue
            if name in RAW:
                close = RAW_END[name].search(page, at)
                at = close.end() if close else len(page)
                ended = False
                break
            if name in VOID or attributes.endswith("/") and not block:
                continue
            if held.stack and (block and held.stack[-1][0] == "p" or held.stack[-1][0] in ENDS.get(name, ())):
                held.close(len(held.stack) - 1)
            held.open(name, attributes)
    rest = page[at:]
    cut_off = rest.rfind("<")
    held.put(rest[:cut_off] if cut_off >= 0 and OPENING.match(rest, cut_off) else rest)
    held.flush(False)
    return held.out


def runs(weights: np.ndarray, window: int, surge: float) -> list[tuple[int, int, float, bool]]:
    """Runs of lines between a gap and the next, as first line, end, weight and whether a window surges; a run that surges begins there."""
    if not weights.any():
        return []
    sums = np.convolve(weights, np.ones(window))[window - 1 :]  # of a line and those after it
    ends = np.flatnonzero(np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]])))
    out = []
    for start, end in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True):
        over = np.flatnonzero(sums[start:end] > surge)
        first = start + (int(over[0]) if len(over) else 0)
        weighed = first + np.flatnonzero(weights[first:end])  # lines of links at either end are none of the text
        if len(weighed):
            out.append((int(weighed[0]), int(weighed[-1]) + 1, float(weights[first:end].sum()), bool(len(over))))
    return out


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The article's blocks, joined by an empty line."""
    found = lines(page or "")
    marked = any(x.kind == "in" and x.text for x in found)
    stretches: dict[tuple[str, int], list[int]] = {}
    for i, x in enumerate(found):
        stretches.setdefault((x.kind, x.stretch), []).append(i)
    kept: list[tuple[list[int], tuple[int, int, float, bool]]] = []
    for (kind, _), at in stretches.items():
        each = INSIDE if kind == "in" else NOISY if kind == "noise" else OUTSIDE if marked else 1.0
        weights = each * np.array([len(found[i].text) if kind == "in" else max(0, len(found[i].text) - 2 * found[i].linked) for i in at], dtype=np.float64)
        kept += [(at, run) for run in runs(weights, window, surge)]
    surged = [x for x in kept if x[1][3]] or sorted(kept, key=lambda x: (-x[1][2], x[0][x[1][0]]))[:1]
    chosen = sorted(i for at, run in surged for i in at[run[0] : run[1]])
    return "\n\n".join(found[i].text for i in chosen if found[i].text)


def extract_text(pages: DataFrame, window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages`` (page_id, url, html): one pass, no shuffle."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    schema = StructType([rows.schema["page_id"], rows.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, window, surge) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, schema)
