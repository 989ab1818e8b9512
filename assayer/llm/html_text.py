"""HTML extraction by tag-path ratios: text length and punctuation summed per tag path, smoothed, fused and thresholded."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+|[^<>]*+)>|<[!?/][^<>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed lists of the language: elements without an end, of raw text, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without text of the page.
SKIPPED = frozenset("canvas head object select svg template".split())
#: Elements that are rarely the main text, and words of a class, id or role that say so.
MARKED = frozenset("aside button dialog fieldset footer form header menu menuitem nav noscript".split())
MARKS = frozenset("""ad ads adbox adslot advert advertisement advertising adverts alert alertdialog banner breadcrumb breadcrumbs captcha comment commentlist comments
complementary consent contentinfo cookie cookies copyright dialog discussion discussions disqus dropdown feedback footer footnav form gdpr header hidden login masthead menu menubar modal nav navbar navigation
newsletter notice pager pagination popup promo promoted promotion reactions recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe
subscription toolbar topbar widget widgets""".split())
#: Words that say nothing beside a mark: ``sidebar-left`` is a sidebar, ``sidebar-free`` isn't.
NEUTRAL = frozenset("area bar block body bottom box center column container group inner item items left line link links list outer panel primary right row secondary section site top wrap wrapper".split())
#: How much a mark, a word that may be one, and being beside an article lower a score; what a first article keeps whatever holds it.
MARK, MAYBE, BESIDE, FIRST = 0.01, 0.5, 0.08, 0.3
#: What a page is about stands in these; their own class lowers nothing.
WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("dd dl dt li ol table tbody td tfoot th thead tr ul".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Elements that end an open one of their kind.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _weight(value: str) -> float:
    """How much class names lower a score: by MARK if one consists of marks and neutral words, by MAYBE if one holds a mark."""
    out = 1.0
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if not parts or parts[0] in ("has", "no", "with", "without") or MARKS.isdisjoint(parts):
            continue
        out = min(out, MARK if all(x in MARKS or x in NEUTRAL for x in parts) else MAYBE)
    return out


class Blocks:
    """The text blocks of a page: path, region, heading, text, characters in links, and how much marks lower it.

    A mark lowers what its element holds, whatever that is, and never drops it: so a wrapper of the whole page with such a
    name lowers all alike.
    """

    def __init__(self, html: str) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.parents: list[int] = []
        self.holders: list[int] = []
        self.steps: list[str] = []
        self.found: list[tuple[int, int, str, str, int, float]] = []
        #: (tag, path of the nearest block, skipped, weight, weight of headings, region, heading or "")
        self.stack: list[tuple[str, int, bool, float, float, int, str]] = [("", self._path(-1, ""), False, 1.0, 1.0, -1, "")]
        self.open: dict[str, int] = {}
        self.kinds: list[str] = []
        self.parts: list[str] = []
        self.linked = 0
        at = 0
        while at < len(html):
            m = TAG.search(html, at)
            self._text(html[at : m.start() if m else len(html)])
            if not m:
                break
            at = m.end()
            if (tag := (m[2] or "").lower()) and m[1]:
                self._end(tag)
            elif tag in RAW:
                raw_end = re.compile(rf"</{tag}(?![\w-])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = raw_end.end() if raw_end else len(html)
            elif tag:
                self._start(tag, m[3] or "")
        self._flush()

    def _path(self, parent: int, step: str) -> int:
        found = self.paths.setdefault((parent, step), len(self.paths))
        if found == len(self.parents):
            self.parents.append(parent), self.steps.append(step.partition(".")[0])
            self.holders.append(self.holders[parent] if parent >= 0 and self.steps[parent] in LISTS else parent)
        return found

    def container(self, path: int) -> int:
        """The path that holds a block's: for an item of a list or a cell that of the whole list or table."""
        return self.holders[path] if path >= 0 else path

    def _text(self, raw: str) -> None:
        if raw and not self.stack[-1][2]:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.open.get("a"):
                self.linked += sum(map(len, text.split()))

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, path, _, weight, bare, region, heading = self.stack[-1]
                self.found.append((path, region, heading, text, self.linked, bare if heading else weight))
            self.parts, self.linked = [], 0

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def _start(self, tag: str, rest: str) -> None:
        if tag in INLINE:
            if tag in VOID:
                return
        elif tag == "br":
            self.parts and self.parts.append(" ")
            return
        else:
            self._flush()
            while self.open.get("p") and (self.stack[-1][0] in INLINE or self.stack[-1][0] == "p"):
                self._pop()
            if tag in SIBLINGS:
                while self.stack[-1][0] in INLINE or self.stack[-1][0] in SIBLINGS[tag]:
                    self._pop()
            if tag in VOID:
                return
            if tag == "body" and self.open.get("head"):  # a head without an end
                while self.stack[-1][0] != "head":
                    self._pop()
                self._pop()
        _, path, skipped, weight, bare, region, heading = self.stack[-1]
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if "=" in rest or "hidden" in rest else {}
        if tag not in INLINE:
            path = self._path(path, f"{tag}.{attrs.get('class', '').partition(' ')[0] or attrs.get('id', '')}")
        own = _weight(" ".join((attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", "")))) if attrs and tag not in WHOLE else 1.0
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")) or tag in MARKED or tag == "label" and self.open.get("form"):
            own = MARK
        if tag == "article" and self.open.get("article"):
            own = MARK  # an article within an article is a reader's comment
        elif tag in ("article", "main") or attrs.get("role") == "main":
            if not self.kinds:
                weight, bare = max(weight, FIRST), max(bare, FIRST)
            region = len(self.kinds)
            self.kinds.append(tag)
        weight *= own
        if tag != "header" or region < 0:  # an article's header holds its title
            bare *= own
        self.stack.append((tag, path, skipped or tag in SKIPPED, weight, bare, region, tag if tag in HEADINGS else heading))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        elif tag == "br":
            self.parts and self.parts.append(" ")
        if self.open.get(tag):
            while self.stack[-1][0] != tag:
                if self.stack[-1][0] not in INLINE and tag in INLINE:
                    return  # a line's element doesn't end a block
                self._flush() if self.stack[-1][0] not in INLINE else None
                self._pop()
            self._pop()


def main_text(html: str | None, threshold: float = 0.1, most_linked: float = 0.8, least: float = 1.0) -> str:
    """The main text of a page, blocks joined by one space.

    For each tag path (block elements with their first class, or id) the text length and the punctuation marks of its blocks
    are summed and divided by its number of blocks.  Both ratios are smoothed along the page, fused as
    length * (1 + punctuation) * (share outside links), less where a path is short by itself, and averaged by path; a path has at
    least the ratio of its container (for blocks of an article or main element: that element), and none with links for ``most_linked`` of its text, but for unmarked blocks
    of an article or main element, whose links are its text.
    Marks lower the score of what they hold, and being beside an article or main element lowers it, if the page has one with
    text.  Headings have the ratio of what follows them, lowered by their own marks; one right before an article is of it.
    Blocks under ``threshold`` times the page's highest score go, and all do if that is under ``least``.
    """
    page = Blocks(html or "")
    blocks = page.found
    if not blocks:
        return ""
    path = np.unique([b[0] for b in blocks], return_inverse=True)[1]
    mean = lambda v, by=path: (np.bincount(by, v) / np.maximum(np.bincount(by), 1))[by]
    length = np.array([len(b[3]) for b in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(b[3])) for b in blocks], float)
    linked = (np.bincount(path, [float(b[4]) for b in blocks]) / np.bincount(path, [float(len(b[3].replace(" ", ""))) for b in blocks]))[path]

    def smooth(v: np.ndarray) -> np.ndarray:
        wide = np.concatenate([v[:1], v, v[-1:]])
        return 0.25 * wide[:-2] + 0.5 * v + 0.25 * wide[2:]

    near = smooth(mean(length))
    own = np.minimum(1.0, 4 * mean(length) / near)  # what is short only beside long text stays short
    fused = near * own * (1 + smooth(mean(marks))) * np.clip(1 - linked, 0, 1)
    ratio = mean(fused)
    weight, region = np.array([b[5] for b in blocks]), np.array([b[1] for b in blocks])
    if (region >= 0).any():
        first = np.append(region[1:] >= 0, False) & np.array([bool(b[2]) for b in blocks])
        weight = np.where((region >= 0) | first, weight, BESIDE * weight)
    top = [page.container(b[0]) for b in blocks]
    whole = {p for p, step in enumerate(page.steps) if step in ("", "html", "body")}
    # what a mark lowers is a container of its own
    holder = np.unique([f"{w}r{r}" if r >= 0 else f"{w}p{b[0]}" if t in whole or t < 0 else f"{w}c{t}" for b, t, w, r in zip(blocks, top, weight, region)], return_inverse=True)[1]
    shared = (np.bincount(holder, fused * length) / np.bincount(holder, length))[holder]
    inside = (region >= 0) & (weight >= FIRST)  # of an article and without a mark: links are part of its text
    raw = np.where((linked >= most_linked) & ~inside, 0.0, np.maximum(ratio, shared))
    for i in range(len(blocks) - 2, -1, -1):
        if blocks[i][2]:
            raw[i] = raw[i + 1] * min(1.0, weight[i + 1] / weight[i])
    score = raw * weight
    keep = score >= threshold * score.max() if score.max() >= least else np.zeros(len(blocks), bool)
    return " ".join(b[3] for b, k in zip(blocks, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(html) for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page (see ``main_text``) from its whole html.

    One row per input row: ``page_id, url, text, n_chars``.  Null and empty html, and pages of boilerplate alone, give an
    empty text and 0.  Rows are independent and time is linear in the html, so a page of any size or nesting is one pass;
    repeated rows repeat, null ids and urls are carried, other columns are ignored, an empty table is empty.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
