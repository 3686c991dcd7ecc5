"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams a page's events. Block tags part the page into lines; a line knows its text, how much
of it is link text, how many tags it took and in which container it stands. The ratio of a line is its plain characters per
tag; the ratios are smoothed along the page with a Gaussian, and two-means clustering of their logarithms gives the threshold
that parts content lines from the rest. A container (an article or the page's main part where there is one, else the
sections of the body) is a content region if most of its text stands in content lines; all its lines are taken then,
short ones as well, as the page has them. Lines in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments have no ratio and are never taken: these are told by their tags and by the words in their
class, id and role. Names do not count on headings, articles and main parts, and a form that holds most of the page's text is the page.

Null or empty html: empty text. Pages that are cut off or badly nested are read as far as they go; an article that begins
inside an unclosed menu ends it. Repeated rows give a row each; null ids are kept. Other columns are not read. An empty
table gives no rows."""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table

SIGMA = 1.5
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title textarea select button svg math iframe object canvas audio video".split())
APART = set("nav footer aside menu dialog".split()) | SILENT
#: Words in a class or id that tell a part of the page apart by themselves, and those that do so only as a whole name or next to
#: another such word ("side" in "side-bar", not in "side-by-side").
_STRONG = set("""ad ads advert adverts advertisement advertisements sponsored sponsor sponsors promo promos promotion promotions banner banners cookie cookies consent
popup popups nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer footers masthead topbar toolbar comment comments commentlist
disqus share sharing newsletter subscribe pagination pager""".split())
_WEAK = set("notice notices alert alerts modal overlay side rail replies respond social related recommended signup login search skip copyright legal".split())
_BESIDE = set("bar bars box boxes link links list posts articles stories items form wrap wrapper container icons buttons button block section panel area region content column col left right top bottom to inner outer main site page".split())
_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[0-9])")
_HEADER = re.compile(r"(?:^|[\s_-])(?:page|site|top|main)?-?header(?:$|[\s_\d-])", re.I)
_COMMENT = re.compile(r"comment|disqus|(?:^|[\s_-])repl(?:y|ies)(?:$|[\s_-])", re.I)
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_SPACE = re.compile(r"\s+")


def told_apart(names: str) -> bool:
    """Whether a class or id names a part that is not content."""
    for name in names.lower().split():
        parts = [x for x in _PARTS.split(name) if x and not x.isdigit()]
        if any(x in _STRONG for x in parts):
            return True
        if any(x in _WEAK for x in parts) and all(x in _WEAK or x in _BESIDE for x in parts):
            return True
    return False


class Lines(HTMLParser):
    """lines: (text, link characters, tags, container, form) of a page; container is a number, or -1 apart from the content; form is
    that of the outermost form around the line, or -1. What an event asks of the open tags is counted as they open and
    close, so a page takes time in proportion to its length however deep its tags are nested."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        #: Open tags: (tag, apart, comment, container, form).
        self.stack: list[tuple[str, bool, bool, int, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.apart = self.loose = self.forms = 0
        self.parents, self.kinds = [-1], ["page"]
        self.text: list[str] = []
        self.linked = self.tags = 0

    def updatepos(self, i: int, j: int) -> int:
        """Places in the source are not needed."""
        return j

    def _push(self, tag: str, apart: bool, comment: bool, container: int, form: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, apart, comment, container, form))
        self.apart += apart
        self.loose += apart and not comment and tag not in SILENT

    def _pop(self) -> None:
        tag, apart, comment, *_ = self.stack.pop()
        self.places[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        self.apart -= apart
        self.loose -= apart and not comment and tag not in SILENT

    def _line(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                _, _, _, container, form = self.stack[-1] if self.stack else ("", False, False, 0, -1)
                self.lines.append((text, self.linked, self.tags, -1 if self.apart else container, form))
                self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("article", "main") and self.loose:
            # An article does not stand in a menu: that was left open.
            while self.apart:
                self._pop()
        if tag == "body":
            while self.stack:
                self._pop()
        of = dict(attrs)
        apart, comment = tag in APART, False
        if tag == "header" or attrs:
            role = (of.get("role") or "").lower()
            named = f"{of.get('class') or ''} {of.get('id') or ''}"
            inside = bool(self.places.get("article"))
            apart = apart or (tag == "header" and not inside) or role in _ROLES or "hidden" in of
            if named != " " and tag not in ("html", "body", "main", "article") and role != "main" and tag not in _HEADINGS:
                comment = bool(_COMMENT.search(named))
                apart = apart or comment or told_apart(named) or bool(_HEADER.search(named)) and not inside
        _, _, _, at, form = self.stack[-1] if self.stack else ("", False, False, 0, -1)
        if tag in ("article", "main", "section", "div", "td", "body", "form"):
            self.parents.append(at)
            self.kinds.append("main" if (of.get("role") or "").lower() == "main" else tag)
            at = len(self.parents) - 1
        if tag == "form" and form < 0:
            form, self.forms = self.forms, self.forms + 1
        self._push(tag, apart, apart and comment, at, form)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        open_ = self.places.get(tag)
        if open_ and (tag in BLOCKS or tag in SILENT or not self.blocks or self.blocks[-1] <= open_[-1]):
            depth = open_[-1]
            while len(self.stack) > depth:
                self._pop()

    def handle_data(self, data: str) -> None:
        if data:
            self.text.append(data)
            if self.places.get("a"):
                self.linked += len(data.strip())

    def finish(self) -> list[tuple[str, int, int, int]]:
        """The lines (text, link characters, tags, container). A form is apart unless it holds most of the page's text, which then is
        a page built as one form."""
        self.close()
        self._line()
        held = [0] * self.forms
        for text, _, _, where, form in self.lines:
            if form >= 0 and where >= 0:
                held[form] += len(text)
        total = sum(len(text) for text, _, _, where, _ in self.lines if where >= 0)
        return [(text, linked, tags, -1 if form >= 0 and 2 * held[form] <= total else where) for text, linked, tags, where, form in self.lines]

    def regions(self) -> list[int]:
        """The outermost article or main part around each container, itself included, or -1."""
        out = [-1]
        for at in range(1, len(self.parents)):
            above = out[self.parents[at]] if self.parents[at] >= 0 else -1
            out.append(above if above >= 0 else at if self.kinds[at] in ("article", "main") else -1)
        return out


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page, with the weights of what there is at its ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach:reach + len(ratios)] / total


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        a, b = values[values <= cut], values[values > cut]
        if not len(a) or not len(b) or (a.mean(), b.mean()) == (low, high):
            break
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The text of a page's content regions, a line per block."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    lines = page.finish()
    if not any(w >= 0 for *_, w in lines):
        return ""
    ratio = np.array([max(0, len(t) - linked) / max(1, tags) if w >= 0 else 0.0 for t, linked, tags, w in lines])
    value = np.log1p(smooth(ratio))
    content = value >= min(threshold(value), value[[w >= 0 for *_, w in lines]].max())
    # Regions: the outermost articles or main parts, else the containers as they are.
    region = page.regions()
    marked = [region[w] if w >= 0 else -1 for *_, w in lines]
    chosen = marked if any(r >= 0 for r in marked) else [w for *_, w in lines]
    size: dict[int, int] = {}
    held: dict[int, int] = {}
    for (t, *_), r, c in zip(lines, chosen, content):
        if r >= 0:
            size[r] = size.get(r, 0) + len(t)
            held[r] = held.get(r, 0) + len(t) * bool(c)
    good = {r for r in size if 2 * held[r] >= size[r]} or {max(size, key=lambda r: (size[r], -r))}
    return "\n".join(t for (t, *_), r in zip(lines, chosen) if r in good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for o in range(0, len(whole), 256):
            batch = whole.slice(o, 256)
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    plain = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return plain.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op1_tag_ratio(spark, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
