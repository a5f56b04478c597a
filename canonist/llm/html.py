"""Main text of HTML pages from the standard library's parser events.

The parser's events are cut into lines, one for each block of text, with the tags met on it. Elements that never are main
text (scripts, menus, forms, page headers and footers, sidebars, and what their class or id says to be advert, notice or
reader comment) count as tags only. The text-to-tag ratios of a page's lines are smoothed with a Gaussian and cut at a
threshold between their two clusters; the content regions are the lines above it. An article mark is a prior on the lines, never
more: the Gaussian does not reach across its edges, and where the marked lines hold half of the page's text or more, they
stay whole, so that short paragraphs and headings do. All other lines, marked or not, are held against the threshold.

Defined cases: a null html is empty; an empty or textless page gives an empty text; unclosed elements end where their
parent does or where HTML implies it (a block ends a p, an li the li before it), a tag or comment cut off at the page's end is no text; equal pages are each a row; nothing is capped; an empty table gives no rows.
Only page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template head title svg math iframe object select textarea button canvas audio video".split())
AROUND = frozenset("nav aside footer form menu dialog".split())
#: Words of a class or id that mark what is not main text.
MARKS = frozenset("nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement banner cookie cookies consent notice popup modal overlay promo sponsor sponsored comment comments disqus reply replies related share sharing social breadcrumb breadcrumbs newsletter subscribe signup login pagination pager toolbar masthead".split())
#: Words in a name that make it say something else than its mark (no-comments, with-sidebar), and last words of layouts and states.
OTHERWISE = frozenset("with without no not non has hide to from for and".split())
LAYOUTS = frozenset("layout page grid template enabled disabled open closed on off".split())
#: No end tag or implied end reaches out of these, but for the end tags of a page's large parts.
SCOPE = frozenset("html table td th caption object template".split())
LARGE = frozenset("html body main article section nav aside header footer".split())
#: Start tags that end open elements of the second set, as far out as the first one of the third.
IMPLIED = [
    (frozenset({"li"}), frozenset({"li"}), SCOPE | frozenset("ul ol menu".split())),
    (frozenset("dt dd".split()), frozenset("dt dd".split()), SCOPE | {"dl"}),
    (frozenset({"option"}), frozenset({"option"}), frozenset({"select"})),
    (frozenset("td th".split()), frozenset("td th".split()), frozenset("table template".split())),
    (frozenset({"tr"}), frozenset("td th tr".split()), frozenset("table template".split())),
    (frozenset("tbody thead tfoot".split()), frozenset("caption td th tr tbody thead tfoot".split()), frozenset("table template".split())),
    (BLOCKS - frozenset("body html legend caption option tbody thead tfoot td th tr".split()), frozenset({"p"}), SCOPE | {"button"}),
]
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CUT = re.compile(r"<(?:!--(?:(?!-->).)*|[a-zA-Z/!?][^<>]*)\Z", re.S)
SIGMA = 2.0


def marked(value: str, whole: bool = False) -> bool:
    """Does a class, id or role say that an element is no main text? A name does as a whole or by one of its words (site-nav, ad-top), but not
    where a word turns it round (no-comments, with-sidebar, reply-to-critics) or where it names a layout or state (sidebar-layout)."""
    for name in value.split():
        words = re.split(r"[^a-z0-9]+", name)
        if name in MARKS or not whole and MARKS & {*words} and not OTHERWISE & {*words} and words[-1] not in LAYOUTS:
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, number of the outermost article or 0) for each line of a page."""

    def __init__(self, unclosed: frozenset = frozenset()):
        super().__init__(convert_charrefs=True)
        self.unclosed = unclosed  # tags that begin more often than they end on this page
        self.lines, self.parts, self.tags, self.articles = [], [], 0, 0
        self.open = []  # (tag, whether it is an article) from the root down
        self.skip = -1  # how many elements are open around the skipped one
        self.article = 0  # how many articles are open

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append((text, self.tags, self.articles if self.article else 0))
        self.parts, self.tags = [], 0

    def close_to(self, n: int) -> None:
        """Ends all but the n outermost open elements."""
        for _, article in self.open[n:]:
            self.article -= article
        del self.open[n:]
        if n <= self.skip:
            self.skip = -1

    def find(self, tags: frozenset, stop: frozenset, outermost: bool = False) -> int:
        """Where the innermost (or outermost) open element of these tags lies, up to one of stop; -1 if there is none."""
        found = -1
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] in tags:
                found = n
                if not outermost:
                    break
            elif self.open[n][0] in stop:
                break
        return found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        skipped = self.open[self.skip][0] if self.skip >= 0 else ""
        if tag in BLOCKS:
            self.end_line()
        # a skipped element that is never closed ends where the page's text begins; an article within a closed one is a teaser
        ends = tag in ("main", "body") or tag == "article" and (skipped in self.unclosed or skipped in ("head", "title"))
        if skipped and ends and skipped not in NEVER - {"head", "title"} or skipped == "head" and tag not in IN_HEAD and len(self.open) == self.skip + 1:
            self.close_to(self.skip)
        for starts, ends, stop in IMPLIED:
            if tag in starts and (n := self.find(ends, stop, True)) >= 0:
                self.close_to(n)
        self.tags += 1
        if tag in VOID:
            if tag == "br" and self.skip < 0:
                self.parts.append(" ")
            return
        article = False
        if self.skip < 0:
            told = [value.lower() for name, value in attrs if name in ("class", "id", "role") and value]
            # an article's class also lists its topics: there only a whole name is a mark
            says = any(marked(value, tag == "article") for value in told)
            header = any("header" in re.split(r"[^a-z0-9]+", value) for value in told)
            if tag not in ("html", "body", "main") and (tag in NEVER or tag in AROUND or says or not self.article and tag != "article" and (tag == "header" or header)):
                self.skip = len(self.open)
            elif tag in ("article", "main"):
                article = True
                self.articles += not self.article
                self.article += 1
        self.open.append((tag, article))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        # an inline end tag reaches to the next block only, unless it is the skipped element's own
        near = tag not in BLOCKS | NEVER and not (self.skip >= 0 and tag == self.open[self.skip][0])
        n = self.find(frozenset({tag}), frozenset() if tag in LARGE else SCOPE | BLOCKS if near else SCOPE)
        if n >= 0:
            self.close_to(n)

    def handle_data(self, data: str) -> None:
        if self.skip < 0:
            self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """ratios under a Gaussian that is cut off, and weighed anew, at both ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def threshold(values: np.ndarray) -> float:
    """Half way between the centres of two clusters (one-dimensional 2-means)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(above):
            return low - 1
        now = float(below.mean()), float(above.mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def main_text(html: str | None) -> str:
    if not html:
        return ""
    begun, ended = (Counter(t.lower() for t in re.findall(p, html)) for p in (r"<([a-zA-Z][a-zA-Z0-9]*)", r"</([a-zA-Z][a-zA-Z0-9]*)"))
    parser = Lines(frozenset(t for t, n in begun.items() if n > ended[t]))
    parser.feed(CUT.sub("", html))
    parser.close()
    parser.end_line()
    return " ".join(t for (t, _, _), kept in zip(parser.lines, chosen(parser.lines), strict=True) if t and kept)


def chosen(lines: list[tuple[str, int, int]], prior: float = 0.5) -> np.ndarray:
    """Which lines are main text. prior: the share of the text that marked lines must hold for the mark to count."""
    if not lines:
        return np.zeros(0, bool)
    chars, tags, marked = np.asarray([(len(t), max(1, n), r) for t, n, r in lines], float).T
    edges = np.flatnonzero(np.diff(marked)) + 1
    smooth = np.concatenate([smoothed(part) for part in np.split(chars / tags, edges)])
    trusted = (marked > 0) & (chars[marked > 0].sum() >= prior * chars.sum()) & bool(marked.any())
    if smooth.max() - smooth.min() < 0.5 * smooth.max():  # one cluster: nothing stands out, so nothing goes but by the mark
        return trusted if trusted.any() else np.ones(len(lines), bool)
    return trusted | (smooth > threshold(smooth))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(h) for h in batch.pop("html")]
            yield batch

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
