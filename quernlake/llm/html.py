"""Main text of web pages by text-to-tag ratios.

A page is cut into whole constructs (tags, texts; comments and declarations are left out), which the standard
library's parser is fed piece by piece, so that it never looks for the end of one that has none; its events make
lines (a block-level tag or a source line break ends one) with their text and the number of tags in them.  Text in
links isn't counted as text.  The logarithms of the lines' text-to-tag ratios are smoothed with a Gaussian, and lines
are put in two clusters by the threshold that Otsu's method finds on them; the upper cluster is content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE, SIGMA, APART = 1 << 16, 1.0, 3.5
_BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split())
# what is never shown: scripts and styles end with the page at the latest, the others need an end tag
_RAW, _HIDDEN = frozenset(("script", "style")), frozenset("noscript template svg iframe object".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SIMPLE = re.compile(r"</?[a-zA-Z][^<>\"']*>")
_QUOTE = re.compile(r"=\s*([\"'])|>")


class Pieces:
    """The constructs of a page in turn, each looked at once: what has no end is text, and the search for that
    end isn't repeated."""

    def __init__(self, html: str):
        self.html, self.n = html, len(html)
        self.none: set[str] = set()  # what doesn't come any more
        self.quotes = True  # whether '>' in attribute values doesn't end tags

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.none.add(what)
        return k

    def end_tag(self, name: str, at: int) -> int:
        """Where ``</name`` stands next; -1 if nowhere."""
        if "</" + name in self.none:
            return -1
        for m in re.compile(rf"(?i)</{name}(?=[\s/>])").finditer(self.html, at):
            return m.start()
        self.none.add("</" + name)
        return -1

    def tag(self, at: int) -> int:
        """The end of the tag that begins at ``at``; -1 if it has none."""
        m = _SIMPLE.match(self.html, at)
        if m:
            return m.end()
        if self.quotes and self.html[at + 1] != "/":
            k = at
            while True:
                m = _QUOTE.search(self.html, k)
                if m is None:
                    break
                if m[1] is None:
                    return m.end()
                k = self.find(m[1], m.end()) + 1
                if not k:
                    break
            self.quotes = False  # a value without an end: from here on, the next '>' ends a tag
        return self.find(">", at) + 1 or -1

    def __iter__(self) -> Iterator[str]:
        html, at = self.html, 0
        while at < self.n:
            k = html.find("<", at)
            if k < 0:
                yield html[at:]
                return
            if k > at:
                yield html[at:k]
            at = k
            c = html[at + 1 : at + 2]
            if c.isascii() and c.isalpha() or c == "/" and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha():
                end = self.tag(at)
                if end > 0:
                    m = _NAME.match(html, at + 1)
                    name = m[0].lower() if m else ""
                    if name in _RAW:
                        close = self.end_tag(name, end)
                        at = self.n if close < 0 else (self.find(">", close) + 1 or self.n)
                        yield "<x>"  # a tag without text
                        continue
                    if name in _HIDDEN and html[end - 2] != "/":
                        close = self.end_tag(name, end)
                        if close >= 0:
                            at = self.find(">", close) + 1 or self.n
                            yield "<x>"
                            continue
                    yield html[at:end]
                    at = end
                    continue
            elif c in ("!", "?", "/"):
                long = html.startswith("<!--", at)
                close = self.find("-->" if long else ">", at + 2)
                if close >= 0:
                    at = close + (3 if long else 1)
                    continue
            yield "&lt;"
            at += 1


class Lines(HTMLParser):
    """Collects the lines of a page as (text, tags, characters in links), and the title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.title: list[str] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.link = self.in_title = False

    def set_cdata_mode(self, elem: str) -> None:
        """Scripts and styles don't come here."""

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            self.lines.append((text, self.tags, min(self.linked, len(text))))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self.end_line()
            self.link = False  # what holds blocks is no line of links; nor is what isn't closed
        self.tags += 1
        if tag == "title":
            self.in_title = True
        elif tag == "a":
            self.link = any(k == "href" for k, _ in attrs)
        elif self.in_title:
            self.in_title = False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.link = False
        if tag == "title":
            self.in_title = False
        if tag in _BLOCK:
            self.end_line()
            self.link = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
            return
        for k, part in enumerate(data.split("\n")):
            if k:
                self.end_line()
            if part:
                self.text.append(part)
                self.linked += len(" ".join(part.split())) if self.link else 0


def parse(html: str) -> tuple[str, list[tuple[str, int, int]]]:
    parser = Lines()
    held, size = [], 0
    for x in Pieces(html):
        held.append(x)
        size += len(x)
        if size >= PIECE:
            parser.feed("".join(held))
            held, size = [], 0
    parser.feed("".join(held))
    parser.close()
    parser.end_line()
    return " ".join("".join(parser.title).split()), parser.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and weighed anew."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-((np.arange(-radius, radius + 1) / sigma) ** 2) / 2)
    full = lambda x: np.convolve(x, kernel)[radius : radius + len(values)]
    return (full(np.array(values)) / full(np.ones(len(values)))).tolist() if values else []


def threshold(values: list[float], apart: float = APART, least: float = 0.0) -> float:
    """The cut between two clusters that leaves the least variance within them (Otsu).  The least value, so that all
    are one cluster, where their means aren't ``apart`` deviations, and ``least``, from each other: an even spread has no cut."""
    order = np.sort(np.array(values, float))
    n = len(order)
    edge = np.flatnonzero(np.diff(order) > 0) + 1  # sizes of the lower cluster
    if not len(edge):
        return float(order[0]) if n else 0.0
    sums = np.cumsum(order)
    gap = (sums[-1] - sums[edge - 1]) / (n - edge) - sums[edge - 1] / edge
    k = int(edge[np.argmax(edge * (n - edge) * gap * gap)])
    low, high = order[:k], order[k:]
    spread = math.sqrt((low.var() + high.var()) / 2)
    return float(high[0]) if high.mean() - low.mean() > max(apart * spread, least) else float(order[0])


def content(lines: list[tuple[str, int, int]]) -> list[int]:
    """Indexes of the lines that are content: of the upper cluster, and not links for the most part."""
    level = smoothed([math.log1p(max(0, len(t) - linked) / max(1, tags)) for t, tags, linked in lines])
    cut = threshold(level, least=math.log(2))  # ratios that differ by less than twofold are alike
    return [k for k, (t, _, linked) in enumerate(lines) if t and level[k] >= cut and 2 * linked <= len(t)]


def extract(html: str | None) -> tuple[str, str, int, int]:
    """(title, text, lines, lines kept) of a page."""
    if not html:
        return "", "", 0, 0
    title, lines = parse(html)
    kept = content(lines)
    return title, "\n".join(lines[k][0] for k in kept), len(lines), len(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, n_lines, n_kept) of each row of ``pages``.

    Null, empty and tagless-and-textless pages have empty title and text.  Malformed HTML is read as far as it makes
    sense, in time linear in its length: a tag or comment without an end is text, a script without an end is the
    rest of the page.  A page of which the lines are alike, as of plain text, is one cluster, all content.  Each row has
    its row in the result, repeated ones and those with nulls in other columns too.  Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h) for h in batch.column(2).to_pylist()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))],
                names=["page_id", "url", "title", "text", "n_lines", "n_kept"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, title string, text string, n_lines bigint, n_kept bigint")
