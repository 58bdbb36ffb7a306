"""Main text of web pages: text-to-tag ratio per line, smoothed, clustered, then the region it points to.

A streaming parser turns the page into lines, one per block element. Every line has the ratio of
its characters to the tags inside it; the ratios are smoothed by a Gaussian and split in two
clusters. The articles that hold text of the high cluster with those beside them, or in pages without
any the smallest container around the whole cluster, are the content region, and all its blocks
outside menus, adverts and the like are the main text, short ones too.

A form, or an element whose name says advert, search or the like, is content all the same if it holds
most of the upper cluster and no article stands elsewhere. Reader comments never are: elements so
named or headed, and articles without a heading that follow, or lie in, one with a heading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody"
    " td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ALWAYS_OUT = frozenset(
    "head title script style noscript template svg math canvas iframe object nav footer aside button select"
    " textarea menu dialog".split()
)
CONTAINERS = frozenset("body main article section div td".split())
# an element whose class, id or role ends in one of these words, but for words of the second list, is no part
# of the article
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
OUT_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie"
    " cookies footer menu modal nav navbar navigation newsletter notice notices popup promo promotion related"
    " search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget"
    " complementary contentinfo alert".split()
)
FRAME_WORDS = frozenset(
    "area articles bar block body bottom box button buttons card center col column container content form group"
    " holder icons inner item items label left links list outer panel posts right row section signup slot stories"
    " text thread title top unit wrap wrapper zone".split()
)
COMMENT_HEADS = frozenset("comments replies commentaires comentarios kommentare".split())
HEADS = frozenset("h1 h2 h3".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORDS = re.compile(r"[^\W\d_]+")
SMALL_SHARE = 0.2  # an article with less of the longest one's text is a teaser or a comment
PLAIN, NAMED, COMMENTS = 0, 1, 2
SIGMA = 2.0  # lines


def _says(values: list[str]) -> int:
    """What the words of an element's class, id and role make of it: PLAIN, NAMED (boilerplate) or COMMENTS."""
    found = PLAIN
    for token in " ".join(values).split():
        for word in reversed(_PARTS.findall(token)):
            word = word.lower()
            if word in COMMENT_WORDS:
                return COMMENTS
            if word in OUT_WORDS:
                found = NAMED
            elif word not in FRAME_WORDS:
                break
    return found


class _Lines(HTMLParser):
    """Collects (text, tags, container) per block; what scripts, menus and the like hold is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, out, container
        self.open: dict[str, int] = {}
        self.parents, self.kinds, self.marks, self.headed = [-1], ["page"], [PLAIN], [0]  # headed: 2 by an h1, 1 by an h2 or h3
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def _top(self) -> tuple[str, bool, int]:
        return self.stack[-1] if self.stack else ("", False, 0)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tag, _, container = self._top()
            if tag in HEADS or tag in ("h4", "h5", "h6"):
                words = [w.lower() for w in _WORDS.findall(text)]
                first = not self.lines or self.lines[-1][2] != container
                if tag != "h1" and first and len(words) <= 4 and COMMENT_HEADS.intersection(words) and self.kinds[container] in ("div", "section"):
                    self.marks[container] = COMMENTS
                self.headed[container] = max(self.headed[container], 2 if tag == "h1" else tag in HEADS)
            self.lines.append((text, self.tags, container))
        self.parts, self.tags = [], 0

    def _pop(self, tag: str) -> None:
        while self.stack:
            last = self.stack.pop()[0]
            self.open[last] -= 1
            if last == tag:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_line()
            if self.open.get("head"):
                self._pop("head")
        self.tags += 1
        if tag in VOID:
            return
        if self._top()[0] == tag and tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            self._pop(tag)
        _, out, container = self._top()
        mark = _says([v for k, v in attrs if k in ("class", "id", "role") and v]) if tag not in ("html", "body", "main") else PLAIN
        header = tag == "header" and not self.open.get("article") and not self.open.get("main")
        out = out or tag in ALWAYS_OUT or header or (mark != PLAIN and tag not in BLOCKS)
        if tag == "form":
            mark = mark or NAMED
        if tag in CONTAINERS or (mark != PLAIN and tag in BLOCKS):
            self.parents.append(container)
            self.kinds.append(tag)
            self.marks.append(mark)
            self.headed.append(0)
            container = len(self.parents) - 1
        self.stack.append((tag, out, container))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if self.open.get(tag):
            self._pop(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self._top()[1]:
            self.parts.append(data)


def content_lines(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines belong to the upper cluster of the smoothed ratios; all of them if they do not differ."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(ratios, kernel, "same")[: len(ratios)] if len(ratios) > len(kernel) else np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    smooth = smooth / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    low, high = smooth.min(), smooth.max()
    for _ in range(50):
        border = (low + high) / 2
        upper = smooth >= border
        if upper.all() or not upper.any():
            return np.ones(len(ratios), bool)
        nearer = smooth[~upper].mean(), smooth[upper].mean()
        if nearer == (low, high):
            break
        low, high = nearer
    return upper


def _sums(parser: _Lines, sizes: np.ndarray) -> np.ndarray:
    """The sizes of the lines in every container, those of inner containers included."""
    held = np.zeros(len(parser.parents))
    np.add.at(held, [container for _, _, container in parser.lines], sizes)
    for container in range(len(held) - 1, 0, -1):  # parents come before their children
        held[parser.parents[container]] += held[container]
    return held


def _left_out(parser: _Lines) -> list[bool]:
    """Which containers are out: all in comments, and all in named ones but those that hold most of the content."""
    parents, marks = parser.parents, parser.marks
    if not any(marks):
        return [False] * len(parents)
    spoken = [False] * len(parents)  # in comments
    for i in range(len(parents)):
        spoken[i] = marks[i] == COMMENTS or (i > 0 and spoken[parents[i]])
    heard = np.array([not spoken[container] for _, _, container in parser.lines])
    if not heard.any():
        return spoken
    sizes = np.array([len(text) for text, _, _ in parser.lines], float)
    tags = np.array([max(1, tags) for _, tags, _ in parser.lines], float)
    upper = np.zeros(len(heard))
    upper[heard] = sizes[heard] * content_lines(sizes[heard] / tags[heard])
    held, whole = _sums(parser, upper), _sums(parser, sizes * heard)
    out, within = [False] * len(parents), [0] * len(parents)  # within: the innermost named container around
    for i in range(1, len(parents)):
        within[i] = i if marks[i] == NAMED else within[parents[i]]
    free = [i for i, kind in enumerate(parser.kinds) if kind in ("article", "main") and not within[i] and not spoken[i]]
    headed = any(parser.headed[i] == 2 for i in free)
    text = sum(whole[i] for i in free if parser.kinds[parents[i]] not in ("article", "main"))
    for i in range(1, len(parents)):
        small = marks[i] == NAMED and (2 * held[i] <= held[0] or headed or text > SMALL_SHARE * held[i])
        out[i] = spoken[i] or out[parents[i]] or small
    return out


def main_text(page: str) -> str:
    """The main text of one page; empty where there is none. Broken markup is read as far as it goes."""
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser._end_line()
    out = _left_out(parser)
    parser.lines = [line for line in parser.lines if not out[line[2]]]
    if not parser.lines:
        return ""
    parents, kinds = parser.parents, parser.kinds
    sizes = np.array([len(text) for text, _, _ in parser.lines], float)
    chosen = content_lines(sizes / np.array([max(1, tags) for _, tags, _ in parser.lines], float))
    held, whole = _sums(parser, sizes * chosen), _sums(parser, sizes)
    headed = list(parser.headed)
    for i in range(len(parents) - 1, 0, -1):
        headed[parents[i]] = max(headed[parents[i]], 0 if out[i] else headed[i])

    def around(i: int) -> set[int]:
        above = set()
        while i >= 0:
            above.add(i)
            i = parents[i]
        return above

    # all article elements beside the named one with most of the content, else what encloses all content lines
    named = [i for i, kind in enumerate(kinds) if kind in ("article", "main") and whole[i] > 0 and not out[i]]
    talk: set[int] = set()
    if any(held[i] > 0 for i in named):
        most = max(named, key=lambda i: (held[i], i))
        above = around(most)
        articles = [i for i in named if kinds[i] == "article"]
        longest = max((whole[i] for i in articles), default=0)
        beside: dict[int, int] = {}
        for i in articles:
            beside[parents[i]] = beside.get(parents[i], 0) + 1
        # the article comes first and has the heading; articles without one, elsewhere or in it, are what readers say
        main = next((i for i in articles if headed[i] == 2 or (headed[i] and whole[i] >= SMALL_SHARE * longest)), None)
        if main is None:
            main = next((i for i in articles if whole[i] >= SMALL_SHARE * longest and beside[parents[i]] == 1), None)
        if main is not None:
            talk = {i for i in articles if i > main and not headed[i] and parents[i] != parents[main] and (headed[main] or beside[parents[i]] > 1)}
        if above & talk:
            most = main
            above = around(most)
        regions = [i for i in named if i == most or (i not in above and (held[i] > 0 or headed[i] or parents[i] == parents[most]))]
    else:
        regions = [max(i for i in range(len(held)) if held[i] >= held[0])]
    inside = np.zeros(len(held), bool)
    inside[regions] = True
    for container in range(min(regions) + 1, len(held)):
        inside[container] = (inside[container] or inside[parents[container]]) and container not in talk
    return " ".join(text for text, _, container in parser.lines if inside[container])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null or empty html and pages without main text give an empty text. Ids and addresses pass through
    as they are, repeated rows give a row each, further columns are left out. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py() or "") for value in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
