"""The main text of web pages, by text-to-tag ratios over the standard library's parser events.

The parser's events cut a page into lines, one for each block of text, and leave out what markup
says is none of the article's (menus, headers, footers, asides, notices, adverts, forms, scripts,
styles, comments of readers). Each line's ratio of text to tags is smoothed by a Gaussian and
clustered by a threshold, the lesser of the smoothed ratios' deviation and mean. Lines over it select
the regions: of a page's article elements those that hold a good part of the best one's mass, whole;
on a page without one, the run from the first to the last line of the heaviest cluster.

Defined results: a null or empty page has the empty text; unclosed elements end where their parents
do; rows that repeat are each extracted; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements without content, elements that end a line, and what is no part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset("aside button canvas dialog footer form head iframe map menu nav noscript object script select style svg template textarea title".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer"
    " discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended"
    " related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WHOLE = frozenset("article body html main".split())
UNCLOSED = frozenset("button form head header menu nav select title".split())  # hold no article, so one that starts there ends them
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")
SPREAD, REACH, PART = 1.0, 3, 0.3  # the Gaussian's deviation and radius in lines; of the best article's mass


@dataclass
class Line:
    text: str
    tags: int  # since the line before
    article: int  # which article element it is in; 0: none


class Lines(HTMLParser):
    """Collects a page's lines from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.held: list[str] = []
        self.tags = 0
        self.skipped: str | None = None  # the element that is left out
        self.depth = 0
        self.articles: list[int] = []
        self.count = 0

    def end_line(self) -> None:
        if text := " ".join("".join(self.held).split()):
            self.lines.append(Line(text, self.tags, self.articles[-1] if self.articles else 0))
            self.tags = 0
        self.held = []

    def outside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in OUTSIDE or tag == "header" and not self.articles:
            return True
        if not attrs or tag in WHOLE:
            return False
        have = {k: v or "" for k, v in attrs}
        if "hidden" in have or have.get("aria-hidden") == "true" or _HIDDEN.search(have.get("style", "")) or have.get("role") in ROLES:
            return True
        named = set(_SPLIT.split(f"{have.get('class', '')} {have.get('id', '')}".lower()))
        return bool(named & WORDS) or "header" in named and not self.articles

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.skipped:
            if tag in ("article", "main") and self.skipped in UNCLOSED or self.skipped in ("p", "li") and tag in BLOCK:
                self.skipped = None
            else:
                self.depth += tag == self.skipped
                return
        if tag in BLOCK:
            self.end_line()
        elif tag == "br":
            self.held.append(" ")
        if tag not in VOID and self.outside(tag, attrs):
            self.skipped, self.depth = tag, 1
        elif tag in ("article", "main"):
            self.count += 1
            self.articles.append(self.count)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing that isn't void

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.skipped:
            self.depth -= tag == self.skipped
            if not self.depth or tag in ("body", "html"):
                self.skipped = None
            return
        if tag in BLOCK:
            self.end_line()
        if tag in ("article", "main") and self.articles:
            self.articles.pop()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.held.append(data)


def smoothed(ratios: list[float]) -> list[float]:
    """Each ratio as the Gaussian mean of its neighbours."""
    kernel = [math.exp(-((k / SPREAD) ** 2) / 2) for k in range(-REACH, REACH + 1)]
    out = []
    for k in range(len(ratios)):
        have = [(kernel[j + REACH], ratios[k + j]) for j in range(-REACH, REACH + 1) if 0 <= k + j < len(ratios)]
        out.append(sum(w * r for w, r in have) / sum(w for w, _ in have))
    return out


def content(lines: list[Line]) -> list[Line]:
    """The lines of the content regions."""
    if not lines:
        return []
    own = [len(line.text) / max(1, line.tags) for line in lines]
    s = smoothed(own)
    mean = sum(s) / len(s)
    threshold = min(mean, math.sqrt(sum((x - mean) ** 2 for x in s) / len(s)))
    mass: dict[int, float] = {}
    for line, x in zip(lines, s):
        if line.article and x >= threshold:
            mass[line.article] = mass.get(line.article, 0.0) + x
    if mass:
        best = max(mass.values())
        return [line for line in lines if mass.get(line.article, 0.0) >= PART * best]
    clusters: list[list[int]] = []
    for k in (k for k, x in enumerate(s) if x >= threshold and own[k] >= threshold):  # smoothing blurs a region's edge
        if clusters and k - clusters[-1][-1] <= REACH:
            clusters[-1].append(k)
        else:
            clusters.append([k])
    if not clusters:
        return lines
    best = max(clusters, key=lambda c: sum(s[k] for k in c))
    return lines[best[0] : best[-1] + 1]


def main_text(html: str | None) -> str:
    """The page's main text, a line for each block."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return "\n".join(line.text for line in content(parser.lines))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep` and the main text, of each row."""
    chosen = pages.select(*(pages[c].alias(f"k{k}") for k, c in enumerate(keep)), pages[html_col].cast("string").alias("html"))
    schema = ", ".join([f"k{k} {chosen.schema[k].dataType.simpleString()}" for k in range(len(keep))] + ["text string"])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, 512):
                piece = part.slice(start, 512)
                texts = [main_text(h) for h in piece.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(texts, pa.string())], names=[*(f"k{k}" for k in range(len(keep))), "text"])

    return chosen.mapInArrow(run, schema).toDF(*keep, "text")
