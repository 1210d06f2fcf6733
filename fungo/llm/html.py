"""Main text of web pages by the distribution of text over lines.

The markup is stripped to lines, one for each block. What a page's own marks call
menu, advert, form, notice or comment leaves empty lines behind. Lengths of lines
are summed over a sliding window; where the sum leaves the floor the text surges,
where it falls back it dives, and the text between such points is the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import slices

#: Lines of a window, and characters a window has at least in a page without a marked article.
WINDOW, LEAST = 3, 60
#: A stretch of text joins the greatest one if it holds this share of its characters.
NEIGHBOUR = 0.25

# Elements that end a line, that never hold text of an article, whose content is no markup, and that are empty.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("applet aside audio button canvas datalist dialog embed fieldset footer form frameset head iframe input label legend map menu meter nav noscript object optgroup option output progress select svg template video".split())
RAW = frozenset("script style title textarea noframes xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED = frozenset("p li dt dd tr td th option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words of a class or id that mark a container as no part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus dialog footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion related recommended reply replies respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ARTICLE_WORDS = frozenset("article articlebody".split())

_ATTR = r"""(?:[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?|[/"'=\s])*"""
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)({_ATTR})(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass
class Lines:
    """Text of each line, the characters of it outside links, and whether it lies in a marked article."""

    texts: list[str] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)

    def add(self, text: str, weight: int, marked: bool) -> None:
        self.texts.append(text)
        self.weights.append(weight)
        self.marked.append(marked)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _words(*values: str) -> set[str]:
    return {w.lower() for v in values for w in WORD.findall(v)}


def _no_content(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is a part of the page's frame."""
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    marks = _words(attrs.get("class", ""), attrs.get("id", "")) & MARKS
    if in_article and marks == {"header"}:
        return False
    return bool(marks)


def lines_of(page: str) -> Lines:
    """The lines of a page. A block that is no content leaves WINDOW empty lines outside an article and none inside one."""
    out = Lines()
    open_names: list[str] = []
    held: dict[str, int] = {}
    dropped = 0  # depth at which a part of the frame began
    articles: list[int] = []
    links = 0
    parts: list[str] = []
    weight = 0

    def end_line() -> None:
        nonlocal parts, weight
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.add(text, weight, bool(articles))
        parts, weight = [], 0

    def close(depth: int) -> None:
        nonlocal dropped, links
        while len(open_names) > depth:
            name = open_names.pop()
            held[name] -= 1
            if name == "a":
                links = max(0, links - 1)
            if dropped > len(open_names):
                dropped = 0
            while articles and articles[-1] > len(open_names):
                articles.pop()
                gap()

    def gap() -> None:
        for _ in range(WINDOW):
            out.add("", 0, False)

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not dropped:
            parts.append(text)
            if not links:
                weight += len(text.strip())
        if m is None:
            break
        at = m.end()
        if m[0].startswith("<![CDATA[") and not dropped:
            parts.append(html.escape(m[0][9:].removesuffix("]]>")))
        closing, name = (m[1] or "").lower(), (m[2] or "").lower()
        if closing:
            if closing in BLOCKS and not dropped:
                end_line()
            if held.get(closing):
                depth = len(open_names) - 1
                while open_names[depth] != closing:
                    depth -= 1
                close(depth)
            continue
        if not name:
            continue
        if name in BLOCKS and not dropped:
            end_line()
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID or (m[3] or "").rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in IMPLIED and open_names and open_names[-1] == name:
            close(len(open_names) - 1)
        if name == "a" and links:
            depth = len(open_names) - 1
            while open_names[depth] != "a":
                depth -= 1
            if depth == len(open_names) - 1:
                close(depth)
        attrs = _attributes(m[3]) if m[3] and m[3].strip() else {}
        open_names.append(name)
        held[name] = held.get(name, 0) + 1
        if dropped:
            continue
        if _no_content(name, attrs, bool(articles)):
            if name in BLOCKS or not articles:
                end_line()
            dropped = len(open_names)
            if not articles:
                gap()
        elif name == "article" or (attrs and (attrs.get("role", "").lower() == "article" or attrs.get("itemprop", "").lower() in ARTICLE_WORDS)):
            end_line()
            if not articles:
                gap()
            articles.append(len(open_names))
        elif name == "a":
            links += 1
    if not dropped:
        end_line()
    return out


def _stretches(sums: np.ndarray, floor: int) -> list[tuple[int, int]]:
    """(surge, dive) of each run of windows above the floor."""
    over = np.concatenate(([False], sums > floor, [False]))
    edges = np.flatnonzero(over[1:] != over[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def main_text(page: str | None) -> tuple[str, int, int, int]:
    """Text of the article, number of lines, and the lines where it begins and ends (-1 without text).

    Where articles are marked, other lines count as empty. A page without a mark
    needs windows of LEAST characters for a surge; if none has them, any text
    will do. Short lines between a surge and a dive stay, whatever their length.
    """
    lines = lines_of(page or "")
    n = len(lines.texts)
    marked = np.array(lines.marked, bool)
    length = np.array([len(t) for t in lines.texts], np.int64)
    weights = np.where(marked, length, 0) if (length * marked).any() else np.minimum(np.array(lines.weights, np.int64), length)
    if not weights.any():
        return "", n, -1, -1
    total = np.concatenate((np.zeros(WINDOW, np.int64), np.cumsum(weights)))
    sums = total[WINDOW:] - total[:-WINDOW]  # of a line and those before it
    floors = [0] if (length * marked).any() else [LEAST, 0]
    runs = next(r for r in (_stretches(sums, f) for f in floors) if r)
    # a run of windows that end in [surge, dive) covers the lines from WINDOW - 1 before; its own edges are lines with text
    spans = []
    for surge, dive in runs:
        own = np.flatnonzero(weights[max(0, surge - WINDOW + 1) : dive]) + max(0, surge - WINDOW + 1)
        spans.append((int(own[0]), int(own[-1])))
    sizes = [int(weights[a : b + 1].sum()) for a, b in spans]
    kept = [s for s, size in zip(spans, sizes, strict=True) if size >= NEIGHBOUR * max(sizes)]
    first, last = kept[0][0], kept[-1][1]
    inside = [t for t, k in zip(lines.texts[first : last + 1], marked[first : last + 1].tolist(), strict=True) if t and (k or not marked.any())]
    return " ".join(inside), n, first, last


SCHEMA = "page_id long, url string, text string, n_chars long, n_lines long, surge long, dive long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            found = [main_text(p) for p in part.column("html").to_pylist()]
            texts, n, surge, dive = (list(c) for c in zip(*found, strict=True))
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(c, pa.int64()) for c in (n, surge, dive))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_lines", "surge", "dive"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page, with its code points, the number of lines and where the article begins and ends.

    One row for each row of ``pages``, read where it lies: no shuffle. Null and
    empty pages, and pages without text, have an empty text. Pages are taken
    whole, whatever their length; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, SCHEMA)
