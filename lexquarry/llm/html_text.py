"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of a page is a line and each boundary of a dropped part (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), of an article or main element and of a doubtful part
leaves WINDOW empty lines. Text lengths (link text counts nothing outside articles and in doubtful parts) are summed over
sliding windows of WINDOW lines. Where these sums surge from zero a stretch of text begins, where they dive to zero it ends.
Text is kept between such points, by what the sums say:

* Stretches of one article or main element, and elsewhere stretches that share a parent element, are one unit; its
  weight is its highest sum. Units below SHARE of the heaviest are dropped: teasers beside an article, stray short texts.
* If an article or main element is among the units left, the units outside of such elements are dropped too. An
  article element that holds no more than a teaser of a page is thus no article.
* A part inside an article whose class or id is doubtful (a section ``discussion`` or ``related-work`` may be the
  author's, or a box of links) is kept if its highest sum, without link text, reaches SHARE of the median line of its article.

Within a block, character references are decoded, white space becomes one space and ends are trimmed; blocks are joined
in page order by one space. Nothing else is dropped or shortened. A header inside an article is part of it.

Defined results: null and empty html, and pages without text, give an empty string; markup may be broken (open
parts end with the element that holds them, however deep); pages of any length are read whole, one page at a time; units of equal
weight are treated alike; rows with equal or null page_id are extracted one by one; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frugal, table
from ._groups import Union

#: Lines in a window, and the share of the highest sum that text must reach.
WINDOW, SHARE = 3, 0.3

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation object select xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form button dialog menu canvas audio video fieldset".split())
MAIN = frozenset(["article", "main"])
#: Blocks that hold text rather than other blocks, and those that a further one of their kind ends.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr caption figcaption summary address".split())
ENDED = frozenset("p li dt dd tr td th option".split())
HOLDERS = frozenset("ul ol dl table div article section main".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
_BOUNDED = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
#: Words in a class or id that mark a part as none of the main text, and those that do so outside articles only.
_MARKS = re.compile(_BOUNDED.format(
    "ads?|adv|adverts?|advertisements?|adsense|banners?|promos?|promoted|sponsor(?:ed|s)?|sidebars?|side-bar|nav|navbar|navigation|menus?|breadcrumbs?|footer|site-header|page-header|masthead|"
    "cookies?|consent|gdpr|notices?|popups?|modal|newsletter|subscribe|subscription|social|comments?|comment-list|commentlist|replies|disqus|respond|login|signup|pagination|pager|topbar|toolbar|skip-link|paywall"), re.I)  # fmt: skip
_DOUBTFUL = re.compile(_BOUNDED.format("alerts?|share|sharing|related|recommended|search|widget|announcement|disclaimer|reviews?|discussion"), re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


def _hidden(a: dict[str, str]) -> bool:
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    return "style" in a and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I))


def _has(marks: re.Pattern, a: dict[str, str]) -> bool:
    return any(marks.search(_HUMP.sub("-", a[k])) for k in ("class", "id") if a.get(k))


def _marked(a: dict[str, str], inside: bool = False) -> bool:
    return bool(a) and (a.get("role", "").lower() in ROLES or _hidden(a) or _has(_MARKS, a) or (not inside and _has(_DOUBTFUL, a)))


class Line(NamedTuple):
    text: str
    length: int  # without link text where that counts nothing
    main: int  # the outermost article or main element around it; 0: none
    parent: int  # the element that holds its block
    doubtful: bool


class _Open(NamedTuple):
    name: str
    number: int
    dropped: bool
    main: int
    doubtful: bool


_NONE = _Open("", 0, False, 0, False)
_EMPTY = Line("", 0, 0, 0, False)


class _Stack:
    """Open elements; the last place of each name is known, so that no search walks down a deep page."""

    def __init__(self) -> None:
        self.open: list[_Open] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.made = 0

    @property
    def top(self) -> _Open:
        return self.open[-1] if self.open else _NONE

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def push(self, name: str, dropped: bool, main: int, doubtful: bool) -> None:
        self.made += 1
        self.places[name].append(len(self.open))
        self.open.append(_Open(name, self.made, dropped, self.made if main < 0 else main, doubtful))

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().name].pop()


def lines(page: str) -> list[Line]:
    """The page's lines in order; empty ones part what must not be one stretch."""
    out: list[Line] = []
    parts: list[str] = []
    stack = _Stack()
    links = link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            now = stack.top
            if not now.dropped and (text := " ".join(html.unescape("".join(parts)).split())):
                parent = next((e.number for e in reversed(stack.open) if e.name not in LEAVES), 0)
                whole = now.main and not now.doubtful
                out.append(Line(text, len(text) if whole else max(0, len(text) - link_chars), now.main, parent, now.doubtful))
            parts.clear()
        link_chars = 0

    def gap() -> None:
        flush()
        out.extend([_EMPTY] * WINDOW)

    def close(at: int, inline: bool) -> None:
        """End the element at this place and all in it."""
        then = stack.open[at - 1] if at else _NONE
        if stack.top[2:] != then[2:]:
            gap()
        elif not inline:
            flush()
        stack.cut(at)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not stack.top.dropped:
            parts.append(page[at:lt])
            link_chars += (lt - at) if links else 0
        if lt == end:
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:  # a bare '<'
            if not stack.top.dropped:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        name, now = m[2].lower(), stack.top
        if m[1]:
            if name == "a":
                links = 0
            found = stack.last(name)
            if found >= 0 and (name in MAIN or name in ("body", "html") or found > stack.last(*MAIN)):
                close(found, name in INLINE)
            elif name not in INLINE:
                flush()
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                ending = _END[name].search(page, at)
                at = ending.end() if ending else end
            continue
        if name in VOID:
            if name == "br" or name == "hr":
                parts.append(" ") if name == "br" else flush()
            continue
        attributes = _attributes(m[3])
        if name == "a":
            links = 1
        if name in INLINE:
            if now.dropped:
                stack.push(name, *now[2:])  # so that its end is not taken for that of the part
            elif _marked(attributes, bool(now.main)):
                flush()
                stack.push(name, True, now.main, now.doubtful)
            continue
        if name in MAIN:
            if now.dropped and any(e.dropped and e.name in ("div", "section", "span", "ul", "p") for e in stack.open):
                while stack.top.dropped:  # an unclosed dropped part ends where the article begins
                    stack.cut(len(stack.open) - 1)
                now = stack.top
            gap()
            bad = now.dropped or _hidden(attributes) or (name == "article" and now.main > 0 and _marked(attributes, True))
            stack.push(name, bad, now.main or -1, now.doubtful)
            continue
        if name in ENDED and (found := stack.last(name)) > stack.last(*HOLDERS):
            close(found, False)
            now = stack.top
        inside = bool(now.main)
        bad = (name in DROPPED and not (name == "header" and inside)) or (name not in ("html", "body") and _marked(attributes, inside))
        doubtful = now.doubtful or (inside and not bad and _has(_DOUBTFUL, attributes))
        if (bad and not now.dropped) or doubtful != now.doubtful:
            gap()
        else:
            flush()
        stack.push(name, now.dropped or bad, now.main or (-1 if attributes.get("role", "").lower() == "main" else 0), doubtful)
    flush()
    return out


def stretches(length: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, highest sum): the stretches of lines where sums over sliding windows are above zero."""
    if not len(length):
        return []
    sums = np.convolve(length, np.ones(window, "i8"))  # at i: lines i-window+1 .. i
    edges = np.flatnonzero(np.diff(np.r_[0, sums > 0, 0]))
    last = [np.flatnonzero(length[a:b])[-1] + a + 1 for a, b in zip(edges[::2], edges[1::2])]  # the dive: after it, sums only fall
    return [(int(a), int(b), int(sums[a : b + window - 1].max())) for a, b in zip(edges[::2], last)]


def chosen(found: list[Line], share: float = SHARE) -> list[tuple[int, int]]:
    """(surge, dive) of the stretches that are kept; see the module's text."""
    runs, unit, heads = stretches(np.array([x.length for x in found], "i8")), {}, []
    typical = defaultdict(list)
    for x in found:
        if x.main and x.length and not x.doubtful:
            typical[x.main].append(x.length)
    typical = {k: float(np.median(v)) for k, v in typical.items()}
    tree = Union(len(runs))
    for i, (a, b, _) in enumerate(runs):  # one unit: stretches of one article, or that share a parent
        heads.append(next(x for x in found[a:b] if x.text))
        for key in {("main", heads[i].main)} if heads[i].main else {x.parent for x in found[a:b] if x.text}:
            tree.join(unit.setdefault(key, i), i)
    weight = np.zeros(len(runs), "i8")
    for i, (_, _, top) in enumerate(runs):
        if not heads[i].doubtful:
            weight[tree.root(i)] = max(weight[tree.root(i)], top)
    heaviest = weight.max(initial=0)
    heavy = [weight[tree.root(i)] >= share * heaviest and weight[tree.root(i)] > 0 for i in range(len(runs))]
    within = any(h and x.main for h, x in zip(heavy, heads))
    sure = lambda i: not heads[i].doubtful or runs[i][2] >= share * typical.get(heads[i].main, 0)
    return [(a, b) for i, (a, b, _) in enumerate(runs) if heavy[i] and (heads[i].main or not within) and sure(i)]


def extract(page: str | None, share: float = SHARE) -> str:
    """The main text of a page; see the module's text."""
    if not page:
        return ""
    found = lines(page)
    return " ".join(found[i].text for a, b in chosen(found, share) for i in range(a, b) if found[i].text)


def texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [extract(p) for p in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    return narrow.mapInPandas(frugal(run), "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages"))
