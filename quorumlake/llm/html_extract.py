"""Main text of web pages by minimum-cut labelling.

A page becomes text blocks, the runs of text between block-level tags, with
their places in the element tree. A logistic classifier over a block's own
features (length, link share, punctuation, tag) gives log-odds, a block's
innermost marked ancestor (article or main; nav, footer, form, a class such as
"sidebar" or "site-footer", but not "has-sidebar") shifts them by a bounded
term, and the result is the block's capacity to the source
(content) or the sink (boilerplate). Neighbouring blocks, and next blocks of
one parent, are joined by smoothness edges that weaken with their distance in
the tree. Max-flow gives the cut of least cost; the source's side is content.
A mark is overruled where neighbours of one parent and a sure classifier
outweigh it; a mark alone or text alone doesn't decide.

The classifier is trained on a bounded sample of `fit_pages` pages, those with
the smallest hash of url; its labels are the marks, which it doesn't see.
Scripts, styles, comments and hidden elements never become blocks. Rows: a null
or empty page has the text ''; repeated rows give repeated rows; an empty table
gives none; other columns aren't read. Unclosed and stray tags are tolerated.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._store import table
from .quality import _ascend

FIT_PAGES = 400
FIT_CHARS = 200_000

# What HTML and common practice call things.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template iframe svg canvas textarea select button title head".split())
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split())
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())
OTHER_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split())
#: Words that a class name may have beside those above without changing what it says.
PLAIN_NAMES = frozenset("area bar block body bottom box container div element global inner item items left links list outer page post posts primary right row secondary section site text thread title top wrap wrapper".split())
OTHER_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Elements whose content is no markup; those that end without an end tag.
_RAW = frozenset("script style textarea title noscript iframe".split())
_OPEN_ENDED = frozenset("p li dt dd tr td th option".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?|=\s*(?:"[^"]*"|'[^']*')|.""", re.S)
_KEYS = re.compile(r"\b(?:class|id|role|itemprop|hidden|aria-hidden|style)\b", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Log-odds that a mark adds; smoothness of neighbours by tree distance, and of next blocks of one parent.
MAIN_SHIFT, OTHER_SHIFT = 5.0, -8.0
#: Bounds of the classifier's own log-odds.
LOW, HIGH = -4.0, 6.0
NEAR, FAR, SIBLING = 1.5, 0.3, 1.0


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    tag: str
    mark: int  # 1 main, -1 other, 0 unmarked
    parent: int
    depth: int


@lru_cache(1 << 14)
def _said(name: str) -> int:
    """What a whole class name says: 1 main, -1 other, 0 neither. All its words must be known."""
    names = {x.lower() for x in _NAME.findall(name)}
    if name.lower() in OTHER_NAMES or (names & OTHER_NAMES and names <= OTHER_NAMES | PLAIN_NAMES):
        return -1
    return int(name.lower() in MAIN_NAMES or (bool(names & MAIN_NAMES) and names <= MAIN_NAMES | PLAIN_NAMES))


def _mark(tag: str, attrs: str) -> tuple[int, bool]:
    """(mark, hidden) of an element by its own tag and attributes."""
    mark = 1 if tag in MAIN_TAGS else -1 if tag in OTHER_TAGS else 0
    hidden = False
    if attrs and _KEYS.search(attrs):
        seen = set()
        for m in _ATTR.finditer(attrs):
            key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
            if not key or key in seen:  # of attributes of one name the first counts
                continue
            seen.add(key)
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
            elif key == "role":
                mark = -1 if value in OTHER_ROLES else 1 if value in ("main", "article") else mark
            elif key in ("class", "id", "itemprop"):
                said = {_said(x) for x in value.split()}
                if tag not in MAIN_TAGS:
                    mark = -1 if -1 in said else mark or max(said, default=0)
    return mark, hidden


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, mark in force, number
    number, links, linked = 0, 0, 0
    text: list[str] = []

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            k = len(stack) - 1
            while k and stack[k][0] not in BLOCK_TAGS:
                k -= 1
            parent = stack[max(0, k - 1)][2]
            out.append(Block(joined, min(linked, len(joined)), stack[k][0], stack[-1][1], parent, k))
        text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = _html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if links:
                linked += len(plain)

    def pop_to(k: int) -> None:
        nonlocal links
        for tag, _, _ in stack[k:]:
            links -= tag == "a"
        del stack[k:]

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            k = len(stack) - 1
            while k and stack[k][0] != tag:
                if tag not in BLOCK_TAGS and stack[k][0] in BLOCK_TAGS:
                    k = 0  # an inline end tag doesn't close blocks
                    break
                k -= 1
            if k:
                pop_to(k)
            continue
        if tag == "br" or tag == "hr":
            text.append(" ")
            if tag == "hr":
                flush()
            continue
        mark, hidden = _mark(tag, attrs)
        if tag in SKIPPED_TAGS or (hidden and tag not in VOID_TAGS):
            if attrs.endswith("/"):
                continue
            at = _skip(page, at, tag)
            text.append(" ")
            continue
        if tag in VOID_TAGS:
            continue
        if tag in BLOCK_TAGS:
            flush()
            close = _CLOSES.get(tag, frozenset())
            k = len(stack) - 1
            while k and (stack[k][0] not in BLOCK_TAGS or stack[k][0] == "p" or stack[k][0] in close):
                k -= 1
            kept = [x for x in stack[k + 1 :] if x[0] not in BLOCK_TAGS and x[0] != "a"]
            if len(kept) < len(stack) - k - 1:
                pop_to(k + 1)
        number += 1
        if not attrs.endswith("/") or tag in BLOCK_TAGS:
            stack.append((tag, mark or stack[-1][1], number))
            links += tag == "a"
    flush()
    return out


def _skip(page: str, at: int, tag: str) -> int:
    """Past the end of a skipped element: raw text ends at its first end tag, others nest."""
    if tag == "head":
        m = re.compile(r"</head\s*>|(?=<body\b)", re.I).search(page, at)
        return m.end() if m else len(page)
    if tag in _RAW:
        m = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
        return m.end() if m else len(page)
    stack = [tag]
    while m := _MARKUP.search(page, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            k = _closed(stack, name)
            if k >= 0:
                del stack[k:]
            elif name in BLOCK_TAGS and tag in _OPEN_ENDED and name != "p":
                return m.start()  # the end of an element around one whose end tag may be left out
            if not stack:
                return at
            continue
        if name in BLOCK_TAGS:
            k = _implied(stack, name)
            if k == 0 and tag in _OPEN_ENDED:
                return m.start()
            del stack[max(1, k) :]
        if name in _RAW and not m[0].endswith("/>"):
            at = _skip(page, at, name)
        elif name not in VOID_TAGS and (not m[0].endswith("/>") or name in BLOCK_TAGS):
            stack.append(name)
    return len(page)


def _closed(stack: list[str], tag: str) -> int:
    """The place of the open element that an end tag closes, or -1; an inline end tag doesn't close blocks."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] == tag:
            return k
        if tag not in BLOCK_TAGS and stack[k] in BLOCK_TAGS:
            break
    return -1


def _implied(stack: list[str], tag: str) -> int:
    """How many open elements stay when a block tag opens, by the rules of blocks(): a p and what _CLOSES names end."""
    close = _CLOSES.get(tag, frozenset())
    k = len(stack)
    low = k
    while k and (stack[k - 1] not in BLOCK_TAGS or stack[k - 1] == "p" or stack[k - 1] in close):
        k -= 1
        if stack[k] in BLOCK_TAGS:
            low = k
    return low


def features(block: Block) -> list[float]:
    words = block.text.count(" ") + 1
    n = len(block.text)
    return [1.0, min(np.log1p(words), 6.0) - 2, block.linked / n, float(block.text[-1] in ".!?:;\"'»”…"), float(block.tag[:1] == "h" and block.tag[1:].isdigit()), float(block.tag == "p"), float(block.tag in ("li", "td", "th", "dd", "dt")), min(1.0, 10 * block.text.count(",") / words), sum(map(block.text.count, "0123456789")) / n]


#: Log-odds weights where the sample can't train them.
PLAIN = (-1.0, 0.8, -4.0, 0.8, 0.5, 1.0, -0.5, 0.5, -1.0)


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node with positive odds pays them when labelled False, one with negative when True, and an edge its weight when its ends differ. Dinic's algorithm."""
    n = len(odds)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, c: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(odds):
        if x > 0:
            join(s, i, x, 0.0)
        else:
            join(i, t, -x, 0.0)
    for a, b, w in edges:
        if w > 0:
            join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        here = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while here[a] < len(head[a]):
                e = head[a][here[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                here[a] += 1
            if here[a] < len(head[a]):
                path.append(head[a][here[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]


def label(found: list[Block], weights: tuple[float, ...] = PLAIN) -> list[bool]:
    """Which blocks are content."""
    if not found:
        return []
    x = np.array([features(b) for b in found])
    odds = np.clip(x @ np.array(weights), LOW, HIGH)
    odds = odds + np.array([MAIN_SHIFT if b.mark > 0 else OTHER_SHIFT if b.mark < 0 else 0.0 for b in found])
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR if found[i - 1].parent == b.parent else FAR / (1 + abs(found[i - 1].depth - b.depth))))
        k = last.get(b.parent)
        if k is not None and k != i - 1:
            edges.append((k, i, SIBLING))
        last[b.parent] = i
    if all(v > 0 for v in odds) or all(v <= 0 for v in odds):
        return [bool(v > 0) for v in odds]
    return min_cut(odds.tolist(), edges)


def extract(page: str | None, weights: tuple[float, ...] = PLAIN) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def train(pages: DataFrame, *, fit_pages: int = FIT_PAGES, fit_chars: int = FIT_CHARS) -> tuple[float, ...]:
    """Weights from the marked blocks of the sample; PLAIN where either label has under 20 blocks."""
    named = pages.where(F.length("html").between(1, fit_chars)).select(F.xxhash64("url", "html").alias("_h"), F.col("html"))
    least = [r[0] for r in named.select("_h").distinct().orderBy("_h").limit(fit_pages).collect()]  # hashes first, so that no task sends its own pages
    rows = sorted(named.where(F.col("_h").isin(least)).dropDuplicates(["_h"]).collect()) if least else []
    found = [b for r in rows for b in blocks(r[1]) if b.mark]
    y = np.array([b.mark > 0 for b in found], float)
    if not 20 <= y.sum() <= len(y) - 20:
        return PLAIN
    x = np.array([features(b) for b in found], np.float32)
    w, b = _ascend(x[:, 1:], y, 1e-2)
    return (float(b), *map(float, w))


def extracted(pages: DataFrame, weights: tuple[float, ...] = PLAIN) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "html"):
            text = [extract(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, train(pages))
