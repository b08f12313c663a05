"""Pages as a table of elements, and the readers of votes and bills that need to know what lies inside what.

One linear pass over a page numbers its elements in document order. An element
has the number of the last one inside it, its parent's and, where asked for,
those of all elements around it, so `a contains b` is `a.node < b.node <= a.last`
or, as an equi-join that pairs nothing else, `a.node` among `b.around`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import ids as I
from ..functions import text as T

# Elements without an end tag; which open elements a start tag ends, and what keeps it from looking further out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CELL, _ROW, _PART = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("thead", "tbody", "tfoot", "caption", "colgroup"))
_ENDS = {"li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "option": (frozenset(("option",)), frozenset(("select", "datalist"))), "td": (_CELL, frozenset(("tr", "table"))), "th": (_CELL, frozenset(("tr", "table"))), "tr": (_CELL | _ROW, frozenset(("table",)))}
_ENDS |= {part: (_CELL | _ROW | _PART, frozenset(("table",))) for part in _PART}
_SCOPE = frozenset(("table", "td", "th", "caption", "template"))
_TABLE = _CELL | _ROW | _PART | {"table"}
#: Elements open at once; deeper ones become children of the last of these, as in browsers.
DEPTH = 512

Node = list  # tag, attributes, parent, last, first piece of text, piece after the last


class _Page(HTMLParser):
    def __init__(self, silent: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.silent, self.nodes, self.pieces, self.open = silent, [], [], []

    def _close(self, depth: int) -> None:
        for k in self.open[depth:]:
            self.nodes[k][3], self.nodes[k][5] = len(self.nodes) - 1, len(self.pieces)
        del self.open[depth:]

    def _find(self, tags: Iterable[str], barrier: Iterable[str]) -> int | None:
        """The outermost of the open elements above the barrier with one of the tags."""
        found = None
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[depth]][0]
            if tag in tags:
                found = depth
            elif tag in barrier:
                break
        return found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS:
            at = self._find(*_ENDS[tag])
        else:
            at = self._find(("p",), _SCOPE) if tag in _BLOCKS else None
        if at is not None:
            self._close(at)
        if len(self.open) >= DEPTH:
            self._close(DEPTH - 1)
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        self.nodes.append([tag, known, self.open[-1] if self.open else -1, len(self.nodes), len(self.pieces), len(self.pieces)])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        barrier = frozenset(("table",)) if tag in _TABLE and tag != "table" else () if tag in ("table", "body", "html") else _SCOPE
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.nodes[self.open[depth]][0]
            if name == tag:
                self._close(depth)
                return
            if name in barrier:
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.nodes[self.open[-1]][0] in self.silent):
            self.pieces.append(data)


# Text and the tag after it, where the tag is plain: attributes in quotes without references; of the elements whose text isn't markup only scripts, styles and titles without anything like their own tags.
_ATTRIBUTE = r"""[ \t\n\r\f]+([A-Za-z][A-Za-z0-9_-]*)=(?:"([^"<>&]*)"|'([^'<>&]*)')"""
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_PLAIN = re.compile(rf"""([^<]*+)<(?:(?:!doctype|!DOCTYPE)[^<>]*|(script|style)>((?:[^<]|<(?!/?s[ct]|!))*+)</\2|(title)>([^<]*)</title|(/?)([A-Za-z][A-Za-z0-9]*)((?:{re.sub(r"[(](?![?])", "(?:", _ATTRIBUTE)})*)[ \t\n\r\f]*)>""")
_VERBATIM = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext svg math".split())


def _read_plain(page: _Page, html: str) -> bool:
    """Whether the page has plain tags alone; then they are read, several times as fast as by the parser and alike."""
    at = 0
    while m := _PLAIN.match(html, at):
        at = m.end()
        text, whole, inner, title, name, end, tag, attrs = m.groups()
        if text:
            page.handle_data(unescape(text) if "&" in text else text)
        if whole or title:
            page.handle_starttag(whole or title, [])
            if inner or name:
                page.handle_data(inner or unescape(name))
            page.handle_endtag(whole or title)
        elif tag:
            tag = tag.lower()
            if tag in _VERBATIM:
                return False
            if end:
                if attrs:
                    return False
                page.handle_endtag(tag)
            else:
                page.handle_starttag(tag, [(key.lower(), a or b) for key, a, b in _ATTRIBUTES.findall(attrs)] if attrs else [])
    if html.find("<", at) >= 0:
        return False
    if at < len(html):
        page.handle_data(unescape(html[at:]))
    return True


def parsed(html: str | None, silent: frozenset[str] = frozenset()) -> tuple[list[Node], list[str]]:
    """(nodes, pieces of text) of a page; the text of silent elements is left out."""
    page = _Page(silent)
    if not _read_plain(page, html or ""):
        page = _Page(silent)
        page.feed(html or "")
        page.close()
    page._close(0)
    return page.nodes, page.pieces


Fits = Callable[[str, dict[str, str]], bool]


def elements(pages: DataFrame, key: str = "page_id", html: str = "html", texts: Iterable[str] | Fits | None = None, around: Iterable[str] = (), silent: Iterable[str] = (), only: Fits | None = None, kin: Fits | None = None, heads: Iterable[str] = ()) -> DataFrame:
    """key, node, last, parent (-1 at the top), tag, attrs, text and around of every element of every page.

    texts: tags (or a test of tag and attributes) whose text (all text inside, as
    it stands) is kept, all by default, else null; around: tags that get the
    numbers of the elements they lie in, from the outermost one, else null;
    silent: tags whose text counts nowhere; only: which elements get a row, all
    by default. kin: with it there are the columns above, next and head, which
    are null but for elements that it holds for: the text of the parent, of the
    next element under the same parent and of the last one before it there with a
    tag in `heads`.
    A null page and one without tags have no elements. Missing end tags are
    supplied for lists, table parts, options and paragraphs; an end tag without a
    start is passed over. Text outside all elements belongs to none.
    """
    kept = texts if callable(texts) else (lambda tag, attrs: True) if texts is None else frozenset(texts).__contains__
    keeps: Fits = kept if callable(texts) or texts is None else lambda tag, attrs: kept(tag)
    outer, quiet, titles = frozenset(around), frozenset(silent), frozenset(heads)
    kind = pages.schema[key].dataType.simpleString()
    schema = f"key {kind}, node int, last int, parent int, tag string, attrs map<string,string>, text string, around array<int>" + (", above string, next string, head string" if kin else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        types = [None, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.list_(pa.int32()), *[pa.string()] * (3 if kin else 0)]
        names = ["key", "node", "last", "parent", "tag", "attrs", "text", "around", *(("above", "next", "head") if kin else ())]

        def out(of: pa.DataType) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t or of) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return made

        for batch in batches:
            of, size = batch.schema.field(0).type, 0
            for page, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes, pieces = parsed(source.as_py(), quiet)
                said = lambda k, nodes=nodes, pieces=pieces: "".join(pieces[nodes[k][4] : nodes[k][5]])
                follows, head = _siblings(nodes, titles) if kin else ({}, {})
                for k, node in enumerate(nodes):
                    if only and not only(node[0], node[1]):
                        continue
                    text = said(k) if keeps(node[0], node[1]) else None
                    row = (page, k, node[3], node[2], node[0], list(node[1].items()), text, _above(nodes, k) if node[0] in outer else None)
                    if kin:
                        row += tuple(said(at) if at is not None and at >= 0 else None for at in (node[2], follows.get(k), head.get(k))) if kin(node[0], node[1]) else (None,) * 3
                    rows.append(row)
                    size += len(text or "") + (sum(len(x or "") for x in row[8:]))
                    if len(rows) >= 4096 or size > 1 << 22:  # bounded batches, also of a page with many elements
                        yield out(of)
                        size = 0
            if rows:
                yield out(of)

    made = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(read, schema)
    return made.withColumnRenamed("key", key)


def _siblings(nodes: list[Node], heads: frozenset[str]) -> tuple[dict[int, int], dict[int, int]]:
    """(the next element under the same parent, the last one before with a tag in heads) of each element that has one."""
    follows: dict[int, int] = {}
    head: dict[int, int] = {}
    last: dict[int, int] = {}
    title: dict[int, int] = {}
    for k, node in enumerate(nodes):
        if node[2] in last:
            follows[last[node[2]]] = k
        if node[2] in title:
            head[k] = title[node[2]]
        last[node[2]] = k
        if node[0] in heads:
            title[node[2]] = k
    return follows, head


def _above(nodes: list[Node], k: int) -> list[int]:
    out, k = [], nodes[k][2]
    while k >= 0:
        out.append(k)
        k = nodes[k][2]
    return out[::-1]


def attribute(name: str) -> Column:
    """The value of an element's attribute, '' without."""
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def has_class(name: str) -> Column:
    return F.array_contains(F.split(attribute("class"), r"\s+"), name)


# The words that head either side's count or names.
YEA_WORDS, NAY_WORDS = ("yea", "aye", "pour"), ("nay", "contre")
_YEAS, _NAYS = r"(?i)(?:yeas?|ayes?|pour)\D*(\d+)", r"(?i)(?:nays?|contre)\D*(\d+)"
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "p")
_BOXES = ("table", "section", "article", "div")
_ENTRIES = ("li", "td", "p")
_ASKED = frozenset((*_BOXES, *_ENTRIES))


def _count(pattern: str) -> Column:
    return F.coalesce(F.regexp_extract("said", pattern, 1).try_cast("int"), F.lit(0))


def contained_votes(pages: DataFrame, province: str, legislature: int, session: int, today: str) -> tuple[DataFrame, DataFrame]:
    """(divisions, votes) of pages (page_id, html, date) in which a box counts yeas and nays, whatever its layout.

    divisions: page_id, id, number, date, description, yeas, nays, result of each
    table, section, article or division element whose text has both counts, not
    both 0, in document order; boxes whose text starts with the same 200
    characters count once. date: the first one in the text, else the page's, else
    `today`; description: the nearest heading or paragraph before the box under
    the same parent, else the text's beginning.
    votes: page_id, id, name, vote of each entry (list item, cell, paragraph) inside
    that is a name and whose parent's text says on which side, each once by side and name.
    """
    keyed = pages.where("page_id is not null").select(F.struct("page_id", "date").alias("page"), "html")
    page = elements(keyed, "page", texts=(*_BOXES, *_ENTRIES), around=_ENTRIES, only=lambda tag, _: tag in _ASKED, kin=lambda tag, _: tag in _ASKED, heads=_HEADINGS)
    # texts are collapsed once: a filter next to the projection would do it anew for each of its terms
    page = page.select("page.page_id", F.col("page.date").alias("_day"), "node", "tag", "around", F.inline(F.array(F.struct(T.collapse("text").alias("said"), F.upper(T.collapse("above")).alias("up"), T.collapse("head").alias("head")))))

    said, up = F.upper("said"), F.col("up")
    holds = lambda c, words: F.lit(False) if not words else holds(c, words[1:]) | c.contains(words[0].upper())
    date = F.coalesce(F.nullif(D.in_text(F.col("said")), F.lit("")), F.nullif("_day", F.lit("")), F.lit(today))
    start = F.left("said", F.lit(200))
    box = F.struct(start.alias("start"), _count(_YEAS).alias("yeas"), _count(_NAYS).alias("nays"), date.alias("date"), F.coalesce(F.nullif("head", F.lit("")), start).alias("description"))
    box = F.when(F.col("tag").isin(*_BOXES) & F.col("said").rlike(_YEAS) & F.col("said").rlike(_NAYS), box)
    side = F.when(holds(up, YEA_WORDS), "Yea").when(holds(up, NAY_WORDS), "Nay")
    named = F.col("tag").isin(*_ENTRIES) & (F.octet_length("said") >= 3) & ~holds(said, (*(w for w in YEA_WORDS if w != "aye"), *NAY_WORDS))
    entry = F.when(named, T.once(side, lambda v: F.when(v.isNotNull(), F.struct(F.col("said").alias("name"), v.alias("vote"), "around"))))
    # the page goes on with what is asked of each element only; everything below is by page, so it is shuffled once and joined with nothing
    found = page.select("page_id", "node", F.inline(F.array(F.struct(box.alias("box"), entry.alias("entry")))))

    def numbered(rows: DataFrame) -> DataFrame:
        """Rows with number and id where a box counts, in the order of the page; of boxes that start alike the first one."""
        first = F.row_number().over(W.partitionBy("page_id", "box.start").orderBy("node")) == 1
        rows = rows.withColumn("_kept", F.col("box").isNotNull() & first & (F.col("box.yeas") + F.col("box.nays") > 0))
        rows = rows.withColumn("number", F.when(F.col("_kept"), F.count_if("_kept").over(W.partitionBy("page_id").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")))
        return rows.withColumn("id", F.when(F.col("_kept"), I.provincial_division_id(F.lit(province), F.lit(legislature), F.lit(session), F.col("box.date"), F.col("number"))))

    told = numbered(found.where("box is not null")).where("_kept")
    result = F.when(F.col("box.nays") > F.col("box.yeas"), "Negatived").otherwise("Carried")
    divisions = told.select("page_id", "id", "number", "box.date", "box.description", "box.yeas", "box.nays", result.alias("result"))

    inside = numbered(found.where("box is not null or entry is not null"))
    boxes = F.collect_list(F.when(F.col("_kept"), F.struct("node", "id"))).over(W.partitionBy("page_id").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = inside.withColumn("_boxes", boxes).where("entry is not null")  # a box stands before what lies in it
    ballots = inside.select("page_id", "node", "entry.name", "entry.vote", F.explode(F.filter("_boxes", lambda b: F.array_contains("entry.around", b["node"]))["id"]).alias("id"))
    ballots = ballots.groupBy("page_id", "id", "vote", F.lower("name")).agg(F.min_by("name", "node").alias("name")).select("page_id", "id", "name", "vote")
    return divisions, ballots


# What an element's id holds for each stage, in the order they are looked for.
ANCHORS = [("1st_reading", ("firstreading", "1st-reading", "first-reading")), ("2nd_reading", ("secondreading", "2nd-reading", "second-reading")), ("committee", ("committee",)), ("3rd_reading", ("thirdreading", "3rd-reading", "third-reading")), ("royal_assent", ("royalassent", "royal-assent"))]


def bill_pages(pages: DataFrame, host: str) -> tuple[DataFrame, DataFrame]:
    """(details, stages) of bills' pages (bill_id, html).

    stages: bill_id, stage, position, date of each element whose id names a stage,
    in the order of stages and of the page. A date is looked for in the element's
    own text, in the next element's under the same parent and in the parent's.
    details: bill_id, current_status, current_stage (the last one), sponsor_id,
    bill_type, introduced_date (of the first reading), full_text_url: what the
    page has first of each, '' without.
    """
    words = [part for _, parts in ANCHORS for part in parts]
    named = lambda tag, attrs: any(w in attrs.get("id", "").lower() for w in words)
    asked = lambda tag, attrs: tag == "a" or "class" in attrs or named(tag, attrs)
    page = elements(pages, "bill_id", texts=lambda tag, attrs: "class" in attrs or named(tag, attrs), around=("a",), only=asked, kin=named)
    name = F.lower(attribute("id"))
    stage, place = F, F
    for k, (stage_name, parts) in enumerate(ANCHORS):
        fits = F.lit(False)
        for part in parts:
            fits = fits | name.contains(part)
        stage, place = stage.when(fits, F.lit(stage_name)), place.when(fits, F.lit(k))
    day = lambda c: T.once(D.in_text(T.collapse(F.col(c))), lambda d: F.when(d != "", d))
    date = F.coalesce(day("text"), day("next"), day("above"), F.lit(""))
    sponsor = has_class("bill-profile-sponsor") | attribute("class").contains("sponsor")
    href = attribute("href")
    link = F.when(href.startswith("/"), F.concat(F.lit(host), href)).otherwise(href)
    when = lambda fits, what: F.when(fits, F.struct("node", what.alias("x")))
    read = page.select(
        "bill_id", F.when(stage.isNotNull(), F.struct(place.alias("place"), "node", stage.alias("stage"), date.alias("date"))).alias("staged"),
        F.when(sponsor, F.col("node")).alias("box"), F.when(F.col("tag") == "a", F.struct("node", T.once(href, lambda u: F.nullif(I.member_id_from_url(u), F.lit(""))).alias("x"), "around")).alias("link"),
        when(has_class("bill-latest-activity") | has_class("bill-progress-current"), T.collapse("text")).alias("status"), when(has_class("bill-type") | attribute("class").contains("billType"), T.collapse("text")).alias("type"),
        when((F.col("tag") == "a") & href.contains("DocumentViewer") & href.contains("first-reading"), link).alias("url"),
    )
    each = read.groupBy("bill_id").agg(*[F.collect_list(c).alias(c) for c in ("staged", "box", "link", "status", "type", "url")])
    staged = each.select("bill_id", F.posexplode(F.array_sort("staged")).alias("_at", "x")).select("bill_id", "x.stage", (F.col("_at") + 1).alias("position"), "x.date")
    first = lambda found: F.array_min(found)["x"]
    member = first(F.transform(F.filter("link", lambda a: a["x"].isNotNull() & F.arrays_overlap(a["around"], "box")), lambda a: F.struct(a["node"].alias("node"), a["x"].alias("x"))))
    introduced = F.array_min(F.filter("staged", lambda e: e["place"] == 0))["date"]
    seen = each.select("bill_id", first("status").alias("current_status"), F.array_max("staged")["stage"].alias("current_stage"), member.alias("sponsor_id"), first("type").alias("bill_type"), introduced.alias("introduced_date"), first("url").alias("full_text_url"))
    out = pages.select("bill_id").distinct().join(seen, "bill_id", "left")
    columns = ("current_status", "current_stage", "sponsor_id", "bill_type", "introduced_date", "full_text_url")
    return out.select("bill_id", *[F.coalesce(c, F.lit("")).alias(c) for c in columns]), staged
