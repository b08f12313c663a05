"""Rows of vote indexes, vote details, bill lists and vote reports in landed pages and texts.

Everything is SQL functions on the page's text: rows and cells are found by
their tags, a page with no rows or a null page gives none. Rows that name one
key several times count once, the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import ids as I
from ..functions import text as T

# What a vote cell may say and which vote that is; other cells aren't votes.
CELLS = {"yea": "Yea", "yeas": "Yea", "nay": "Nay", "nays": "Nay", "paired": "Paired"}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def plain(html: Column) -> Column:
    """The text of a piece of a page: tags out, the common character references decoded."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, mark in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(mark))
    return T.collapse(out)


def table_rows(page: Column, least: int) -> Column:
    """array<array<string>>: the cells' inner text of each table row with `least` cells or more; of such grid rows where there is none."""
    cells = F.filter(F.transform(_all(page, r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), lambda r: _all(r, r"(?is)<td\b[^>]*>(.*?)</td\s*>")), lambda r: F.size(r) >= least)
    cut = lambda t, role: F.slice(F.split(t, rf"""(?i)<[a-z]+\b[^>]*\brole=["']{role}["'][^>]*>"""), 2, 1 << 20)
    grid = F.transform(cut(F.coalesce(page, F.lit("")), "row"), lambda r: cut(r, "gridcell"))
    return T.once(cells, lambda c: F.when(F.size(c) > 0, c).otherwise(F.filter(grid, lambda r: F.size(r) >= least)))


def _number(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\D", "").try_cast("int"), F.lit(0))


def vote_index(pages: DataFrame, parliament: int, session: int, host: str) -> DataFrame:
    """page_id, id, number, date, bill_number, description, yeas, nays, paired, result, detail_url of each row with five cells or more.

    Cells: number with link, type, description, 'yeas / nays / paired', result, date.
    """

    def row(c: Column, pos: Column) -> Column:
        texts = F.array(*[F.coalesce(plain(F.try_element_at(c, F.lit(k))), F.lit("")) for k in range(1, 7)])
        link = F.regexp_extract(c[0], r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["']""", 1)
        return T.once(F.struct(texts.alias("t"), F.split(texts[3], "/").alias("n"), F.regexp_replace(texts[0], r"\D", "").alias("digits"), I.bill_number(texts[1]).alias("bill"), link.alias("link")), lambda x: fields(x, pos))

    def fields(x: Column, pos: Column) -> Column:
        at, link = lambda k: x["t"][k - 1], x["link"]
        part = lambda k: _number(F.coalesce(F.try_element_at(x["n"], F.lit(k)), F.lit("")))
        bill = F.when(x["bill"] != "", x["bill"]).otherwise(I.bill_number(at(3)))
        url = F.when((link == "") | link.startswith("http"), link).otherwise(F.concat(F.lit(host), link))
        return F.struct(pos.alias("pos"), F.coalesce(x["digits"].try_cast("int"), F.lit(0)).alias("number"), (x["digits"] != "").alias("_ok"), D.in_text(at(6)).alias("date"), bill.alias("bill_number"), at(3).alias("description"), part(1).alias("yeas"), part(2).alias("nays"), part(3).alias("paired"), at(5).alias("result"), url.alias("detail_url"))

    found = pages.select("page_id", F.inline(F.transform(table_rows(F.col("html"), 5), row)))
    found = found.where("_ok").withColumn("id", I.division_id(F.lit(parliament), F.lit(session), F.col("number")))
    first = found.groupBy("page_id", "id").agg(F.min_by(F.struct("number", "date", "bill_number", "description", "yeas", "nays", "paired", "result", "detail_url"), "pos").alias("x"))
    return first.select("page_id", "id", "x.*")


def vote_detail(pages: DataFrame) -> DataFrame:
    """division_id, member_id, vote of each row whose first cell links to a member and whose third says a vote."""
    votes = F.create_map(*[F.lit(x) for kv in CELLS.items() for x in kv])
    said = lambda c: F.try_element_at(votes, F.lower(plain(c[2])))
    row = lambda c: F.struct(I.member_id_from_url(F.regexp_extract(c[0], r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["']""", 1)).alias("member_id"), said(c).alias("vote"))
    return pages.select("division_id", F.inline(F.transform(table_rows(F.col("html"), 3), row))).where("member_id <> '' and vote is not null").distinct()


def bill_links(pages: DataFrame, province: str, legislature: int, session: int) -> DataFrame:
    """page_id, id, number, title, href, date of each bill that a list's item links to; the date stands in the item's text."""
    item = F.explode(_all(F.col("html"), r"(?is)<li\b[^>]*>(.*?)(?=<li\b|</ul|</ol|\z)")).alias("item")
    rows = pages.select("page_id", item).withColumn("href", F.regexp_extract("item", r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["']""", 1)).where("href <> ''")
    said = plain(F.regexp_extract("item", r"(?is)<a\b[^>]*>(.*?)</a", 1))
    number = F.coalesce(F.nullif(I.provincial_bill_number(F.concat_ws(" ", said, "href")), F.lit("")), F.nullif(I.provincial_bill_number(plain(F.col("item"))), F.lit("")), F.regexp_extract("href", r"(?i)/bills?/(\d+)", 1))
    rows = rows.select("page_id", "href", number.alias("number"), said.alias("_said"), D.in_text(plain(F.col("item"))).alias("date")).where("number <> ''")
    title = T.collapse(F.regexp_replace("_said", r"(?i)^bill\s+(?:no\.?\s*)?[a-z]?[\s-]?\d+[a-z]?\s*[:\-–—]?\s*", ""))
    rows = rows.withColumn("id", I.provincial_bill_id(F.lit(province), F.lit(legislature), F.lit(session), F.col("number"))).withColumn("title", F.when(title != "", title).otherwise(F.concat(F.lit("Bill "), "number")))
    return rows.groupBy("page_id", "id").agg(F.min_by(F.struct("number", "title", "href", "date"), "href").alias("x")).select("page_id", "id", "x.*")


_HEAD = r"(?i)\byeas?\b[\s:.\-–—]*(\d+)"
_MARKED = r"(?i)\bnays?\b[\s:.\-–—]*(\d+)"


# Capitalised words of a report that are no names.
REPORT_WORDS = ("YEA", "YEAS", "NAY", "NAYS", "MR", "MS", "MRS", "HON", "THE", "CARRIED", "DEFEATED", "DIVISION", "TOTAL")


def surnames(text: Column) -> Column:
    """Capitalised words of a list of names, each once, without words of the report itself."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[\s\u00a0]+"), T.vote_token), lambda w: w.rlike(r"^[A-Z].") & ~F.upper(w).isin(*REPORT_WORDS)))


def vote_counts(texts: DataFrame) -> DataFrame:
    """text_id, number, yeas, nays, result, yea_names, nay_names: the divisions that a report's text counts as yeas and nays, in order.

    A section goes from one count of yeas to the next; names are its capitalised
    words after either count, each once, without words of the report itself.
    """
    parts = F.split(F.regexp_replace("text", r"(?i)(\byeas?\b[\s:.\-–—]*\d+)", "\u0001$1"), "\u0001")
    rows = texts.select("text_id", F.posexplode(F.slice(parts, 2, 1 << 20)).alias("pos", "s"))
    rows = rows.withColumns({"yeas": F.regexp_extract("s", _HEAD, 1).try_cast("int"), "nays": F.regexp_extract("s", _MARKED, 1).try_cast("int")}).where("yeas is not null and nays is not null and yeas + nays > 0")
    names = lambda t: surnames(F.regexp_replace(t, r"(?i)^\W*(?:yeas?|nays?)\b[\s:.\-–—]*\d+", " "))
    cut = F.regexp_instr("s", F.lit(_MARKED))
    number = F.row_number().over(W.partitionBy("text_id").orderBy("pos"))
    result = F.when(F.col("nays") > F.col("yeas"), "Negatived").otherwise("Carried")
    return rows.select("text_id", number.alias("number"), "yeas", "nays", result.alias("result"), names(F.substring("s", F.lit(1), cut - 1)).alias("yea_names"), names(F.substring("s", cut, F.length("s"))).alias("nay_names"))


def _attribute(tag: Column, name: str) -> Column:
    """The quoted value of an attribute of a piece's first tag, else ''."""
    return F.regexp_extract(tag, rf"""(?is)^\s*<[a-z]+\b[^>]*?\s{name}\s*=\s*["']([^"']*)["']""", 1)


def _whole_cells(page: Column, least: int) -> Column:
    """array<array<string>>: the cells, each with its own tag, of table rows with `least` cells or more."""
    return F.filter(F.transform(_all(page, r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), lambda r: _all(r, r"(?is)(<td\b[^>]*>.*?)</td\s*>")), lambda r: F.size(r) >= least)


def upper_house_index(pages: DataFrame, parliament: int, session: int, host: str) -> DataFrame:
    """page_id, id, number, date, bill_number, description, yeas, nays, result, detail_url of each row of a page's first table.

    Cells: date, whose data-order ends in the number; title link with 'Yeas: n' and 'Nays: n'; bill; result.
    Rows with fewer cells or without a number above 0 are no divisions.
    """
    table = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<table\b.*?</table\s*>", 0)

    def row(c: Column) -> Column:
        titled = F.regexp_extract(c[1], r"(?is)<a\b[^>]*\bvote-web-title-link\b[^>]*>.*?</a", 0)
        parts = lambda a: F.struct(_attribute(a, "href").alias("link"), said(a).alias("said"), plain(c[1]).alias("t"))
        return T.once(T.once(titled, parts), lambda x: fields(c, x))

    def fields(c: Column, x: Column) -> Column:
        first = F.regexp_extract(c[1], r"(?is)<a\b[^>]*>.*?</a", 0)
        counted = lambda word: F.coalesce(F.regexp_extract(x["t"], rf"{word}:\s*(\d+)", 1).try_cast("int"), F.lit(0))
        link = x["link"]
        number = F.regexp_extract(_attribute(c[0], "data-order"), r"(?:^|\s)(\d+)\s*$", 1).try_cast("int")
        return F.struct(
            number.alias("number"), D.parse(plain(c[0])).alias("date"), I.bill_number(F.regexp_replace(plain(c[2]), r"\s", "")).alias("bill_number"), F.when(x["said"] != "", x["said"]).otherwise(said(first)).alias("description"),
            counted("Yeas").alias("yeas"), counted("Nays").alias("nays"), plain(c[3]).alias("result"), F.when((link == "") | link.startswith("http"), link).otherwise(F.concat(F.lit(host), link)).alias("detail_url"),
        )

    said = lambda a: plain(F.regexp_replace(a, r"(?i)</a$", ""))
    found = pages.select("page_id", F.inline(F.transform(_whole_cells(table, 4), row)))
    return found.where("number > 0").withColumn("id", F.concat(F.lit("senate-"), I.division_id(F.lit(parliament), F.lit(session), F.col("number"))))


def _marked(cell: Column) -> Column:
    """Whether a vote's cell is marked: by its sort key, a cross icon or a cross."""
    return (F.lower(F.trim(_attribute(cell, "data-order"))) == "aaa") | cell.rlike(r"""(?is)\bclass=["'][^"']*\bfa-times(?![\w-])""") | plain(cell).isin("×", "X", "&times;", "&#215;")


def _listed(page: Column, vote: str) -> Column:
    """Links in the lists of one vote: those of the first kind of list class that has any."""
    low = vote.lower()
    token = lambda name: rf"(?:[^\"']*\s)?{name}(?:\s[^\"']*)?"
    kinds = [(r"\w+", token(f"vote-{low}")), ("ul", token(low)), (r"\w+", rf"[^\"']*{vote}[^\"']*")]
    found = [F.flatten(F.transform(F.regexp_extract_all(page, F.lit(rf"""(?s)<({tag})\b[^>]*\bclass=["']{name}["'][^>]*>(.*?)</\1\s*>"""), F.lit(2)), lambda b: _all(b, r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["']"""))) for tag, name in kinds]
    pick = lambda rest: T.once(rest[0], lambda x: F.when(F.size(x) > 0, x).otherwise(pick(rest[1:]))) if rest else F.array().cast("array<string>")
    return pick(found)


def upper_house_detail(pages: DataFrame) -> DataFrame:
    """division_id, member_id, vote: from the rows of the table of votes, whose cells 4 to 6 mark yea, nay or abstention, else from lists of links by vote.

    A row without a member's link or a mark is no vote. A list ends with the first end tag of its kind.
    """
    html = F.coalesce("html", F.lit(""))
    table = F.regexp_extract(html, r"""(?is)<table\b[^>]*\bid=["']sc-vote-details-table["'].*?</table\s*>""", 0)
    c = lambda r, k: F.element_at(r, k)
    ballot = lambda href, vote: F.struct(I.upper_member_id(href).alias("member_id"), vote.alias("vote"))
    said = lambda r: F.when(_marked(c(r, 4)), "Yea").when(_marked(c(r, 5)), "Nay").when(_marked(c(r, 6)), "Abstain")
    rows = F.transform(_whole_cells(table, 6), lambda r: ballot(F.regexp_extract(c(r, 1), r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["']""", 1), said(r)))
    rows = F.filter(rows, lambda x: (x["member_id"] != "") & x["vote"].isNotNull())
    listed = lambda vote: F.transform(_listed(html, vote), lambda href: ballot(href, F.lit(vote)))
    lists = F.flatten(F.array(*[listed(vote) for vote in ("Yea", "Nay", "Abstain")]))
    return pages.select("division_id", F.inline(T.once(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(F.filter(lists, lambda x: x["member_id"] != "")))))


def vote_links(pages: DataFrame, matcher: str, most: int = 40) -> DataFrame:
    """page_id, link: the last `most`, in order of the address, of a page's links whose text or address matches; each once, resolved against the page's url."""
    anchor = F.explode(_all(F.col("html"), r"(?is)(<a\b[^>]*\bhref=.*?)</a\s*>")).alias("a")
    rows = pages.select("page_id", "url", anchor).withColumn("href", _attribute(F.col("a"), "href"))
    rows = rows.where(F.col("href") != "").where(F.concat_ws(" ", plain(F.col("a")), "href").rlike(matcher))
    rows = rows.select("page_id", I.resolved(F.col("url"), F.col("href")).alias("link")).distinct()
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("link")))).where(F.col("_n") <= most).drop("_n")


def _outcome(yeas: Column, nays: Column) -> Column:
    return F.when(nays > yeas, "Negatived").otherwise("Carried")


def two_column_votes(pages: DataFrame) -> DataFrame:
    """page_id, number, yeas, nays, result, yea_names, nay_names of each table headed YEAS and NAYS that names anybody, numbered in the page's order.

    A row's first cell is a yea and its second a nay, blank ones are nobody; rows with fewer cells don't count.
    """
    tables = F.filter(_all(F.col("html"), r"(?is)<table\b[^>]*>(.*?)</table\s*>"), lambda t: F.slice(F.transform(_all(t, r"(?is)<th\b[^>]*>(.*?)</th\s*>"), lambda h: F.upper(plain(h))), 1, 2) == F.array(F.lit("YEAS"), F.lit("NAYS")))
    rows = lambda t: F.filter(F.transform(_all(t, r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), lambda r: _all(r, r"(?is)<td\b[^>]*>(.*?)</td\s*>")), lambda c: F.size(c) >= 2)
    column = lambda r, k: F.filter(F.transform(r, lambda c: plain(c[k])), lambda n: n != "")
    both = lambda t: T.once(rows(t), lambda r: F.struct(column(r, 0).alias("yea_names"), column(r, 1).alias("nay_names")))
    sides = F.filter(F.transform(tables, both), lambda x: F.size(x["yea_names"]) + F.size(x["nay_names"]) > 0)
    found = pages.select("page_id", F.posexplode(sides).alias("k", "x")).select("page_id", (F.col("k") + 1).alias("number"), F.size("x.yea_names").alias("yeas"), F.size("x.nay_names").alias("nays"), "x.*")
    return found.withColumn("result", _outcome(F.col("yeas"), F.col("nays")))


def panel_votes(pages: DataFrame) -> DataFrame:
    """page_id, yeas, nays, yea_names, nay_names of each page: counts of the hidden fields nbPour and nbContre (0 without), members of the panels of either side.

    A member's name is that of the first span.nom, else all of the member's text; each name once, without regard to case.
    """
    field = lambda name: F.coalesce(F.regexp_extract(_attribute(F.regexp_extract(html, rf"""(?is)<input\b[^>]*\bid=["']{name}["'][^>]*>""", 0), "value"), r"^\s*(\d+)\s*$", 1).try_cast("int"), F.lit(0))

    def panel(name: str) -> Column:
        inside = F.regexp_extract(html, rf"""(?is)\bid=["'][^"']*_{name}["'][^>]*>(.*?)(?:<[a-z]+\b[^>]*\bid=["'][^"']*_pnl|\z)""", 1)
        members = F.regexp_extract_all(inside, F.lit(r"""(?is)<([a-z]+)\b[^>]*\bclass=["'](?:[^"']*\s)?depute(?:\s[^"']*)?["'][^>]*>(.*?)</\1\s*>"""), F.lit(2))
        alone = lambda m: plain(F.regexp_extract(m, r"""(?is)<span\b[^>]*\bclass=["'](?:[^"']*\s)?nom(?:\s[^"']*)?["'][^>]*>(.*?)</span\s*>""", 1))
        named = F.filter(F.transform(members, lambda m: T.once(alone(m), lambda n: F.when(n != "", n).otherwise(plain(m)))), lambda n: n != "")
        once = lambda x: F.filter(x["n"], lambda n, k: F.array_position(x["low"], x["low"][k]) == k + 1)
        return T.once(named, lambda n: T.once(F.struct(n.alias("n"), F.transform(n, F.lower).alias("low")), once))

    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", field("nbPour").alias("yeas"), field("nbContre").alias("nays"), panel("pnlPour").alias("yea_names"), panel("pnlContre").alias("nay_names"))


def dotted_votes(texts: DataFrame) -> DataFrame:
    """text_id, number, yeas, nays, result, yea_names, nay_names of the divisions that a text lists with dots before the counts; one that counts nobody is none.

    A text is cut after each dotted count: a piece that ends a list of AYE names,
    followed by one that begins with NAY, is a division.
    """
    pieces = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[.]{3,}\s*(\d{1,3})", "\u0001$1\u0002"), "\u0001")
    parts = F.transform(pieces, lambda p: F.split(p, "\u0002"))
    cut = lambda parts: F.transform(parts, lambda p, k: F.struct(F.when(k == 0, F.array_join(p, "\u0002")).otherwise(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("names"), F.get(F.get(parts, k + 1), F.lit(0)).try_cast("int").alias("n")))
    told = lambda cut: F.transform(cut, lambda x: F.struct(F.regexp_extract(x["names"], r"(?is)\bAYE\s+(.+)$", 1).alias("a"), F.regexp_extract(x["names"], r"(?is)^\s*NAY\b(.*)$", 1).alias("b"), x["names"].rlike(r"(?is)^\s*NAY\b").alias("ok"), x["n"].alias("n")))
    after = lambda told, k: F.get(told, k + 1)
    pairs = lambda told: F.transform(told, lambda x, k: F.struct(x["a"].alias("a"), x["n"].alias("yeas"), after(told, k)["b"].alias("b"), after(told, k)["n"].alias("nays"), after(told, k)["ok"].alias("ok")))
    found = T.once(T.once(T.once(parts, cut), told), pairs)
    rows = texts.select("text_id", F.posexplode(F.filter(found, lambda x: x["ok"] & (x["a"] != ""))).alias("pos", "x")).select("text_id", "pos", "x.*").where("yeas + nays > 0")
    number = F.row_number().over(W.partitionBy("text_id").orderBy("pos"))
    return rows.select("text_id", number.alias("number"), "yeas", "nays", _outcome(F.col("yeas"), F.col("nays")).alias("result"), surnames(F.col("a")).alias("yea_names"), surnames(F.col("b")).alias("nay_names"))
