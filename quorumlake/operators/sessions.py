"""The legislature and session that a province's pages speak of, by weighted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import elements as E

# Elements whose text is evidence.
_SAID = ("title", "h1", "h2", "h3", "h4", "h5", "a")
#: Weights of what a page's address, a heading and a link say.
ADDRESS, HEADING, LINK = 70, 90, 55
# How a legislature (first number) and a session (second) are written, in any province and in single ones, with the weight that the latter add.
_TH, _L, _S, _SEP = "(?:st|nd|rd|th)", r"(\d{1,3})", r"(\d{1,2})", "[-_/]"
FORMS: list[tuple[str | None, int, str]] = [
    (None, 0, rf"{_L}{_TH}\s*parliament[^\d]{{0,40}}{_S}{_TH}\s*session"),
    (None, 0, rf"{_L}{_TH}\s*(?:legislature|general assembly)[^\d]{{0,40}}{_S}{_TH}?\s*session"),
    (None, 0, rf"{_L}{_TH}?{_SEP}parliament{_SEP}{_S}{_TH}?{_SEP}session"),
    (None, 0, rf"assembly{_SEP}{_L}{_SEP}session{_SEP}{_S}(?:/|$)"),
    ("ab", 20, rf"legislature\s*,?\s*session\s+{_L}-{_S}"),
    ("ab", 20, rf"legislature\s+{_L}\s*,\s*session\s+{_S}"),
    ("ab", 20, rf"[?&]legl={_L}&session={_S}(?:[&#]|$)"),
    ("mb", 20, rf"/{_L}-{_S}(?:/|$)"),
    ("mb", 20, rf"\b{_L}\s*-\s*{_S}\s*\((?:\d{{4}}|current)"),
    ("qc", 15, rf"/{_L}-{_S}(?:/|$)"),
]
#: Forms that two bare numbers make are taken for a session only within these bounds.
_BARE = {("mb", 7), ("mb", 8), ("qc", 9)}
MOST_LEGISLATURE, MOST_SESSION = 99, 9
# What words around add; each set counts once.
TELLING = [(20, ("current", "overview", "active")), (10, ("latest", "today")), (-30, ("archive", "historical")), (-20, ("journal indices", "appendices"))]


def told(text: Column) -> Column:
    """What a text's words add to the weight of the sessions in it."""
    low, out = F.lower(text), F.lit(0)
    for weight, words in TELLING:
        found = F.lit(False)
        for word in words:
            found = found | low.contains(word)
        out = out + F.when(found, weight).otherwise(0)
    return out


def candidates(evidence: DataFrame) -> DataFrame:
    """code, legislature, session, score of every session written in evidence (code, text, weight); numbers of 0 aren't any."""
    text = F.coalesce("text", F.lit(""))

    def written(k: int, more: int, form: str) -> Column:
        bare = F.lit((FORMS[k][0], k) in _BARE)
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(f"(?i){form}"), F.lit(1)).alias("l"), F.regexp_extract_all(text, F.lit(f"(?i){form}"), F.lit(2)).alias("s"))
        return F.transform(both, lambda x: F.struct(x["l"].cast("int").alias("legislature"), x["s"].cast("int").alias("session"), (F.col("weight") + more).alias("score"), bare.alias("bare")))

    found = [written(k, more, form) for k, (_, more, form) in enumerate(FORMS)]
    found = [x if FORMS[k][0] is None else F.when(F.col("code") == FORMS[k][0], x).otherwise(F.slice(x, 1, 0)) for k, x in enumerate(found)]
    rows = evidence.select("code", told(text).alias("_told"), F.inline(F.flatten(F.array(*found))))
    rows = rows.where((F.col("legislature") > 0) & (F.col("session") > 0) & (~F.col("bare") | (F.col("legislature") <= MOST_LEGISLATURE) & (F.col("session") <= MOST_SESSION)))
    return rows.select("code", "legislature", "session", (F.col("score") + F.col("_told")).alias("score"))


def evidence(pages: DataFrame) -> DataFrame:
    """code, text, weight: the addresses, headings and links of pages (page_id, code, url, html)."""
    page = E.elements(pages, texts=_SAID, only=lambda tag, attrs: tag in _SAID and (tag != "a" or "href" in attrs)).join(pages.select("page_id", "code"), "page_id")
    link = F.col("tag") == "a"
    said = F.trim(F.when(link, F.concat(F.trim("text"), F.lit(" "), E.attribute("href"))).otherwise(F.col("text")))
    found = page.select("code", said.alias("text"), F.when(link, LINK).otherwise(HEADING).alias("weight"))
    return pages.where("url <> ''").select("code", F.col("url").alias("text"), F.lit(ADDRESS).alias("weight")).unionByName(found)


def resolve(pages: DataFrame, bills: DataFrame, constants: dict[str, tuple[int, int]]) -> DataFrame:
    """code, legislature, session, origin of every code among pages.

    origin: 'pages' for the session of the greatest score, of ties that of the
    greatest legislature and session; 'stored' for the greatest legislature and the
    greatest session, one by one, of bills (id, parliament, session) whose id starts
    with the code, where pages say nothing; 'constant', and 1 and 1 without one.
    """
    best = candidates(evidence(pages)).groupBy("code").agg(F.max(F.struct("score", "legislature", "session")).alias("x")).select("code", "x.legislature", "x.session")
    own = bills.groupBy(F.lower(F.substring_index("id", "-", 1)).alias("code")).agg(F.max("parliament").alias("_l"), F.max("session").alias("_s")).where("_l > 0 and _s > 0")
    known = [F.when(F.col("code") == c, F.struct(F.lit(l).alias("l"), F.lit(s).alias("s"))) for c, (l, s) in constants.items()]
    fixed = F.coalesce(*known, F.struct(F.lit(1).alias("l"), F.lit(1).alias("s")))
    out = pages.select("code").distinct().join(best, "code", "left").join(own, "code", "left").withColumn("_c", fixed)
    pick = lambda page, stored, constant: F.coalesce(page, stored, constant).cast("int")
    origin = F.when(F.col("legislature").isNotNull(), "pages").when(F.col("_l").isNotNull(), "stored").otherwise("constant")
    return out.select("code", origin.alias("origin"), pick(F.col("legislature"), F.col("_l"), F.col("_c.l")).alias("legislature"), pick(F.col("session"), F.col("_s"), F.col("_c.s")).alias("session"))


def chosen_option(pages: DataFrame) -> DataFrame:
    """page_id, value: of a page's (page_id, html, legislature, session) options in select.sessionLegislature the first that names both numbers, else the first; '' without.

    What an option says is its title and text; options without a value or with -1 don't count.
    """
    page = E.elements(pages, texts=("option",), around=("option",), only=lambda tag, _: tag in ("select", "option"))
    box = F.when((F.col("tag") == "select") & E.has_class("sessionLegislature"), F.col("node"))
    option = F.struct("node", F.trim(E.attribute("value")).alias("value"), F.concat_ws(" ", E.attribute("title"), "text").alias("said"), "around")
    each = page.groupBy("page_id").agg(F.collect_list(box).alias("_boxes"), F.collect_list(F.when(F.col("tag") == "option", option)).alias("_options"))
    options = each.select("page_id", "_boxes", F.inline("_options")).where("value not in ('', '-1') and arrays_overlap(around, _boxes)")
    options = options.join(pages.select("page_id", "legislature", "session"), "page_id")
    names = lambda n, word: F.regexp_like("said", F.concat(F.lit(r"(?i)\b"), n.cast("string"), F.lit(rf"{_TH}?\s+{word}\b")))
    fits = F.coalesce(names(F.col("legislature"), "legislature") & names(F.col("session"), "session"), F.lit(False))
    best = options.groupBy("page_id").agg(F.min_by("value", F.struct(~fits, "node")).alias("value"))
    return pages.select("page_id").join(best, "page_id", "left").select("page_id", F.coalesce("value", F.lit("")).alias("value"))
