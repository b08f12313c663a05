"""Queries on tables of elements: given pages, votes and bills by what lies inside what, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..operators import elements as E
from .catalog import AS_OF, query, spread, votes_by_division

_TAGS = ("a", "div", "h1", "li", "nav", "p", "td")


@query(
    "page_elements",
    ", bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(script|style)[^>]*>).*?(</(script|style)>)', '\\1\\3', 'gs') AS html FROM pages) SELECT page_id, "
    + ", ".join(f"len(regexp_extract_all(html, '<{t}[\\s>/]'))::BIGINT AS n_{t}" for t in _TAGS)
    + " FROM bare",
)
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of some kinds every given page has."""
    found = E.elements(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), texts=())
    return found.groupBy("page_id").agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in _TAGS])


@query(
    "page_links",
    ", bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS html FROM pages), navs AS (SELECT page_id, unnest(regexp_extract_all(html, '<nav[^>]*>(.*?)</nav>', 1, 's')) AS nav FROM bare), links AS (SELECT page_id, unnest(regexp_extract_all(nav, '<a[^>]*href=\"([^\"]*)\"', 1)) AS href FROM navs) SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM links GROUP BY 1",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that lie in a navigation element of each given page, and their distinct addresses."""
    found = E.elements(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), texts=(), around=("a",))
    navs = found.where("tag = 'nav'").select("page_id", F.col("node").alias("box"))
    links = found.where("tag = 'a'").select("page_id", "node", E.attribute("href").alias("href"), F.explode("around").alias("box")).join(navs, ["page_id", "box"])
    return links.groupBy("page_id").agg(F.count_distinct("node").alias("links"), F.count_distinct("href").alias("targets"))


def _named_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, date, yeas, nays: divisions with the names of either side's members in order."""
    v = votes_by_division(spark, sf_dir).where("vote <> 'Paired'").withColumn("name", F.concat(F.lit("Ann-"), F.col("member_id").cast("string"), F.lit(" O'Lee")))
    sides = v.groupBy("division_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("vote") == x, F.col("name")))).alias(f"{x.lower()}s") for x in ("Yea", "Nay")])
    return V.divisions(spark, sf_dir).select("id", "date").join(sides, F.col("id") == F.col("division_id"))


def _vote_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section with a heading, a division element with the counts and lists or a nested table in it; end tags are missing where they may be."""
    d = _named_sides(spark, sf_dir)
    i, n = F.col("id"), lambda side: F.size(side).cast("string")
    items = lambda side, tag: F.array_join(F.transform(side, lambda m: F.concat(F.lit(f"\n<{tag}><b>"), F.replace(m, F.lit("'"), F.lit("&#39;")), F.lit("</b>"))), "")
    lists = F.concat(F.lit("<ul><em>YEAS</em> : "), n("yeas"), items("yeas", "li"), F.lit("</ul><ul>Nays&nbsp;"), n("nays"), items("nays", "LI"), F.lit("</ul>"))
    cells = F.concat(F.lit("<table><tr><th>Pour ("), n("yeas"), F.lit(")"), items("yeas", "td"), F.lit("<tr><th>Contre ("), n("nays"), F.lit(")"), items("nays", "td"), F.lit("</table>"))
    day = F.when(i % 2 == 0, F.date_format("date", "MMMM d, yyyy")).otherwise("")
    head = F.concat(F.lit("<!doctype html><title>Yeas 9 Nays 9</title><body><p>Earlier<h2>Votes of the day</h2>\n<section><h3>On  motion "), i.cast("string"), F.lit("</h3>"), day, F.lit(" <script>var a = '</p>';</script>"))
    html = F.concat(head, F.lit("<div>"), F.when(i % 3 == 0, cells).otherwise(lists), F.lit("</div><p>Ann Other</section><p>Nays 3"))
    return d.select(i.alias("page_id"), html.alias("html"), F.date_format(F.date_add("date", 1), "yyyy-MM-dd").alias("date"))


_NAMED = """, sides AS (SELECT d.id, d.date, count(*) FILTER (vote = 'Yea')::INT AS yeas, count(*) FILTER (vote = 'Nay')::INT AS nays FROM divisions d JOIN member_votes v ON v.division_id = d.id AND vote <> 'Paired' GROUP BY 1, 2),
  boxes AS (SELECT id AS page_id, unnest([1, 2]) AS number, yeas, nays, date FROM sides WHERE yeas + nays > 0),
  kept AS (SELECT page_id, number, yeas, nays, strftime(CASE WHEN number = 1 AND page_id % 2 = 0 THEN date ELSE date + 1 END, '%Y-%m-%d') AS date FROM boxes)"""


@query(
    "contained_divisions",
    f"""{_NAMED} SELECT page_id, 'xx-44-1-' || date || '-' || number AS id, number, date, CASE number WHEN 1 THEN 'Votes of the day' ELSE 'On motion ' || page_id END AS description, yeas, nays, CASE WHEN nays > yeas THEN 'Negatived' ELSE 'Carried' END AS result FROM kept""",
)
def contained_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contained_votes(_vote_pages(spark, sf_dir), "xx", 44, 1, AS_OF)[0]


@query(
    "contained_votes",
    f"""{_NAMED} SELECT page_id, 'xx-44-1-' || date || '-' || number AS id, 'Ann-' || member_id || ' O''Lee' AS name, vote FROM kept JOIN member_votes ON division_id = page_id AND vote <> 'Paired'
    UNION ALL SELECT page_id, 'xx-44-1-' || date || '-' || number, 'Ann Other', 'Yea' FROM kept WHERE number = 1""",
)
def contained_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contained_votes(_vote_pages(spark, sf_dir), "xx", 44, 1, AS_OF)[1]


_HOST = "https://bills.example.org"
_ORDER = ("1st_reading", "2nd_reading", "committee", "3rd_reading", "royal_assent")
_IDS = ("FirstReading", "x-2nd-reading", "sec-Committee", "third-reading-1", "RoyalAssent")


def _bill_html(b: DataFrame) -> Column:
    """Stages up to the current one, the last first; the date within, after or around; every fourth bill without a sponsor, every fifth without a text."""
    p = F.col("part")
    day = lambda k: F.date_format(F.date_add("introduced_date", 10 * k), "MMMM d, yyyy")
    upto = F.array_position(F.array(*[F.lit(x) for x in _ORDER]), F.col("current_stage"))
    stages = []
    for k, anchor in reversed(list(enumerate(_IDS))):
        inner = [F.concat(F.lit(f"<section><h2 id='{anchor}'>At <b>"), day(k), F.lit("</b></h2><p>May 1, 1901</section>")), F.concat(F.lit(f"<section>May 1, 1901<h2 id='{anchor}'>Stage</h2> <p>"), day(k), F.lit("</section>")), F.concat(F.lit(f"<ul><li><i id='{anchor}'></i><li>"), day(k), F.lit("</ul>"))]
        way = F.when(p % 3 == 0, inner[0]).when(p % 3 == 1, inner[1]).otherwise(F.concat(F.lit("<div>"), day(k), F.lit(f"<div id='{anchor}'>Stage</div> none</div>")))
        stages.append(F.when(upto > k, way).otherwise(""))
    member = lambda m: F.concat(F.lit("<a href='/Members/en/"), m.cast("string"), F.lit("'>X</a>"))
    sponsor = F.when(p % 4 == 0, member(F.lit(5))).otherwise(F.concat(F.lit("<div class='a Bill-sponsor-box'><p>By <a href='/elsewhere'>no</a><span>"), member(F.col("sponsor_id")), F.lit("</span></div>"), member(F.lit(6))))
    text = F.when(p % 5 == 0, "<a href='/DocumentViewer/en/second-reading'>x</a>").otherwise(F.concat(F.lit("<a HREF='/DocumentViewer/en/"), p.cast("string"), F.lit("/first-reading?a=1&amp;b=2'>View</a><a href='/DocumentViewer/first-reading/other'>x</a>")))
    return F.concat(F.lit("<html><body><nav id='menu'><a href='/'>Top</a></nav><div class='x bill-latest-activity'> At\n <b>"), F.col("current_stage"), F.lit("</b> </div><span class='my-billType'>Public&nbsp;Bill</span><div class='bill-type'>Other</div>"), *stages, sponsor, text)


def _bill_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spread(V.bills(spark, sf_dir).select("id", "part", "current_stage", "introduced_date", "sponsor_id"), "id")
    return b.select(F.col("id").alias("bill_id"), _bill_html(b).alias("html"))


_STAGED = f", upto AS (SELECT *, list_position([{', '.join(repr(x) for x in _ORDER)}], current_stage) AS n FROM bills)"


@query(
    "bill_details",
    f"""{_STAGED} SELECT id AS bill_id, 'At ' || current_stage AS current_status, current_stage, CASE WHEN part % 4 = 0 THEN '' ELSE sponsor_id::VARCHAR END AS sponsor_id, 'Public Bill' AS bill_type, strftime(introduced_date, '%Y-%m-%d') AS introduced_date,
      CASE WHEN part % 5 = 0 THEN '' ELSE '{_HOST}/DocumentViewer/en/' || part || '/first-reading?a=1&b=2' END AS full_text_url FROM upto""",
)
def bill_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bill_pages(_bill_pages(spark, sf_dir), _HOST)[0]


@query(
    "bill_detail_stages",
    f"""{_STAGED}, each AS (SELECT id AS bill_id, introduced_date, unnest(range(1, n + 1)) AS position FROM upto)
    SELECT bill_id, [{', '.join(repr(x) for x in _ORDER)}][position] AS stage, position::INT AS position, strftime(introduced_date + (10 * (position - 1))::INT, '%Y-%m-%d') AS date FROM each""",
)
def bill_detail_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bill_pages(_bill_pages(spark, sf_dir), _HOST)[1]
