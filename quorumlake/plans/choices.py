"""Queries of choices among links, sessions, photos and waits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import choices as H
from ..operators import members as M
from .catalog import query


@query(
    "calendar_links",
    """SELECT part, CASE WHEN part % 5 = 0 THEN '' WHEN part % 3 = 0 THEN 'https://s.ca/en/calendar/Senate-Calendar-' || y || '.PDF' ELSE 'https://s.ca/x/senate/calendar.pdf' END AS linked,
       CASE WHEN part % 4 = 0 THEN '' WHEN part % 4 = 1 THEN 'https://p.ca/' || y || '/Parliamentary-calendar.pdf' ELSE 'http://p.ca/parliamentary_x_calendar1.pdf' END AS named FROM (SELECT part, 2000 + part % 30 AS y FROM bills)""",
)
def calendar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page has no calendar of the upper house, every third the year's; every fourth no named calendar, or the year's behind another."""
    p, y = F.col("part"), F.col("year")
    year = y.cast("string")
    links = F.concat(F.lit("<a href='budget.pdf'><a href='/x/senate/other.pdf'>"), F.when(p % 5 != 0, F.lit('<a HREF="/x/senate/calendar.pdf">')).otherwise(""), F.when((p % 5 != 0) & (p % 3 == 0), F.concat(F.lit("<a href='Senate-Calendar-"), year, F.lit(".PDF'>"))).otherwise(""))
    named = F.when(p % 4 == 0, "https://p.ca/parliamentary.pdf").otherwise(F.concat(F.lit("see http://p.ca/parliamentary_x_calendar1.pdf"), F.when(p % 4 == 1, F.concat(F.lit(" or https://p.ca/"), year, F.lit("/Parliamentary-calendar.pdf."))).otherwise("")))
    b = V.bills(spark, sf_dir).select("part", (2000 + p % 30).cast("int").alias("year"), links.alias("links"))
    return b.select("part", H.linked_calendar(F.col("links"), F.lit("https://s.ca/en/calendar/"), y).alias("linked"), H.named_calendar(named, y).alias("named"))


@query(
    "best_sessions",
    """SELECT supplier AS id, max({'score': score, 'legislature': legislature, 'session': session}).legislature AS legislature, max({'score': score, 'legislature': legislature, 'session': session}).session AS session
       FROM (SELECT sponsor_id AS supplier, part % 3 AS score, part % 5 AS legislature, part % 7 AS session FROM bills) GROUP BY 1""",
)
def best_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part")
    told = F.collect_set(F.struct((p % 7).alias("session"), (p % 5).alias("legislature"), (p % 3).alias("score")))
    best = V.bills(spark, sf_dir).groupBy(F.col("sponsor_id").alias("id")).agg(H.best_session(told).alias("x"))
    return best.select("id", "x.legislature", "x.session")


@query(
    "member_photos",
    """SELECT id, CASE id % 5 WHEN 0 THEN 'https://a.ca/p.jpg' WHEN 1 THEN 'https://m.ca/a/p' || id || '.jpg' WHEN 2 THEN CASE WHEN id % 2 = 0 THEN 'late' ELSE '' END WHEN 3 THEN CASE WHEN id % 2 = 0 THEN 'late' ELSE '' END ELSE 'https://m.ca/p.jpg' END AS photo_url,
       CASE id % 6 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 0 END AS wait, CASE WHEN id % 60 IN (5, 10, 25, 50) THEN id % 60 ELSE 10 END AS page_size FROM members""",
)
def member_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of members, absolute, relative to their pages or missing; two of five are filled by name where the list has it, in another case and with a title."""
    i = F.col("id")
    pick = lambda *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    photo = pick(" https://a.ca/p.jpg ", F.concat(F.lit("p"), i.cast("string"), F.lit(".jpg")), "", "x.jpg", "/p.jpg")
    page = F.when(i % 5 == 3, "").otherwise("https://m.ca/a/b.html")
    m = V.members(spark, sf_dir).select("id", "name", H.photo_url(photo, page).alias("photo_url"))
    listed = m.where("id % 2 = 0").select(F.concat(F.lit("Hon. "), F.upper("name")).alias("name"))
    photos = listed.select(F.lit(1).alias("position"), "name", F.lit("early").alias("photo_url")).unionByName(listed.select(F.lit(2).alias("position"), "name", F.lit("late").alias("photo_url")))
    header = pick(" 30 ", "Sun, 06 Nov 1994 08:50:30 GMT", "Sun, 06 Nov 1994 08:48:00 GMT", "soon", "-5", "0")
    now = F.lit(784111740)  # 1994-11-06 08:49:00 UTC
    return M.with_photos(m, photos).select("id", "photo_url", H.retry_after(header, now).alias("wait"), H.page_size(i % 60).alias("page_size"))
