"""Queries of sitting calendars in announced texts and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import schedules as S
from .catalog import query, spread


def _line(dates: Column) -> Column:
    return F.array_join(F.transform(dates, lambda d: d.cast("string")), " ")


def _texts(spark: SparkSession, sf_dir: str, *parts: str | Column) -> DataFrame:
    """part, year and a text of literal and computed parts for every bill."""
    b = spread(V.bills(spark, sf_dir).select("part"), "part").select("part", (1990 + F.col("part") % 40).cast("int").alias("year"))
    return b.withColumn("text", F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _days(start: str, end: str) -> str:
    return f"list_transform(generate_series({start}, {end}, INTERVAL 1 DAY), lambda x: x::DATE)"


_YEARS = "(SELECT part, (1990 + part % 40)::INT AS y FROM bills)"


@query(
    "schedules_with_exceptions",
    f"""SELECT part, CASE WHEN part % 6 = 0 THEN '' ELSE array_to_string(list_filter({_days("make_date(y, 2, 1 + part % 20)", "make_date(y, 12, 1 + part % 12)")},
      lambda x: isodow(x) < 5 AND NOT (x BETWEEN make_date(y, 3, 1 + part % 10) AND make_date(y, 3, 20)) AND NOT (x BETWEEN make_date(y, 4, 28) AND make_date(y, 5, 2 + part % 5)) AND x <> make_date(y, 7, 2)), ' ') END AS days FROM {_YEARS}""",
)
def schedules_with_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth text lists no exceptions for its year; the years before and after have lists of their own."""
    p, y = F.col("part"), F.col("year")
    before = ("<h2>Parliamentary calendar ", y - 1, "</h2> January 5, 1990 to May 1, 1990 with the following exceptions: May 1 ")
    span = ("<h2>PARLIAMENTARY\n Calendar ", y, "</h2> as of June 1, 1990: February ", 1 + p % 20, ", ", y, " to December ", 1 + p % 12, ", ", y)
    but = (F.when(p % 6 == 0, " without").otherwise(" With the following <b>exceptions</b>"), ": March ", 1 + p % 10, " to 20; April 28 to May ", 2 + p % 5, "; july 2, Smarch 9 ")
    t = _texts(spark, sf_dir, *before, *span, *but, "<p>Parliamentary calendar ", y + 1, " August 3 to 9")
    return t.select("part", _line(S.with_exceptions(F.col("text"), y)).alias("days"))


@query(
    "schedules_in_french",
    f"""SELECT part, array_to_string(list_sort(list_distinct(list_concat(
      list_filter({_days("make_date(y, 2, 1 + part % 20)", "make_date(y, 5, 31)")}, lambda x: isodow(x) BETWEEN 2 AND 4),
      CASE WHEN part % 4 > 0 THEN list_filter({_days("make_date(y, 5, 2)", "make_date(y, 6, 9)")}, lambda x: isodow(x) BETWEEN 2 AND 5) ELSE [] END,
      list_filter({_days("make_date(y, 8, 12)", "make_date(y, 8, 20 + part % 8)")}, lambda x: isodow(x) BETWEEN 2 AND CASE WHEN part % 4 > 0 THEN 5 ELSE 4 END)))), ' ') AS days FROM {_YEARS}""",
)
def schedules_in_french(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of other years, of unknown months and from later to earlier days count for nothing."""
    p, y = F.col("part"), F.col("year")
    plain = ("Travaux réguliers : ", 1 + p % 20, " février au 31 mai ", y, "; 3 brumaire au 9 mai ", y, "; 9 au 3 mars ", y, "; 1 au 5 mars ", y + 1, "\n")
    close = (F.when(p % 4 > 0, "Travaux INTENSIFS : 2 mai au 9 juin ").otherwise("Congé : 2 mai au 9 juin 0"), y, " et 12 au ", 20 + p % 8, " août ", y)
    return _texts(spark, sf_dir, *plain, *close).select("part", _line(S.french(F.col("text"), y)).alias("days"))


_TUESDAY = "(make_date(y, {m}, 1) + ((9 - isodow(make_date(y, {m}, 1))) % 7)::INT + {k})"
_MONDAY = "date_trunc('week', {d})::DATE"


@query(
    "schedules_from_opening",
    f"""SELECT part, array_to_string(list_filter(list_concat({_days("spring", "make_date(y, 6, 30)")}, {_days("autumn", "make_date(y, 12, 31)")}), lambda x: isodow(x) BETWEEN 2 AND 5 AND NOT (x BETWEEN {_MONDAY.format(d="autumn")} - 7 AND {_MONDAY.format(d="autumn")} - 3)
      AND NOT (part % 2 = 0 AND x BETWEEN make_date(y, 3, 10) AND make_date(y, 3, 14 + part % 7))), ' ') AS days,
      CASE WHEN part % 5 = 0 THEN '' ELSE array_to_string(list_filter({_days("make_date(y, 3, 1)", "make_date(y, 12, 31)")}, lambda x: isodow(x) BETWEEN 2 AND 4 AND month(x) NOT IN (7, 8)), ' ') END AS by_rule
    FROM (SELECT part, y, CASE WHEN part % 3 = 0 THEN make_date(y, 2, 1 + part % 28) ELSE {_TUESDAY.format(m=2, k=21)} END AS spring, {_TUESDAY.format(m=11, k=0)} AS autumn FROM {_YEARS})""",
)
def schedules_from_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three texts one gives the year's opening and one that of another year; every second one gives the year's break, every fifth isn't sessional."""
    p, y = F.col("part"), F.col("year")
    opening = ("The opening  of the 2nd Session of it is on February ", 1 + p % 28, ", ", y + F.when(p % 3 == 0, 0).otherwise(1), ".\n")
    pause = ("Break: March&10 March 10", F.when(p % 4 == 0, " – ").otherwise("-"), 14 + p % 7, ", ", y + p % 2, F.when(p % 5 == 0, " Sitting").otherwise(" SESSIONAL"), " days of ", y)
    t = _texts(spark, sf_dir, *opening, *pause)
    return t.select("part", _line(S.from_opening(F.col("text"), y)).alias("days"), _line(S.sessional(F.col("text"), y)).alias("by_rule"))


@query(
    "calendar_pages",
    """SELECT year(date) AS year, coalesce(array_to_string(list_sort(list(date) FILTER (day(date) % 3 = 0)), ' '), '') AS agenda, coalesce(array_to_string(list_sort(list(date) FILTER (day(date) % 4 > 1)), ' '), '') AS cells,
       coalesce(array_to_string(list_sort(list(date) FILTER (day(date) % 6 < 5)), ' '), '') AS meetings FROM (SELECT DISTINCT date FROM divisions) GROUP BY 1""",
)
def calendar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each month's days, the months' lists joined to a year's. Links, cells and marks of other years or kinds stand among them."""
    d = V.divisions(spark, sf_dir).select("date").distinct()
    day, iso, year = F.dayofmonth("date"), F.col("date").cast("string"), F.year("date")
    link = F.when(day % 3 == 0, F.concat(F.lit('<a href="/calendar/agenda/'), iso, F.lit('">x</a><a href="/calendar/agenda/1875-02-01">'), F.lit('</a><a href="/calendar/agenda/2001-13-01">'))).otherwise(F.concat(F.lit('<a href="/agenda/'), iso, F.lit('">')))
    style = F.element_at(F.array(*[F.lit(x) for x in (" empty", " x-placeholder", " full", "")]), (day % 4 + 1).cast("int"))
    cell = F.concat(F.lit('<div class="calendar-cell'), style, F.lit('"><p class="full-date"><span>'), F.date_format("date", " MMMM d, yyyy"), F.lit("</span></p></div>"))
    marks = ["<td class='{} chamber-meeting'>1</td>", '<i data-date="{}">1999-09-09</i>', "<td class=\"a sitting\" datetime='{}'></td>", "<b class='sitting-day'>{}</b>", "<td class='is-sitting'> {} </td>", "<td class='{} meeting'>{}</td>"]
    mark = F.element_at(F.array(*[F.concat(F.lit(a), iso, F.lit(z)) for a, z in ((m.split("{}")[0], m.split("{}")[-1]) for m in marks)]), (day % 6 + 1).cast("int"))
    months = d.groupBy(year.alias("year"), F.month("date").alias("month")).agg(*[F.array_join(F.collect_list(x), "\n").alias(n) for n, x in (("links", link), ("grid", cell), ("marks", mark))])
    lists = months.select("year", S.agenda_links(F.col("links"), F.col("year")).alias("agenda"), S.calendar_cells(F.col("grid"), F.col("year")).alias("cells"), S.meeting_cells(F.col("marks")).alias("meetings"))
    return lists.groupBy("year").agg(*[_line(S.one_list(F.col(c))).alias(c) for c in ("agenda", "cells", "meetings")])
