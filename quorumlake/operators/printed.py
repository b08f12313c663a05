"""Sitting days of printed year calendars: words with places on a page, and how much of each word's cell is coloured.

words: page_id, text, left, top, width, height, confidence (0 where it isn't
known), pixels, sitting, violet (pixels of the word's cell, and those of either
colour). pages: page_id, year, height_of_page. A page whose words don't make up a
calendar gives no days. Everything is SQL functions on one row a page and word;
a page's words, some hundreds, are one row's array.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

ROUNDS = 20
#: Horizontal distances weigh more: a month's days stand below its heading.
ACROSS = 1.8
# Least confidence of a read word, least share of a coloured cell, most of a page's height that a calendar takes, words that make one up.
SURE, COLOURED, REACH, ENOUGH = 30, 0.08, 0.78, 40
MONTHS = [m.lower() for m in calendar.month_name[1:]]
CONSECUTIVE = 100


def splits(token: str) -> list[int] | None:
    """Days whose digits run together, as most of them as can be next to their predecessor plus one; null if there is no split into two or more.

    A dynamic programme over places and the last day: a split scores 1 a day and
    CONSECUTIVE more for each day that follows its predecessor. Of equal scores
    the one with the shorter day at the first difference wins.
    """
    if not token.isascii() or not token.isdigit() or len(token) < 2:
        return None
    best: list[dict[int, tuple[int, tuple[int, ...], list[int]]]] = [{} for _ in range(len(token) + 1)]
    best[0][-1] = (0, (), [])
    for at in range(len(token)):
        for last, (score, sizes, days) in best[at].items():
            for size in (1, 2):
                day = int(token[at : at + size])
                if at + size > len(token) or not 1 <= day <= 31:
                    continue
                new = (score + 1 + (CONSECUTIVE if last > 0 and day == last + 1 else 0), (*sizes, -size), [*days, day])
                old = best[at + size].get(day)
                if old is None or new[:2] > old[:2]:
                    best[at + size][day] = new
    ends = list(best[-1].values())
    days = max(ends, key=lambda e: e[:2])[2] if ends else []
    return days if len(days) >= 2 else None


@F.pandas_udf(ArrayType(IntegerType()))
def _splits(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in tokens:
        known = {t: splits(t) for t in part.dropna().unique()}
        yield part.map(lambda t: known.get(t))


def day_split(token: Column) -> Column:
    return _splits(token)


def nearest(value: Column, centers: Column) -> Column:
    """Index from 0 of the first of the nearest centers."""
    off = F.transform(centers, lambda c: F.abs(value - c))
    return (F.array_position(off, F.array_min(off)) - 1).cast("int")


def clusters(values: Column, k: int) -> Column:
    """The k ascending centers of an array of numbers, by k-means from even quantiles in ROUNDS rounds at most; null with fewer numbers or where a cluster gets empty."""
    order = F.array_sort(values)
    n = F.size(values)
    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(order, (F.floor(i * (n - 1) / max(k - 1, 1) + 0.5) + 1).cast("int")))
    assigned = lambda c: F.transform(values, lambda v: nearest(v, c))
    mean = lambda a: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: _mean(F.filter(values, lambda v, j: F.element_at(a, j + 1) == i)))
    state = lambda c, a, done: F.struct(c.cast("array<double>").alias("c"), a.cast("array<int>").alias("a"), done.alias("done"))

    def step(s: Column, _: Column) -> Column:
        moved = F.transform(F.array(assigned(s["c"])), lambda a: state(mean(a), a, a == s["a"]))[0]
        return F.when(s["done"] | F.exists(s["c"], F.isnull), s).otherwise(moved)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(start, F.transform(values, lambda v: F.lit(0)), F.lit(False)), step)["c"]
    return F.when((n >= k) & ~F.exists(done, F.isnull), F.array_sort(done))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values))


def _centers(words: DataFrame) -> DataFrame:
    return words.withColumns({"cx": (F.col("left") + F.floor(F.col("width") / 2)).cast("double"), "cy": (F.col("top") + F.floor(F.col("height") / 2)).cast("double")})


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, null where the month doesn't have the day."""
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def headings(words: DataFrame, months: list[str] = MONTHS) -> DataFrame:
    """page_id, heads: array<struct<cx, cy, month>> of words that are a month's name or three of its first letters or more, from the top left one."""
    low = F.lower(F.trim("text"))
    month = F
    for k, name in enumerate(months, 1):
        month = month.when(F.lit(name).startswith(low), F.lit(k))
    found = words.where(F.length(low) >= 3).withColumn("month", month).where("month is not null")
    return found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("cy", "cx", "month"))).alias("heads"))


def highlighted_days(words: DataFrame, pages: DataFrame, reach: float = 1.0, share: float = COLOURED, months: list[str] = MONTHS) -> DataFrame:
    """page_id, date of each coloured day: its month is that of the heading nearest to it.

    A page's headings, a dozen or so, go with each of its words by one join on the
    page; of headings at one distance the upper left one counts. Words below
    `reach` of the page's height, unsure ones and days that a month doesn't have
    are passed over.
    """
    seen = _centers(words).join(pages, "page_id")
    seen = seen.where(F.lit(reach >= 1) | (F.col("cy") <= F.floor(F.col("height_of_page") * reach)))
    heads = headings(seen, months)
    days = seen.where((F.col("confidence") <= 0) | (F.col("confidence") >= SURE)).withColumn("day", F.trim("text").try_cast("int")).where("day between 1 and 31")
    off = lambda h: F.hypot((F.col("cx") - h["cx"]) * ACROSS, F.col("cy") - h["cy"])
    near = F.array_min(F.transform("heads", lambda h, k: F.struct(off(h).alias("d"), k.alias("k"), h["month"].alias("month"))))["month"]
    found = days.join(heads, "page_id").withColumn("date", _day(F.col("year"), near, F.col("day")))
    return found.where((F.col("pixels") > 0) & (F.col("sitting") >= share * F.col("pixels")) & F.col("date").isNotNull()).select("page_id", "date").distinct()


def day_words(words: DataFrame) -> DataFrame:
    """Words that are a day, with their centers; one whose digits run together is cut into days of equal width."""
    text = F.trim("text")
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    single = F.when(number.between(1, 31), F.array(number))
    cut = words.withColumn("_days", F.coalesce(single, F.when(text.rlike(r"^\d+$"), day_split(text))))
    cut = cut.withColumn("_wide", F.when(F.size("_days") > 1, F.greatest(F.floor(F.col("width") / F.size("_days")), F.lit(1))).otherwise(F.col("width")))
    cut = cut.select("*", F.posexplode("_days").alias("_k", "day")).withColumns({"left": F.col("left") + F.col("_k") * F.col("_wide"), "width": F.col("_wide")})
    return _centers(cut.drop("_days", "_wide", "_k"))


def highlighted_weeks(words: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, date: Tuesday to Friday of each week with a coloured day, without days that are violet as well.

    The year's months stand in four rows of three; rows and columns are clusters of
    the days' centers. Days are taken from the upper part of the page where that
    holds ENOUGH of them, else from all of it; fewer, or an empty cluster, is no
    calendar. A violet cell has 8 such pixels and a hundredth of all at least.
    """
    read = words.groupBy("page_id").agg(F.max((F.col("confidence") > 0) & (F.col("confidence") < 100)).alias("_read"))
    sure = words.join(read, "page_id").where(~F.col("_read") | (F.col("confidence") >= SURE)).drop("_read")
    days = day_words(sure).join(pages, "page_id")
    days = days.withColumn("_up", F.col("cy") <= F.floor(F.col("height_of_page") * REACH))
    page = days.groupBy("page_id").agg(F.count_if("_up").alias("_n"), F.collect_list(F.struct("_up", "cx", "cy")).alias("_all"))
    page = page.withColumn("_whole", F.col("_n") < ENOUGH).withColumn("_in", F.when(F.col("_whole"), F.col("_all")).otherwise(F.filter("_all", lambda x: x["_up"]))).where(F.size("_in") >= ENOUGH)
    grid = page.select("page_id", "_whole", clusters(F.transform("_in", lambda x: x["cx"]), 3).alias("_xs"), clusters(F.transform("_in", lambda x: x["cy"]), 4).alias("_ys")).where("_xs is not null and _ys is not null")
    placed = days.join(grid, "page_id").where(F.col("_whole") | F.col("_up"))
    month = nearest(F.col("cy"), F.col("_ys")) * 3 + nearest(F.col("cx"), F.col("_xs")) + 1
    placed = placed.withColumn("date", _day(F.col("year"), month, F.col("day"))).where((F.col("pixels") > 0) & (F.col("sitting") >= COLOURED * F.col("pixels")) & F.col("date").isNotNull())
    weeks = placed.select("page_id", "year", F.date_trunc("week", "date").cast("date").alias("monday")).distinct()
    free = placed.where((F.col("violet") >= 8) & (F.col("violet") >= 0.01 * F.col("pixels"))).select("page_id", "date").distinct()
    open_ = weeks.select("page_id", "year", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.date_add("monday", k))).alias("date"))
    return open_.where(F.year("date") == F.col("year")).select("page_id", "date").join(free, ["page_id", "date"], "left_anti")
