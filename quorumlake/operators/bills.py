"""Bill listings: filters, orders, pages, facets and details."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as T


@dataclass(frozen=True)
class BillFilter:
    """What a listing asks for; empty fields don't filter."""

    search: str = ""
    stage: str = ""
    category: str = ""
    chamber: str = ""
    province: str = ""
    level: str = ""
    sort: str = ""
    subscribed: tuple = field(default=())
    preferred: tuple = field(default=())
    page: int = 1
    per_page: int = 20


def contains(column: Column, value: str) -> Column:
    """Substring without regard to case; % and _ in value are wildcards, nothing escapes them."""
    return F.expr("true") if not value else column.ilike(f"%{value}%")


def predicate(f: BillFilter) -> Column:
    c = F.col
    parts: list[Column] = []
    if f.search:
        parts.append(contains(c("title"), f.search) | contains(c("number"), f.search) | contains(c("short_title"), f.search))
    for value, column in ((f.stage, "current_stage"), (f.category, "category"), (f.chamber, "chamber")):
        if value:
            parts.append(c(column) == value)
    if f.province:
        parts.append(P.bill_province(c("chamber"), c("id")) == P.expand_province(F.lit(f.province)))
    if f.level in ("provincial", "federal"):
        local = P.is_provincial(c("chamber"), c("id"))
        parts.append(local if f.level == "provincial" else ~local)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def order(f: BillFilter) -> list[Column]:
    newest = [F.desc("last_activity_date"), F.desc("id")]
    if f.sort == "date_asc":
        return [F.asc("last_activity_date"), F.asc("id")]
    if f.sort in ("stage", "category"):
        return [F.asc("current_stage" if f.sort == "stage" else "category"), *newest]
    if f.sort == "auto":
        first = [F.when(F.col(k).isin(*v), 0).otherwise(1).asc() for k, v in (("id", f.subscribed), ("category", f.preferred)) if v]
        return [*first, *newest]
    return newest


def listing(bills: DataFrame, members: DataFrame, f: BillFilter) -> DataFrame:
    """One page of bills with sponsor and the number of bills that match."""
    per_page = f.per_page if f.per_page > 0 else 20
    chosen = bills.where(predicate(f))
    total = chosen.agg(F.count("*").alias("total"))
    page = chosen.orderBy(*order(f)).offset((max(f.page, 1) - 1) * per_page).limit(per_page)
    sponsor = members.select(F.col("id").alias("sponsor_id"), F.col("name").alias("sponsor"))
    out = page.join(sponsor, "sponsor_id", "left").crossJoin(F.broadcast(total))  # one row
    empty = lambda x: F.coalesce(x, F.lit("")).alias(x)
    return out.select("id", "number", "title", empty("short_title"), empty("chamber"), empty("category"), "current_stage", "last_activity_date", empty("sponsor"), "total")


def provinces(bills: DataFrame) -> DataFrame:
    return bills.select(P.bill_province(F.col("chamber"), F.col("id")).alias("province")).where("province <> ''").distinct()


def labels(bills: DataFrame) -> DataFrame:
    c = F.col
    return bills.select("id", P.bill_province(c("chamber"), c("id")).alias("province"), P.is_provincial(c("chamber"), c("id")).alias("provincial"), P.level_label(c("chamber"), c("id")).alias("level"), P.chamber_label(c("chamber")).alias("chamber_label"), P.stage_label(c("current_stage")).alias("stage_label"), P.stage_index(c("current_stage")).alias("stage_index"), T.first_title(c("short_title"), c("title")).alias("shown"))


def detail(bill_id: str, bills: DataFrame, members: DataFrame, divisions: DataFrame) -> DataFrame:
    """A bill, its sponsor and its divisions, newest first; one row without divisions."""
    own = bills.where(F.col("id") == bill_id).select("id", "number", "title", "sponsor_id")
    sponsor = members.select(F.col("id").alias("sponsor_id"), F.col("name").alias("sponsor"))
    d = divisions.select(F.col("bill_id").alias("id"), F.col("id").alias("division_id"), "date", "result").dropDuplicates(["division_id"])
    return own.join(sponsor, "sponsor_id", "left").join(d, "id", "left").select("id", "number", "title", F.coalesce("sponsor", F.lit("")).alias("sponsor"), "division_id", "date", "result")


def needs_summary(bills: DataFrame, incoming: Column, stored: Column, summary: Column) -> Column:
    """Whether a bill's summary is missing, undated or older than its last activity (incoming, else stored).

    A blank activity doesn't ask for a new one; a date that can't be read does.
    """
    made = F.get_json_object(summary, "$.generated_at")
    at = F.coalesce(F.try_to_timestamp(made), F.try_to_timestamp(made, F.lit("yyyy-MM-dd")))
    activity = F.coalesce(F.nullif(F.trim(incoming), F.lit("")), F.nullif(F.trim(stored), F.lit("")))
    when = F.try_to_timestamp(activity)
    return F.when(F.coalesce(F.trim(summary), F.lit("")) == "", True).when(F.coalesce(made, F.lit("")) == "", True).when(activity.isNull(), False).when(when.isNull() | at.isNull(), True).otherwise(when > at)


def reached(stage: Column, upto: Column) -> Column:
    """Whether a bill at `stage` has come to `upto` in display order."""
    return P.stage_index(stage) >= P.stage_index(upto)


def page_info(total: Column, page: Column, per_page: Column) -> Column:
    per = F.when(per_page > 0, per_page).otherwise(10)
    pages = F.greatest(F.ceil(total / per), F.lit(1)).cast("long")
    now = F.greatest(page, F.lit(1))
    return F.struct(now.alias("current"), pages.alias("pages"), (now > 1).alias("has_prev"), (now < pages).alias("has_next"))


def visible_pages(pages: Column, now: Column) -> Column:
    """Page numbers to show; -1 stands for those left out. Up to five are all shown, else the first, the last and those around."""
    start = F.when(now - 1 < 2, 2).otherwise(now - 1)
    end = F.when(now - 1 < 2, 4).otherwise(now + 1)
    start = F.greatest(F.when(end > pages - 1, pages - 3).otherwise(start), F.lit(2))
    end = F.least(end, pages - 1)
    gap = lambda when: F.when(when, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    some = F.concat(F.array(F.lit(1)), gap(start > 2), F.sequence(start.cast("int"), end.cast("int")), gap(end < pages - 1), F.array(pages.cast("int")))
    return F.when(pages <= 5, F.sequence(F.lit(1), F.greatest(pages, F.lit(1)).cast("int"))).otherwise(some)


def timeline(stages: DataFrame) -> DataFrame:
    """bill_id, current_stage (the last in the timeline's order, later rows last among equals) and introduced (date of the first first reading)."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in P.TIMELINE]), F.col("stage")), F.lit(0)), F.lit(99))
    return stages.withColumn("_place", place).groupBy("bill_id").agg(F.max_by("stage", F.struct("_place", "pos")).alias("current_stage"), F.min_by(F.when(F.col("stage") == "1st_reading", F.col("date")), F.when(F.col("stage") == "1st_reading", F.col("pos"))).alias("introduced"))
