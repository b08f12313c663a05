"""Sitting calendars and session status, always as of a given date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T

RANK = {"status_unavailable": 0, "on_break": 1, "in_session": 2}


def federal_status(sittings: DataFrame, parliament: int, session: int, as_of: str) -> DataFrame:
    """parliament, session, label, status, detail: one row."""
    today = F.lit(as_of).cast("date")
    own = sittings.where((F.col("parliament") == parliament) & (F.col("session") == session))
    found = own.agg(F.coalesce(F.max(F.col("date") == today), F.lit(False)).alias("sits"), F.min(F.when(F.col("date") > today, F.col("date"))).alias("next"))
    detail = F.when(F.col("sits"), "Parliament is sitting today").when(F.col("next").isNotNull(), F.concat(F.lit("Next sitting: "), F.date_format("next", "yyyy-MM-dd"))).otherwise("No upcoming sitting dates scheduled")
    label = F.concat(T.ordinal(F.lit(parliament)), F.lit(" Parliament, "), T.ordinal(F.lit(session)), F.lit(" Session"))
    return found.select(F.lit(parliament).alias("parliament"), F.lit(session).alias("session"), label.alias("label"), F.when(F.col("sits"), "in_session").otherwise("on_break").alias("status"), detail.alias("detail"))


def _rule(until: Column, since: Column) -> Column:
    """Status by days until the next listed date and since the last one (today is both)."""
    near = (until <= 7) | ((since <= 7) & (until <= 21))
    return F.when(until.isNotNull(), F.when(F.coalesce(near, F.lit(False)), "in_session").otherwise("on_break")).when(since.isNotNull(), F.when(since <= 3, "in_session").otherwise("on_break")).otherwise("status_unavailable")


def jurisdiction_status(calendar: DataFrame, as_of: str) -> DataFrame:
    """jurisdiction, status of every jurisdiction with dates."""
    today = F.lit(as_of).cast("date")
    gap = F.datediff(F.col("date"), today)
    near = calendar.groupBy("jurisdiction").agg(F.min(F.when(gap >= 0, gap)).alias("until"), F.min(F.when(gap <= 0, -gap)).alias("since"))
    return near.select("jurisdiction", _rule(F.col("until"), F.col("since")).alias("status"))


def requested_status(calendar: DataFrame, wanted: DataFrame, as_of: str) -> DataFrame:
    """The same for a list of jurisdictions; one without dates is unavailable."""
    return wanted.join(jurisdiction_status(calendar, as_of), "jurisdiction", "left").select("jurisdiction", F.coalesce("status", F.lit("status_unavailable")).alias("status"))


def combined_status(status: DataFrame) -> DataFrame:
    """In session if any is, else on break if any has dates."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("status"))
    best = F.coalesce(F.max(rank), F.lit(0))
    return status.agg(F.element_at(F.array(*[F.lit(k) for k in RANK]), best + 1).alias("status"))


def next_and_previous(calendar: DataFrame, as_of: str) -> DataFrame:
    today = F.lit(as_of).cast("date")
    return calendar.groupBy("jurisdiction").agg(F.min(F.when(F.col("date") >= today, F.col("date"))).alias("next"), F.max(F.when(F.col("date") <= today, F.col("date"))).alias("previous"), F.coalesce(F.max(F.col("date") == today), F.lit(False)).alias("sits"))


def replace_dates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """All dates of the jurisdictions that incoming has, and those stored of the others. Blank dates and repeats are dropped."""
    new = incoming.withColumn("date", F.try_to_date(F.trim("date"), "yyyy-MM-dd") if dict(incoming.dtypes)["date"] == "string" else F.col("date")).where("date is not null").select("jurisdiction", "date").distinct()
    return stored.select("jurisdiction", "date").join(new.select("jurisdiction").distinct(), "jurisdiction", "left_anti").unionByName(new)


def weekdays(ranges: DataFrame, days: tuple[int, ...], exceptions: DataFrame | None = None) -> DataFrame:
    """id, date for every given weekday of each (id, first, last), without excepted dates."""
    out = ranges.select("id", F.explode(D.days(F.col("first"), F.col("last"), days)).alias("date"))
    if exceptions is not None:  # one row a calendar day at most
        out = out.join(F.broadcast(exceptions.select("date").distinct()), "date", "left_anti").select("id", "date")
    return out.distinct()


def spring_and_autumn(years: DataFrame) -> DataFrame:
    """year, opening (4th Tuesday of February) and resumption (1st Tuesday of November)."""
    return years.select("year", D.nth_weekday(F.col("year"), 2, "TU", 4).alias("opening"), D.nth_weekday(F.col("year"), 11, "TU", 1).alias("resumption"))
