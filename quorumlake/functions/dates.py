"""Dates from text, weekdays and ranges. Every rule that depends on today takes it as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The layouts a date may have, in the order they are tried.
LAYOUTS = [(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^[A-Z][a-z]{2,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} [A-Z][a-z]{2,} \d{4}$", "d MMMM yyyy"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd")]
#: What a date in running text looks like: numbers with hyphens, or a capitalised month before or after the day.
_DAY, _MONTH, _YEAR = r"\d{1,2}", "[A-Z][a-z]+", r"\d{4}"
IN_TEXT = "|".join((rf"{_YEAR}-\d{{2}}-\d{{2}}", f"{_MONTH} {_DAY},? {_YEAR}", f"{_DAY} {_MONTH} {_YEAR}"))
# Parts of French month names, in the order they are looked for.
FRENCH = (("janv", 1), ("vrier", 2), ("mars", 3), ("avri", 4), ("mai", 5), ("juin", 6), ("juil", 7), ("ao", 8), ("sept", 9), ("octo", 10), ("novem", 11), ("cembre", 12))


def parse(text: Column) -> Column:
    """ISO date of a text in one of the layouts, else ''."""
    tries = lambda plain: F.coalesce(*[F.when(plain.rlike(shape), F.try_to_date(plain, layout)) for shape, layout in LAYOUTS])
    return F.coalesce(F.date_format(T.once(F.trim(text), tries), "yyyy-MM-dd"), F.lit(""))


def in_text(text: Column) -> Column:
    """The first date in a text, else ''."""
    return parse(F.regexp_extract(text, IN_TEXT, 0))


def all_in_text(text: Column) -> Column:
    """Sorted distinct ISO dates of a text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(IN_TEXT), F.lit(0)), parse)
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d != "")))


def shown(iso: Column) -> Column:
    """'Jan 2, 2006'; what isn't a date passes."""
    return F.coalesce(F.date_format(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd")), "MMM d, yyyy"), iso)


def in_url(url: Column, year: int) -> Column:
    """ISO date by the leftmost run of a URL that is written with hyphens or as eight digits, from 1900 to the year after `year`; else ''."""
    raw = F.regexp_extract(url, rf"{_YEAR}-\d{{2}}-\d{{2}}|\d{{8}}", 0)
    iso = F.regexp_replace(raw, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd")
    return F.when(F.year(day).between(1900, year + 1), iso).otherwise(F.lit(""))


def month_day(month: Column, day: Column, year: Column) -> Column:
    """The date of an English month, a day and a year, null if there is none."""
    return F.try_to_date(F.concat_ws(" ", F.trim(month), F.trim(day), year.cast("string")), "MMMM d yyyy")


def french_month(text: Column) -> Column:
    """Number of a French month by a part of its name, 0 for others."""
    plain, out = F.lower(text), F
    for part, number in FRENCH:
        out = out.when(plain.contains(part), F.lit(number))
    return out.otherwise(F.lit(0))


def in_slug(url: Column) -> Column:
    """ISO date of a URL slug such as house_26apr09 (year, month, day), else ''."""
    part = lambda k: F.regexp_extract(url, r"(?i)(\d{2})(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(\d{1,2})", k)
    month = F.position(F.lower(part(2)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    iso = F.concat(F.lit("20"), part(1), F.lit("-"), F.lpad(((month + 2) / 3).cast("int").cast("string"), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0"))
    return F.when(part(1) != "", iso).otherwise(F.lit(""))


def short(text: Column) -> Column:
    """'YY-MM-DD' of this century in full."""
    return F.concat(F.lit("20"), text)


def of_document(text: Column, url: Column, as_of: Column, year: int) -> Column:
    """A document's date by its text, else by its URL, else as_of."""
    return F.coalesce(F.nullif(in_text(text), F.lit("")), F.nullif(in_url(url, year), F.lit("")), as_of)


def near(text: Column, as_of: Column) -> Column:
    """Sorted distinct ISO dates of a text from a year before as_of to a year after it."""
    return F.filter(all_in_text(text), lambda d: d.between(F.date_format(F.add_months(as_of, -12), "yyyy-MM-dd"), F.date_format(F.add_months(as_of, 12), "yyyy-MM-dd")))


def canonical(text: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_date(F.left(F.trim(text), F.lit(10)), "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))


def days(start: Column, end: Column, weekdays: tuple[int, ...]) -> Column:
    """Dates from start to end on the given weekdays (1 Sunday .. 7 Saturday); empty if end is before start."""
    run = lambda x: F.when(x["b"] >= x["a"], F.sequence(x["a"], x["b"], F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))
    return F.filter(T.once(F.struct(start.alias("a"), end.alias("b")), run), lambda d: F.dayofweek(d).isin(*weekdays))


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    """The n-th weekday ('TU') of a month."""
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday), 7 * (n - 1))


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def year_range(text: Column) -> Column:
    """struct(first, last) of 'a-b' or 'a-present'; an open end is 9999, no year gives nulls."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda y: y.cast("int"))
    first = F.try_element_at(years, F.lit(1))
    last = F.when(F.lower(text).rlike("present|since|current"), F.lit(9999)).otherwise(F.coalesce(F.try_element_at(years, F.lit(2)), first))
    return F.struct(first.alias("first"), F.when(first.isNotNull(), last).alias("last"))
