"""One value out of several: the document of a year, the likeliest session, a photo's address, waits and page sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ids as I

#: Page sizes that may be asked for; the second is the default.
PAGE_SIZES = (5, 10, 25, 50)


def _of_year(links: Column, year: Column) -> Column:
    """The first link that holds the year, else the first; '' of none."""
    own = F.filter(links, lambda u: F.lower(u).contains(year.cast("string")))
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at(links, F.lit(1)), F.lit(""))


def linked_calendar(page: Column, base: Column, year: Column) -> Column:
    """Address of the year's upper-house calendar among a page's links to PDF files, as seen from base."""
    hrefs = F.filter(F.transform(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"""(?i)href=["']([^"']+\.pdf)["']"""), F.lit(1)), F.trim), lambda h: h != "")
    links = F.filter(F.transform(hrefs, lambda h: I.resolved(base, h)), lambda u: F.lower(u).contains("senate") & F.lower(u).contains("calendar"))
    return _of_year(links, year)


def named_calendar(page: Column, year: Column) -> Column:
    """The year's parliamentary calendar among the addresses of PDF files in a page."""
    pieces = F.split(F.coalesce(page, F.lit("")), r"""[\s"']+""")
    addresses = F.filter(F.transform(pieces, lambda p: F.regexp_extract(p, r"(?i)https?://.*[.]pdf", 0)), lambda u: u != "")
    after = lambda u: F.substring(F.lower(u), F.instr(F.lower(u), "parliamentary"), F.length(u))
    return _of_year(F.filter(addresses, lambda u: F.lower(u).contains("parliamentary") & after(u).contains("calendar")), year)


def best_session(candidates: Column) -> Column:
    """Of array<struct<score, legislature, session>> the one of the highest score, then legislature, then session; null of none."""
    return F.array_max(F.transform(candidates, lambda c: F.struct(c["score"].alias("score"), c["legislature"].alias("legislature"), c["session"].alias("session"))))


def photo_url(photo: Column, page: Column) -> Column:
    """A photo's absolute address, seen from the member's page where it is relative; '' where there is no such page."""
    own = F.trim(F.coalesce(photo, F.lit("")))
    base = F.coalesce(page, F.lit(""))
    return F.when((own == "") | own.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), own).when(base == "", "").otherwise(I.resolved(base, own))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a header of seconds or a date ('Sun, 06 Nov 1994 08:49:37 GMT'); 0 of others and of the past. now: seconds since 1970."""
    own = F.trim(F.coalesce(header, F.lit("")))
    date = F.regexp_replace(F.regexp_extract(own, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), (\d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d GMT)$", 1), "GMT$", "+0000")
    until = F.unix_seconds(F.try_to_timestamp(F.nullif(date, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss xx")))
    return F.coalesce(F.when(own.rlike(r"^\+?\d+$"), own.try_cast("long")), F.greatest(until - now, F.lit(0)), F.lit(0))


def page_size(asked: Column) -> Column:
    return F.when(asked.isin(*PAGE_SIZES), asked).otherwise(PAGE_SIZES[1])
