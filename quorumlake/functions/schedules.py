"""Sitting days of a year from the texts and pages that announce them, as sorted arrays of distinct dates.

Every function gives an empty array where its text is null or says nothing of the year.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates as D
from . import text as T

#: Weekdays as D.days() counts them.
SUN, MON, TUE, WED, THU, FRI, SAT = range(1, 8)
_FULL = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2},? \d{4}\b"
_WORD, _DAY = r"\b([A-Za-z]+)", r"(\d{1,2})"
_ACROSS, _WITHIN, _ALONE = f"{_WORD} {_DAY} to ([A-Za-z]+) {_DAY}\\b", f"{_WORD} {_DAY} to {_DAY}\\b", f"{_WORD} {_DAY}\\b"
_EVERY = (SUN, MON, TUE, WED, THU, FRI, SAT)


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _joined(*parts: Column) -> Column:
    """Sorted distinct dates of several arrays; a null array is empty."""
    none = F.array().cast("array<date>")
    return F.array_sort(F.array_distinct(F.filter(F.concat(*[F.coalesce(p, none) for p in parts]), lambda d: d.isNotNull())))


def _flat(text: Column) -> Column:
    return T.collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "))


def _named(text: Column) -> Column:
    """The date of 'March 3, 2025', else null."""
    return F.try_to_date(F.nullif(F.trim(text), F.lit("")), "MMMM d, yyyy")


def _place(year: Column, month: Column | int, day: Column | int) -> Column:
    """The date of a day counted from a month's first; days beyond its end run on."""
    month, day = (x if isinstance(x, Column) else F.lit(x) for x in (month, day))
    return F.date_add(F.make_date(year, month, F.lit(1)), day - 1)


def year_section(text: Column, year: Column) -> Column:
    """From the heading of the year's calendar to the next year's heading; '' without one."""
    pattern = F.concat(F.lit("(?is)parliamentary calendar "), year.cast("string"), F.lit(r".*?(?=parliamentary calendar\s+\d{4}|\z)"))
    return F.coalesce(F.regexp_substr(_flat(text), pattern), F.lit(""))


def with_exceptions(text: Column, year: Column) -> Column:
    """Mondays to Thursdays between the last two dates before 'with the following exceptions', without the days and ranges listed after it."""
    return T.once(F.split(year_section(text, year), "(?i)with the following exceptions", 2), lambda halves: _with_exceptions(halves, year))


def _with_exceptions(halves: Column, year: Column) -> Column:
    main = F.transform(F.slice(F.reverse(_found(halves[0], _FULL)), 1, 2), _named)
    first, last = F.get(main, F.lit(1)), F.get(main, F.lit(0))
    rest = F.coalesce(F.get(halves, 1), F.lit(""))
    at = lambda m, pattern, month, day: D.month_day(F.regexp_extract(m, pattern, month), F.regexp_extract(m, pattern, day), year)
    spans = [
        F.transform(_found(rest, _ACROSS), lambda m: D.days(at(m, _ACROSS, 1, 2), at(m, _ACROSS, 3, 4), _EVERY)),
        F.transform(_found(rest, _WITHIN), lambda m: D.days(at(m, _WITHIN, 1, 2), at(m, _WITHIN, 1, 3), _EVERY)),
        F.transform(_found(rest, _ALONE), lambda m: F.array(at(m, _ALONE, 1, 2))),
    ]
    days = F.when(F.size(halves) > 1, D.days(first, last, (MON, TUE, WED, THU)))
    return F.array_except(_joined(days), _joined(*[F.flatten(s) for s in spans]))


def _french_ranges(text: Column, year: Column, weekdays: tuple[int, ...]) -> Column:
    """Days of 'd [month] au d month year': what stands around each word 'au' is read from the words next to it."""
    return T.once(F.split(F.trim(text), r"\s+"), lambda words: _ranges_of_words(words, year, weekdays))


def _ranges_of_words(words: Column, year: Column, weekdays: tuple[int, ...]) -> Column:
    word = lambda k: F.coalesce(F.get(words, k), F.lit(""))
    number = lambda w: F.regexp_extract(w, r"(\d{1,2})$", 1)
    month = lambda w: F.nullif(D.french_month(w), F.lit(0))

    def around(k: Column) -> Column:
        own = number(word(k - 1)) != ""  # the day stands next to 'au', else its month does
        start = _place(year, month(F.when(own, word(k + 2)).otherwise(word(k - 1))), F.nullif(number(F.when(own, word(k - 1)).otherwise(word(k - 2))), F.lit("")).cast("int"))
        end = _place(year, month(word(k + 2)), F.nullif(F.regexp_extract(word(k + 1), r"^(\d{1,2})$", 1), F.lit("")).cast("int"))
        said = F.regexp_extract(word(k + 3), r"^(\d{4})", 1) == year.cast("string")
        return D.days(F.when(said, start), end, weekdays)

    places = F.filter(F.transform(words, lambda w, k: F.when(F.lower(w) == "au", k)), lambda k: k.isNotNull())
    return _joined(F.flatten(F.transform(places, around)))


def french(text: Column, year: Column) -> Column:
    """Tuesdays to Thursdays of the ranges in a French schedule; to Fridays of those after the word 'intensif'."""
    both = lambda halves: F.concat(*[F.coalesce(_french_ranges(F.get(halves, k), year, w), F.array().cast("array<date>")) for k, w in ((0, (TUE, WED, THU)), (1, (TUE, WED, THU, FRI)))])
    return _joined(T.once(F.split(F.coalesce(text, F.lit("")), "(?i)intensif", 2), both))


def from_opening(text: Column, year: Column) -> Column:
    """Tuesdays to Fridays from the session's opening (else February's 4th Tuesday) to June, and from November's 1st Tuesday to December.

    The weeks before either start and the break in March have no sittings.
    """
    return T.once(_flat(text), lambda flat: _from_opening(flat, year))


def _from_opening(flat: Column, year: Column) -> Column:
    opened = F.regexp_instr(flat, F.lit(r"(?i)\bopening of the \d+[a-z]{2} session\b"))
    said = _named(F.regexp_extract(F.substring(flat, opened, F.length(flat)), r"(?i)[a-z]+ \d{1,2}, \d{4}", 0))
    given = T.once(said, lambda d: F.when((opened > 0) & (F.year(d) == year), d))
    return T.once(F.coalesce(given, D.nth_weekday(year, 2, "TU", 4)), lambda spring: _sittings_from(flat, year, spring))


def _sittings_from(flat: Column, year: Column, spring: Column) -> Column:
    autumn = D.nth_weekday(year, 11, "TU", 1)
    within = r"(?i)([a-z]+) (\d{1,2}) ?[-–] ?(\d{1,2}), ?(\d{4})"
    pauses = F.filter(_found(flat, within), lambda m: F.lower(m).startswith("march "))
    part = lambda m, k: F.nullif(F.regexp_extract(m, within, k + 1), F.lit("")).cast("int")
    off = [T.once(F.try_element_at(pauses, F.lit(1)), lambda m: D.days(F.when(part(m, 3) == year, _place(year, 3, part(m, 1))), _place(year, 3, part(m, 2)), (MON, TUE, WED, THU, FRI)))]
    off += [D.days(F.date_sub(D.monday(s), 7), F.date_sub(D.monday(s), 3), (MON, TUE, WED, THU, FRI)) for s in (spring, autumn)]
    sits = [D.days(a, _place(year, m, d), (TUE, WED, THU, FRI)) for a, m, d in ((spring, 6, 30), (autumn, 12, 31))]
    return F.array_except(_joined(*sits), _joined(*off))


def sessional(text: Column, year: Column) -> Column:
    """Tuesdays to Thursdays from March to June and from September to December of a year that a sessional text names."""
    named = T.once(F.lower(T.collapse(F.coalesce(text, F.lit("")))), lambda flat: flat.contains("sessional") & flat.contains(year.cast("string")))
    halves = [D.days(_place(year, a, 1), _place(year, b, d), (TUE, WED, THU)) for a, b, d in ((3, 6, 30), (9, 12, 31))]
    return F.when(named, _joined(*halves)).otherwise(F.array().cast("array<date>"))


def _in_year(dates: Column, year: Column) -> Column:
    return _joined(F.filter(dates, lambda d: F.year(d) == year))


def agenda_links(page: Column, year: Column) -> Column:
    """Dates of links to a day's agenda."""
    found = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"/calendar/agenda/(\d{4}-\d{2}-\d{2})"), F.lit(1))
    return _in_year(F.transform(found, lambda d: F.try_to_date(d, "yyyy-MM-dd")), year)


def calendar_cells(page: Column, year: Column) -> Column:
    """Full dates in the cells of a month's grid whose class says neither empty nor placeholder."""
    cells = F.slice(F.split(F.coalesce(page, F.lit("")), 'class="calendar-cell'), 2, 1 << 20)
    live = F.filter(cells, lambda c: c.contains('"') & ~F.substring_index(c, '"', 1).rlike("empty|placeholder"))
    return _in_year(F.transform(live, lambda c: _named(F.regexp_extract(c, '(?s)class="full-date"><span>([^<]+)</span>', 1))), year)


def meeting_cells(page: Column) -> Column:
    """Dates among the classes of cells of chamber meetings, and of marked days by data-date, datetime or text."""
    tags = _found(page, r"(?s)<[A-Za-z]+\b[^>]*>[^<]*")
    value = lambda t, name: F.regexp_extract(t, rf"""(?is)^<[^>]*?\s{name}=["']([^"'>]*)["']""", 1)
    cell = lambda t: t.rlike(r"(?i)^<td\b")
    iso = lambda d: F.try_to_date(F.nullif(D.parse(d), F.lit("")), "yyyy-MM-dd")
    met = F.filter(tags, lambda t: cell(t) & value(t, "class").contains("chamber-meeting"))
    by_class = F.flatten(F.transform(met, lambda t: F.transform(_found(value(t, "class"), r"\b\d{4}-\d{2}-\d{2}\b"), iso)))
    marked = F.filter(tags, lambda t: t.rlike(r"(?is)^<[^>]*\sdata-date=") | (cell(t) & value(t, "class").contains("sitting")) | value(t, "class").contains("sitting-day"))
    said = F.transform(marked, lambda t: iso(F.coalesce(F.nullif(value(t, "data-date"), F.lit("")), F.nullif(value(t, "datetime"), F.lit("")), F.regexp_extract(t, r"(?s)>([^<]*)$", 1))))
    return _joined(by_class, said)


def one_list(lists: Column) -> Column:
    """The months' lists of a group as one."""
    return _joined(F.flatten(F.collect_list(lists)))
