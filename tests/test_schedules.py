"""Sitting calendars, representatives and choices on odd rows."""

import datetime as dt

from pyspark.sql import functions as F

from quorumlake.functions import choices as H
from quorumlake.functions import schedules as S
from quorumlake.operators import extract as X
from quorumlake.operators import representatives as R

YEAR = 2025


def test_texts_that_say_nothing_give_no_days(spark):
    t = spark.createDataFrame([(None,), ("",), ("\n 31   x",), ("Parliamentary calendar 2025",)], "text string")
    c = F.col("text")
    for days in (S.with_exceptions(c, F.lit(YEAR)), S.french(c, F.lit(YEAR)), S.sessional(c, F.lit(YEAR)), S.agenda_links(c, F.lit(YEAR)), S.calendar_cells(c, F.lit(YEAR)), S.meeting_cells(c)):
        assert [r[0] for r in t.select(days).collect()] == [[]] * 4


def test_calendar_of_a_year_without_text_follows_the_rule(spark):
    days = spark.range(1).select(S.from_opening(F.lit(None).cast("string"), F.lit(YEAR))).first()[0]
    assert days[0] == dt.date(2025, 2, 25) and dt.date(2025, 11, 4) in days
    assert all(d.isoweekday() in (2, 3, 4, 5) for d in days) and max(d for d in days if d.month < 8) == dt.date(2025, 6, 27)


def test_french_days_beyond_a_month_run_on(spark):
    got = spark.range(1).select(S.french(F.lit("31 juin au 3 juillet 2025"), F.lit(YEAR))).first()[0]
    assert got == [dt.date(2025, 7, 1), dt.date(2025, 7, 2), dt.date(2025, 7, 3)]


def test_members_of_a_district(spark):
    members = spark.createDataFrame(
        [("2", "Ann Lee", "East York", "federal"), ("1", "Bo Ray", "York", "provincial"), ("3", "Cy Fox", "York", "federal"), ("4", None, None, None), ("5", "Ann Lee", "York", "provincial")],
        "id string, name string, riding string, government_level string",
    )
    asked = [("a", "ann lee ", "york", "MP", ""), ("b", "Bo Ray", "YORK", "mp", None), ("c", "Cy Fox", " York", "MLA", " "), ("d", "Zed", "York", "MP", ""), ("e", "Zed", "east", "MPP", ""), ("f", "Ann Lee", None, "MP", ""), ("g", "Bo Ray", "x", "MP", "own"), ("h", None, "York", None, None)]
    got = {r.rep_id: (r.local_id, r.member_id) for r in R.member_ids(spark.createDataFrame(asked, "rep_id string, name string, district string, office string, local_id string"), members).collect()}
    # b: a federal representative is the member of that name, whatever the level; c: the first provincial member before the namesake of another level
    assert got == {"a": ("2", "2"), "b": ("1", "1"), "c": ("", "5"), "d": ("", "2"), "e": ("", ""), "f": ("", ""), "g": ("own", "own"), "h": ("", "5")}


def test_lookup_without_districts_keeps_the_last(spark):
    rows = [(1, 0, "a", "MP", ""), (1, 1, "b", "MP", None), (2, 0, "c", "MP", ""), (2, 1, "d", "mp", "X"), (2, 2, "e", "MP", "Y"), (3, 0, None, None, None)]
    got = R.lookups(spark.createDataFrame(rows, "lookup_id int, position int, rep_id string, office string, district string"))
    assert sorted(map(tuple, got.collect())) == [(1, "b", None), (2, "d", None), (3, None, None)]


def test_pages_without_votes(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<table><th>Yeas</th><th>Nays</th><tr><td></td><td>&nbsp;</td></tr></table>")], "page_id int, html string")
    assert X.two_column_votes(pages).count() == 0
    assert [tuple(r)[1:] for r in X.panel_votes(pages).collect()] == [(0, 0, [], [])] * 3
    texts = spark.createDataFrame([(1, None), (2, "AYE A ....0 NAY B ....0")], "text_id int, text string")
    assert X.dotted_votes(texts).count() == 0


def test_choices_of_nothing(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(H.linked_calendar(none, F.lit("https://x.ca/"), F.lit(YEAR)), H.named_calendar(none, F.lit(YEAR)), H.photo_url(none, none), H.retry_after(none, F.lit(0)), H.page_size(F.lit(None).cast("int"))).first()
    assert tuple(row) == ("", "", "", 0, 10)
