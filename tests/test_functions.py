"""Scalar rules and small operators on hand-made rows."""

from datetime import date

from pyspark.sql import functions as F

from quorumlake.functions import dates as D
from quorumlake.functions import ids as I
from quorumlake.functions import places as P
from quorumlake.functions import text as T
from quorumlake.operators import bills as B
from quorumlake.operators import calendar as C
from quorumlake.operators import limiter as L
from quorumlake.operators import merge as G
from quorumlake.operators import sequences as S
from quorumlake.operators import votes as O
from quorumlake.operators.resolve import resolve


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_ids(spark):
    lit = F.lit
    assert one(
        spark,
        I.bill_id_from_url(lit("https://x/legisinfo/en/bill/44-1/C-11?x=1")),
        I.member_id_from_url(lit("/Members/en/jane-doe(123)")),
        I.bill_id(lit(44), lit(1), lit(" C-5 ")),
        I.bill_number(lit("An Act, c-12, to")),
        I.provincial_bill_number(lit("Bill No. 14a amended")),
        I.chamber_of_number(lit("s-3")),
        I.last_segment(lit("https://x.ca/a/b%20c/index.html")),
        I.safe_url(lit("javascript:alert(1)")),
    ) == ["44-1-c-11", "123", "44-1-c-5", "C-12", "14A", "senate", "b c", "#"]


def test_dates(spark):
    lit = F.lit
    assert one(spark, D.parse(lit(" March 4, 2024 ")), D.parse(lit("soon")), D.in_text(lit("on 4 March 2024 at")), D.shown(lit("2024-03-04")), D.in_url(lit("/x/20240304.pdf"), 2025), D.nth_weekday(lit(2024), 2, "TU", 4), D.monday(lit(date(2024, 3, 7)))) == [
        "2024-03-04", "", "2024-03-04", "Mar 4, 2024", "2024-03-04", date(2024, 2, 27), date(2024, 3, 4),
    ]


def test_leftmost_date_of_a_url_and_dropped_marks_of_a_slug(spark):
    lit = F.lit
    assert one(spark, D.in_url(lit("/20240304-extra/2024-05-06"), 2025), D.in_url(lit("/18240304/2024-05-06"), 2025), T.slug(lit("J.P. Morin")), T.slug(lit("D'Arcy  St_Jean")), D.in_slug(lit("/house_26apr9")), I.provincial_bill_number(lit("Bill (No. 7)")), I.provincial_bill_number(lit("Bill C-12, an Act"))) == [
        "2024-03-04", "", "jp-morin", "d-arcy-st-jean", "2026-04-09", "7", "C-12",
    ]


def test_text_and_places(spark):
    lit = F.lit
    assert one(spark, T.vote(lit(" OUI ")), T.vote(lit("?")), T.normal_name(lit("Hon. J. O'Neil-Ray")), T.last_first(lit("Doe, Jane")), T.ordinal(lit(12)), T.ordinal(lit(43)), T.percent(lit(2), lit(3)), T.percent(lit(2), lit(0)), T.slug(lit("Québec Œuvre")), P.expand_province(lit(" on ")), P.jurisdiction_key(lit("pei")), P.stage_index(lit("committee"))) == [
        "Yea", "Abstain", "j oneil ray", "Jane Doe", "12th", "43rd", 66, 0, "quebec-uvre", "Ontario", "provincial-PE", 2,
    ]


def test_pages_and_folds(spark):
    lit = F.lit
    places = F.array(*[lit(x) for x in (0, 100, 450, 700, 900)])
    got = one(spark, S.apart(places, 400), B.visible_pages(lit(10), lit(5)), B.visible_pages(lit(4), lit(1)))
    assert got == [[0, 450, 900], [1, -1, 4, 5, 6, -1, 10], [1, 2, 3, 4]]


def test_limiter_anchors_its_window_at_the_first_accepted_event(spark):
    events = spark.createDataFrame([("a", t, t) for t in (0, 1, 2, 10, 11, 12)], "key string, at long, event_id long")
    assert [r.ok for r in L.allowed(events, 2, 10).orderBy("at").collect()] == [True, True, False, True, True, False]


def test_upsert_is_idempotent_and_keeps_what_an_empty_value_would_erase(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    new = spark.createDataFrame([("a", "", 5), ("c", "z", 3)], "id string, name string, n int")
    once = G.upsert(old, new, ["id"], ("name",))
    want = [("a", "x", 5), ("b", "y", 2), ("c", "z", 3)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, G.upsert(once, new, ["id"], ("name",)).collect())) == want


def test_status_rules(spark):
    days = spark.createDataFrame([("a", date(2024, 1, 5)), ("b", date(2024, 3, 1)), ("c", date(2023, 12, 31)), ("d", date(2023, 11, 1))], "jurisdiction string, date date")
    got = dict(map(tuple, C.jurisdiction_status(days, "2024-01-01").collect()))
    assert got == {"a": "in_session", "b": "on_break", "c": "in_session", "d": "on_break"}


def test_scorecard_takes_the_own_vote_out_and_keeps_a_sole_member_in_line(spark):
    who = "id string, party string, government_level string, active boolean, term_start date, term_end date"
    members = spark.createDataFrame([(x, p, "federal", True, date(2020, 1, 1), None) for x, p in (("a", "P"), ("b", "P"), ("c", "P"), ("s", "Q"), ("n", ""))], who)
    divisions = spark.createDataFrame([("d1", date(2021, 1, 1)), ("d2", date(2021, 1, 2))], "id string, date date")
    votes = spark.createDataFrame([("d1", "a", "Yea"), ("d1", "b", "Yea"), ("d1", "c", "Nay"), ("d1", "s", "Nay"), ("d2", "a", "Yea")], "division_id string, member_id string, vote string")
    got = {r.id: tuple(r)[1:] for r in O.scorecard(votes, members, divisions).collect()}
    assert got["s"] == (1, 100, 0, 50)
    assert got["c"] == (1, 0, 100, 50)
    assert got["a"] == (2, 0, 100, 0)  # the others of the party split on d1, and nobody else voted on d2


def test_names(spark):
    who = "id string, name string, riding string, province string, term_start date, term_end date"
    members = spark.createDataFrame([("m1", "Jane Smith", "North", "Ontario", date(2018, 1, 1), date(2022, 1, 1)), ("m2", "Jordan Smith", "South", "Ontario", date(2023, 1, 1), None), ("m3", "Ann Lee", "East", "Ontario", None, None)], who)
    names = spark.createDataFrame([(1, "Smith", "ontario", date(2020, 1, 1)), (2, "Smith", "Ontario", date(2024, 1, 1)), (3, "A Lee", "Ontario", None), (4, "Nobody", "Ontario", None), (5, "Smith (South)", "Ontario", None)], "name_id int, name string, province string, date date")
    got = {r.name_id: r.member_id for r in resolve(names, members).collect()}
    assert got == {1: "m1", 2: "m2", 3: "m3", 4: None, 5: "m2"}
