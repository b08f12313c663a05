"""Printed calendars and session evidence against plain versions."""

import itertools
import math
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from quorumlake.operators import printed as P
from quorumlake.operators import sessions as S

WORDS = "page_id long, text string, left int, top int, width int, height int, confidence double, pixels int, sitting int, violet int"


def all_splits(token):
    out = []
    for sizes in itertools.product((1, 2), repeat=len(token)):
        at, days = 0, []
        for k, size in enumerate(sizes):
            if at >= len(token):
                break
            days.append((token[at : at + size], size))
            at += size
        if at == len(token) and all(len(d) == s and 1 <= int(d) <= 31 for d, s in days):
            out.append(([int(d) for d, _ in days], [s for _, s in days]))
    return out


def test_splits_equal_exhaustive_ones(spark):
    assert P.splits("91011") == [9, 10, 11]
    rnd = random.Random(4)
    tokens = ["".join(rnd.choice("0123456789") for _ in range(n)) for n in range(1, 13) for _ in range(30)] + ["1" * 12, "282930", "00", "7", "", "3a", "٣٤", None]
    got = dict(spark.createDataFrame([(t,) for t in tokens], "t string").select("t", P.day_split(F.col("t"))).collect())
    for t in tokens:
        want = None
        if t and t.isascii() and t.isdigit() and len(t) > 1:
            score = lambda d: sum(1 + 100 * (k > 0 and x == d[k - 1] + 1) for k, x in enumerate(d))
            ways = sorted({(-score(d), tuple(s), tuple(d)) for d, s in all_splits(t)})
            want = list(ways[0][2]) if ways and len(ways[0][2]) >= 2 else None
        assert got[t] == want, t


def plain_clusters(values, k):
    if len(values) < k:
        return None
    order = sorted(values)
    centers = [order[math.floor(i * (len(order) - 1) / max(k - 1, 1) + 0.5)] for i in range(k)]
    old = [0] * len(values)
    for _ in range(20):
        new = [min(range(k), key=lambda i: (abs(v - centers[i]), i)) for v in values]
        groups = [[v for v, a in zip(values, new, strict=True) if a == i] for i in range(k)]
        if not all(groups):
            return None
        centers = [sum(g) / len(g) for g in groups]
        if new == old:
            break
        old = new
    return sorted(centers)


def test_clusters_equal_a_loop(spark):
    rnd = random.Random(8)
    lists = [[float(rnd.choice((rnd.randint(0, 9), rnd.randint(0, 400)))) for _ in range(rnd.randint(0, 40))] for _ in range(200)] + [[5.0] * 6, [1.0, 1.0, 2.0], []]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<double>")
    for n in (1, 3, 4):
        got = {r[0]: r[1] for r in frame.select("k", P.clusters(F.col("v"), n)).collect()}
        for k, v in enumerate(lists):
            want = plain_clusters(v, n)
            assert (got[k] is None) == (want is None), (v, n)
            assert want is None or all(abs(a - b) < 1e-9 for a, b in zip(got[k], want, strict=True))
    assert got[len(lists) - 3] is None


def grid(year, sitting, holidays=(), columns=3, wide=300, tall=200, joined=False):
    """Words of a year's calendar on a page of 1000, months in rows of `columns`, weeks below each other."""
    rows = []
    for m in range(1, 13):
        x0, y0 = (m - 1) % columns * wide, (m - 1) // columns * tall
        rows.append((date(year, m, 1).strftime("%B")[:4], x0 + 60, y0, 60, 10, 0.0, 100, 0, 0))
        d = date(year, m, 1)
        while d.month == m:
            week = (d - timedelta(days=d.weekday()) - (date(year, m, 1) - timedelta(days=date(year, m, 1).weekday()))).days // 7
            rows.append((str(d.day), x0 + 25 * d.weekday(), y0 + 20 + 22 * week, 20, 10, 0.0, 100, 9 if d in sitting else 7, 8 if d in holidays else 7))
            d += timedelta(days=1)
    return rows


def test_highlighted_days(spark):
    sitting = {date(2026, 3, 3), date(2026, 3, 17), date(2026, 10, 1), date(2026, 12, 24)}
    rows = [(1, *r) for r in grid(2026, sitting)] + [(2, "31", 0, 0, 10, 10, 0.0, 100, 99, 0), (2, "feb", 0, 50, 10, 10, 0.0, 100, 99, 0), (2, "3", 0, 90, 10, 10, 20.0, 100, 99, 0), (2, "4", 0, 95, 10, 10, 30.0, 100, 99, 0), (2, None, 0, 95, 10, 10, 30.0, 100, 99, 0), (3, "5", 0, 0, 9, 9, 0.0, 10, 9, 0)]
    words = spark.createDataFrame(rows, WORDS)
    pages = spark.createDataFrame([(k, 2026, 1000) for k in (1, 2, 3)], "page_id long, year int, height_of_page int")
    frame = P.highlighted_days(words, pages)
    assert "CartesianProduct" not in frame._jdf.queryExecution().toString() and "NestedLoop" not in frame._jdf.queryExecution().toString()
    got = {(r.page_id, r.date) for r in frame.collect()}
    want = set()
    for page in (1, 2, 3):
        own = [r[1:] for r in rows if r[0] == page and r[1]]
        heads = sorted((y + h // 2, x + w // 2, next(k for k, m in enumerate(P.MONTHS, 1) if m.startswith(t.lower()))) for t, x, y, w, h, *_ in own if len(t) >= 3 and any(m.startswith(t.lower()) for m in P.MONTHS))
        for t, x, y, w, h, sure, pixels, on, _ in own:
            if heads and t.isdigit() and 1 <= int(t) <= 31 and not 0 < sure < 30 and on >= 0.08 * pixels:
                month = min(heads, key=lambda p: math.hypot(1.8 * (x + w // 2 - p[1]), y + h // 2 - p[0]))[2]
                try:
                    want.add((page, date(2026, month, int(t))))
                except ValueError:
                    pass
    assert got == want and {d for p, d in got if p == 1} == sitting and {d for p, d in got if p == 2} == {date(2026, 2, 4)}


def test_highlighted_weeks(spark):
    sitting = {date(2026, 3, 2), date(2026, 5, 6), date(2026, 5, 7), date(2026, 12, 30)}
    rows = [(1, *r) for r in grid(2026, sitting, {date(2026, 5, 7)})]
    first = next(r for r in rows if r[1] == "10")
    second = next(r for r in rows if r[1] == "11" and r[3] == first[3])
    rows = [r for r in rows if r not in (first, second)] + [(1, "1011", first[2], first[3], 45, 10, 0.0, 100, 7, 0)]
    few = [(2, *r) for r in grid(2026, sitting)[:39]]
    words = spark.createDataFrame(rows + few, WORDS)
    pages = spark.createDataFrame([(1, 2026, 1000), (2, 2026, 1000)], "page_id long, year int, height_of_page int")
    got = sorted((r.page_id, r.date) for r in P.highlighted_weeks(words, pages).collect())
    days = [date(2026, 3, d) for d in (3, 4, 5, 6)] + [date(2026, 5, d) for d in (5, 6, 8)] + [date(2026, 12, d) for d in (29, 30, 31)]
    assert got == [(1, d) for d in days]
    cut = P.day_words(words.where("page_id = 1")).where("top = 42 and left < 200").select("day", "left", "width").collect()
    assert {tuple(r) for r in cut} >= {(10, first[2], 22), (11, first[2] + 22, 22)}


def best(spark, code, text, weight=50):
    rows = S.candidates(spark.createDataFrame([(code, text, weight)], "code string, text string, weight int")).collect()
    return max(((r.score, r.legislature, r.session) for r in rows), default=None)


def test_forms_of_sessions(spark):
    assert best(spark, "mb", "Current Session: 43 - 3 (2025- )") == (90, 43, 3)
    assert best(spark, "mb", "https://x/bills/43-3/index.php") == (70, 43, 3)
    assert best(spark, "on", "https://x/bills/43-3/index.php") is None
    assert best(spark, "qc", "/42-1/") == (65, 42, 1) and best(spark, "qc", "/142-1/") is None and best(spark, "qc", "/42-10") is None
    for text in ("Legislature, Session 31-2 (2025-2026)", "Legislature 31, Session 2 (2025-2026)", "https://x/dashboard?legl=31&session=2&sectionb=d"):
        assert best(spark, "ab", text) == (70, 31, 2)
    assert best(spark, "ns", "https://x/hansard-debates/assembly-65-session-1") == (50, 65, 1)
    assert best(spark, "pe", "2nd Session, 67th General Assembly, 3rd Session (archives)") == (20, 67, 3)
    assert best(spark, "xx", "44th Parliament 0th session") is None
    assert best(spark, "xx", None) is None


def test_resolved_by_weight_then_store_then_constant(spark):
    pages = [
        (1, "aa", "https://x/assembly-7-session-2", "<title>Archive: 9th Parliament, 1st Session</title><a href='/8th-parliament-3rd-session'>old</a>"),
        (2, "bb", "https://x/", "<h2>12th <b>Legislature</b>, 4th session</h2><h3>12th Legislature 5 session</h3><p><a>13th parliament 9th session</a>"),
        (3, "cc", "", "<p>44th Parliament 1st session"), (4, "dd", None, None), (5, "ee", "", ""),
    ]
    bills = spark.createDataFrame([("cc-4-9-1", 4, 9), ("CC-6-2-1", 6, 2), ("dd-0-0-1", 0, 0)], "id string, parliament int, session int")
    got = {tuple(r) for r in S.resolve(spark.createDataFrame(pages, "page_id long, code string, url string, html string"), bills, {"dd": (43, 1)}).collect()}
    assert got == {("aa", "pages", 7, 2), ("bb", "pages", 12, 5), ("cc", "stored", 6, 9), ("dd", "constant", 43, 1), ("ee", "constant", 1, 1)}


def test_chosen_option(spark):
    box = "<select class='a sessionLegislature'><option value='-1'>43rd Legislature, 2nd session<option value='1' title='42nd Legislature'>1st Session<option value=' 2 '>143rd legislature 2nd session<option value='3'>43 Legislature, 2 session</select>"
    rows = [(1, box, 43, 2), (2, box, 42, 1), (3, box, 40, 1), (4, box.replace("sessionLegislature", "x"), 43, 2), (5, None, 1, 1), (6, box, None, 2)]
    got = {tuple(r) for r in S.chosen_option(spark.createDataFrame(rows, "page_id long, html string, legislature int, session int")).collect()}
    assert got == {(1, "3"), (2, "1"), (3, "1"), (4, ""), (5, ""), (6, "1")}
