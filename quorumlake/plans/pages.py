"""Queries of single reads, lists and whole pages over the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import places as P
from ..operators import bills as B
from ..operators import calendar as C
from ..operators import members as M
from ..operators import merge as G
from ..operators import reactions as R
from ..operators import sequences as S
from ..operators import votes as O
from .catalog import AS_OF, MEMBER, OTHER, query, spread

_LINK = """
linked AS (
  SELECT d.id AS division_id, d.date, coalesce(d.bill_id, '') AS bill_id, coalesce(b.number, '') AS bill_number,
         coalesce(nullif(b.short_title, ''), nullif(b.title, ''), '') AS bill_title, coalesce(d.description, '') AS description, coalesce(d.result, '') AS result
  FROM divisions d LEFT JOIN bills b ON b.id = d.bill_id)"""


@query("member_lookup", f"SELECT id, name, coalesce(party, '') AS party, riding, active FROM members WHERE id = {MEMBER}")
def member_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.members(spark, sf_dir).where(F.col("id") == MEMBER).select("id", "name", F.coalesce("party", F.lit("")).alias("party"), "riding", F.coalesce("active", F.lit(False)).alias("active"))


@query(
    "store_lookups",
    """SELECT (SELECT count(*) > 0 FROM divisions WHERE id = 7) AS has_division, (SELECT count(*) > 0 FROM member_votes WHERE division_id = 7) AS has_votes, (SELECT count(*) FROM bills WHERE id LIKE 'on-%') AS bills_of_province,
       (SELECT count(*) FROM divisions WHERE bill_id LIKE 'on-%') AS divisions_of_province, (SELECT count(*) FROM members WHERE lower(province) = 'nation_7' AND government_level = 'provincial') AS provincial_members,
       (SELECT max(parliament) FROM divisions) AS parliament, (SELECT max(session) FROM divisions) AS session, (SELECT count(*) FROM divisions WHERE bill_id = 'on-44-1-6') > 0 AS voted""",
)
def store_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, v, b, m = (f(spark, sf_dir) for f in (V.divisions, V.member_votes, V.bills, V.members))
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    one = d.agg(any_(F.col("id") == 7).alias("has_division"), F.count_if(F.col("bill_id").startswith("on-")).alias("divisions_of_province"), F.max("parliament").alias("parliament"), F.max("session").alias("session"), any_(F.col("bill_id") == "on-44-1-6").alias("voted"))
    two = v.where("division_id = 7").agg((F.count("*") > 0).alias("has_votes"))
    three = b.agg(F.count_if(F.col("id").startswith("on-")).alias("bills_of_province"))
    four = m.agg(F.count_if((F.lower("province") == "nation_7") & (F.col("government_level") == "provincial")).alias("provincial_members"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four)  # one row each


@query("sitting_days", "SELECT DISTINCT 'federal' AS jurisdiction, date FROM divisions WHERE session = 2 UNION ALL SELECT jurisdiction, date FROM calendars WHERE jurisdiction = 'NATION_7'")
def sitting_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    federal = V.divisions(spark, sf_dir).where("session = 2").select(F.lit("federal").alias("jurisdiction"), "date").distinct()
    return federal.unionByName(V.calendars(spark, sf_dir).where("jurisdiction = 'NATION_7'").select("jurisdiction", "date")).orderBy("jurisdiction", "date")


@query("members_of_riding", "SELECT id, name, riding FROM members WHERE riding ILIKE '%tion_1%2%'")
def members_of_riding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.in_riding(V.members(spark, sf_dir), "tion_1%2").select("id", "name", "riding")


@query("member_of_riding", "SELECT id, name FROM members WHERE riding ILIKE '%nation_1%' AND (government_level = 'federal' OR chamber IN ('', 'commons', 'senate')) ORDER BY CASE WHEN lower(riding) = 'nation_1' THEN 0 ELSE 1 END, name, id LIMIT 1")
def member_of_riding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.of_riding(V.members(spark, sf_dir), "nation_1", "federal").select("id", "name")


@query("ridings_by_level", "SELECT government_level, list_sort(list(DISTINCT trim(riding))) AS ridings FROM members WHERE riding <> '' GROUP BY 1")
def ridings_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.members(spark, sf_dir).where("riding <> ''").groupBy("government_level").agg(F.array_sort(F.collect_set(F.trim("riding"))).alias("ridings"))


def divisions_page(divisions: DataFrame, bills: DataFrame, page: int, per_page: int) -> DataFrame:
    return O._linked(divisions, bills).orderBy(F.desc("date"), F.desc("division_id")).offset((page - 1) * per_page).limit(per_page)


@query("divisions_listed", f", {_LINK} SELECT *, (SELECT count(*) FROM divisions) AS total FROM (SELECT * FROM linked ORDER BY date DESC, division_id DESC LIMIT 50 OFFSET 50)")
def divisions_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.divisions(spark, sf_dir)
    return divisions_page(d, V.bills(spark, sf_dir), 2, 50).crossJoin(F.broadcast(d.agg(F.count("*").alias("total"))))  # one row


@query("recent_activity", "(SELECT 'bill' AS kind, id, last_activity_date AS date FROM bills ORDER BY last_activity_date DESC NULLS LAST, id DESC LIMIT 10) UNION ALL (SELECT 'division', id::VARCHAR, date FROM divisions ORDER BY date DESC, id DESC LIMIT 10)")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bills(spark, sf_dir).select(F.lit("bill").alias("kind"), "id", F.col("last_activity_date").alias("date")).orderBy(F.desc_nulls_last("date"), F.desc("id")).limit(10)
    d = V.divisions(spark, sf_dir).orderBy(F.desc("date"), F.desc("id")).limit(10)
    return b.unionByName(d.select(F.lit("division").alias("kind"), F.col("id").cast("string").alias("id"), "date"))


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a bill as written, in no order: those up to its current one, and one that the timeline doesn't know."""
    names = F.array(*[F.lit(x) for x in ("1st_reading", "2nd_reading", "committee", "3rd_reading", "royal_assent")])
    b = V.bills(spark, sf_dir).withColumn("n", F.array_position(names, F.col("current_stage")).cast("int"))
    own = F.concat(F.reverse(F.slice(names, F.lit(1), F.col("n"))), F.when(F.col("part") % 9 == 0, F.array(F.lit("tabled"))).otherwise(F.array().cast("array<string>")))
    return b.select(F.col("id").alias("bill_id"), "introduced_date", "n", F.posexplode(own).alias("pos", "stage")).select("bill_id", "stage", "pos", F.date_add("introduced_date", F.greatest(F.col("n") - F.col("pos"), F.lit(0)) * 10).alias("date"))


_STAGE_NO = "CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 20 THEN 2 WHEN p_size <= 30 THEN 3 WHEN p_size <= 40 THEN 4 ELSE 5 END"


@query("bill_timeline", "SELECT id AS bill_id, CASE WHEN part % 9 = 0 THEN 'tabled' ELSE current_stage END AS current_stage, CAST(introduced_date + INTERVAL 10 DAY AS DATE) AS introduced FROM bills")
def bill_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.timeline(_stages(spark, sf_dir))


@query("bill_stage_dates", f"SELECT b.id AS bill_id, [CAST(b.introduced_date + CAST(10 * i AS INTEGER) AS DATE) for i in range(1, 1 + {_STAGE_NO})] AS dates FROM bills b JOIN part p ON p.p_partkey = b.part WHERE b.part % 9 <> 0")
def bill_stage_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _stages(spark, sf_dir).join(V.bills(spark, sf_dir).where("part % 9 <> 0").select(F.col("id").alias("bill_id")), "bill_id", "left_semi")
    return some.groupBy("bill_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "stage"))), lambda x: x["date"]).alias("dates"))


@query("bills_to_summarize", "SELECT id FROM bills WHERE category IS NULL OR category = '' ORDER BY introduced_date DESC, id DESC LIMIT 50")
def bills_to_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bills(spark, sf_dir).where(F.trim(F.coalesce("category", F.lit(""))) == "").orderBy(F.desc("introduced_date"), F.desc("id")).limit(50).select("id")


_FEED = f""", {_LINK}, feed AS (SELECT v.member_id, l.*, v.vote FROM member_votes v JOIN linked l USING (division_id)),
keyed AS (SELECT *, row_number() OVER (PARTITION BY member_id, CASE WHEN bill_id <> '' THEN 'b:' || bill_id ELSE 'd:' || division_id END ORDER BY date DESC, division_id DESC) AS k FROM feed),
placed AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY bill_id = '', date DESC, division_id DESC) AS place FROM keyed WHERE k = 1)"""


@query("recent_bill_votes", f"{_FEED} SELECT member_id, division_id, date, bill_id, vote, place::INT AS place FROM placed WHERE place <= 5")
def recent_bill_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = V.member_votes(spark, sf_dir).join(O._linked(V.divisions(spark, sf_dir), V.bills(spark, sf_dir)), "division_id")
    return O.recent_bill_votes(feed).select("member_id", "division_id", "date", "bill_id", "vote", "place")


@query(
    "federal_session",
    f"""SELECT 44 AS parliament, 2 AS session, '44th Parliament, 2nd Session' AS label, CASE WHEN bool_or(date = DATE '{AS_OF}') THEN 'in_session' ELSE 'on_break' END AS status,
       CASE WHEN bool_or(date = DATE '{AS_OF}') THEN 'Parliament is sitting today' WHEN min(date) FILTER (date > DATE '{AS_OF}') IS NOT NULL THEN 'Next sitting: ' || strftime(min(date) FILTER (date > DATE '{AS_OF}'), '%Y-%m-%d') ELSE 'No upcoming sitting dates scheduled' END AS detail
FROM divisions WHERE parliament = 44 AND session = 2 AND date <> DATE '{AS_OF}'""",
)
def federal_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.federal_status(V.divisions(spark, sf_dir).where(F.col("date") != F.lit(AS_OF).cast("date")).select("parliament", "session", "date"), 44, 2, AS_OF)


_STATUS = f"""gaps AS (SELECT jurisdiction, date - DATE '{AS_OF}' AS gap FROM calendars),
near AS (SELECT jurisdiction, min(gap) FILTER (gap >= 0) AS until, min(-gap) FILTER (gap <= 0) AS since FROM gaps GROUP BY 1),
status AS (SELECT jurisdiction, CASE WHEN until IS NOT NULL THEN CASE WHEN until <= 7 OR (since <= 7 AND until <= 21) THEN 'in_session' ELSE 'on_break' END
  WHEN since IS NOT NULL THEN CASE WHEN since <= 3 THEN 'in_session' ELSE 'on_break' END ELSE 'status_unavailable' END AS status FROM near)"""


@query("requested_status", f", {_STATUS} SELECT n_name AS jurisdiction, coalesce(status, 'status_unavailable') AS status FROM (SELECT n_name FROM nation UNION ALL SELECT 'NOWHERE') LEFT JOIN status ON jurisdiction = n_name")
def requested_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("jurisdiction"))
    return C.requested_status(V.calendars(spark, sf_dir), wanted.unionByName(spark.range(1).select(F.lit("NOWHERE").alias("jurisdiction"))), AS_OF)


@query("combined_session", f", {_STATUS} SELECT CASE max(CASE status WHEN 'in_session' THEN 2 WHEN 'on_break' THEN 1 ELSE 0 END) WHEN 2 THEN 'in_session' WHEN 1 THEN 'on_break' ELSE 'status_unavailable' END AS status FROM status")
def combined_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.combined_status(C.jurisdiction_status(V.calendars(spark, sf_dir), AS_OF))


@query(
    "sitting_weekdays",
    """SELECT DISTINCT id, CAST(d AS DATE) AS date FROM (SELECT id, unnest(range(introduced_date, introduced_date + 21, INTERVAL 1 DAY)) AS d FROM bills WHERE part % 3 <> 0)
WHERE dayofweek(d) BETWEEN 1 AND 4 AND CAST(d AS DATE) NOT IN (SELECT date FROM divisions WHERE id % 50 = 0)""",
)
def sitting_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monday to Thursday of each range without excepted days; a range that ends before it starts has none."""
    day = F.col("introduced_date")
    ranges = V.bills(spark, sf_dir).select("id", day.alias("first"), F.when(F.col("part") % 3 == 0, F.date_sub(day, 1)).otherwise(F.date_add(day, 20)).alias("last"))
    return C.weekdays(spread(ranges, "id", like=ranges), (2, 3, 4, 5), V.divisions(spark, sf_dir).where("id % 50 = 0").select("date"))


@query("reactions_of_bills", """, last AS (SELECT user_id, bill_id, arg_max(reaction, (ts, event_id)) AS reaction FROM reactions GROUP BY 1, 2)
SELECT b.part AS bill_id, count(l.reaction) AS total, count(*) FILTER (l.reaction = 'support') AS support, count(*) FILTER (l.reaction = 'oppose') AS oppose, count(*) FILTER (l.reaction = 'neutral') AS neutral
FROM bills b LEFT JOIN last l ON l.bill_id = b.part GROUP BY 1""")
def reactions_of_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = R.counts(V.reactions(spark, sf_dir), [F.col("ts"), F.col("event_id")])
    return R.of_bills(V.bills(spark, sf_dir).select(F.col("part").alias("bill_id")), tally)


@query("members_by_province_name", "SELECT coalesce(nullif(province, ''), 'Unknown') AS province, count(*) AS members FROM members GROUP BY 1")
def members_by_province_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_province(V.members(spark, sf_dir))


@query("numbered_divisions", """SELECT id, row_number() OVER (PARTITION BY date ORDER BY id)::INT AS number FROM divisions""")
def numbered_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.numbered(V.divisions(spark, sf_dir).select("id", "date"), ["date"], [F.col("id")]).select("id", "number")


@query("newest_links", "SELECT session, id FROM (SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY date DESC, id DESC) AS n FROM divisions) WHERE n <= 40")
def newest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.numbered(V.divisions(spark, sf_dir), ["session"], [F.desc("date"), F.desc("id")], "n").where("n <= 40").select("session", "id")


@query("alternating_columns", """SELECT division_id, member_id, CASE WHEN (row_number() OVER (PARTITION BY division_id ORDER BY member_id) - 1) % 2 = 0 THEN 'Yea' ELSE 'Nay' END AS vote FROM member_votes""")
def alternating_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in two columns, read row by row: ayes at even places, nays at odd ones."""
    names = V.member_votes(spark, sf_dir).groupBy("division_id").agg(F.array_sort(F.collect_list("member_id")).alias("names"))
    return names.select("division_id", F.posexplode("names").alias("pos", "member_id")).select("division_id", "member_id", F.when(F.col("pos") % 2 == 0, "Yea").otherwise("Nay").alias("vote"))


@query(
    "best_terms",
    """SELECT part, CASE WHEN part % 4 = 3 THEN NULL WHEN part % 4 = 1 THEN 'second' ELSE 'first' END AS term, CASE part % 4 WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 0 END AS years FROM bills""",
)
def best_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, lit = V.bills(spark, sf_dir), F.lit
    term = lambda name, a, z: F.struct(lit(name).alias("name"), lit(a).alias("first"), lit(z).alias("last"))
    pick = F.element_at(F.array(F.array(term("first", 2000, 2005), term("second", 2006, 2008)), F.array(term("first", 2000, 2001), term("second", 2002, 2004)), F.array(term("first", 2000, 2004), term("second", 2005, 2009)), F.array(term("first", 1900, 1901))), (F.col("part") % 4 + 1).cast("int"))
    last = F.when(F.col("part") % 4 == 1, 2004).otherwise(2009)
    best = S.best_term(pick, lit(2000), last)
    years = F.array_max(F.transform(pick, lambda t: S.overlap_years(t["first"], t["last"], lit(2000), last)))
    return b.select("part", best.alias("term"), years.alias("years"))


@query("latest_session", "SELECT max(parliament) AS legislature, max(session) FILTER (parliament = (SELECT max(parliament) FROM divisions)) AS session FROM divisions")
def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct(F.lit(1).alias("score"), "parliament", "session"))
    return V.divisions(spark, sf_dir).agg(best.alias("x")).select(F.col("x.parliament").alias("legislature"), "x.session")


@query("outcomes_apart", "SELECT part, [0, 400 + part % 100, 900 + part % 100] AS kept, CASE WHEN part % 2 = 0 THEN 2 ELSE 0 END AS sections FROM bills")
def outcomes_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part")
    places = F.array(400 + p % 100, F.lit(0).cast("long"), 900 + p % 100, F.lit(399).cast("long"), 410 + p % 100)
    text = F.when(p % 2 == 0, F.concat(F.lit("intro Division 1 a b Division 2 c "), p.cast("string"))).otherwise(F.lit("nothing"))
    return V.bills(spark, sf_dir).select("part", S.apart(places, 400).alias("kept"), F.size(S.sections(text, r"Division \d")).alias("sections"))


def profile(member, votes: DataFrame, members: DataFrame, divisions: DataFrame, bills: DataFrame, limit: int = 500) -> DataFrame:
    """section, key, value rows of a member's page: statistics, category scores, newest votes and missed votes."""
    # the statistics need only the divisions of the member's own votes, and the votes in them
    own = votes.where(F.col("member_id") == member).select("division_id")
    near = votes.join(own, "division_id", "left_semi")
    card = O.scorecard(near, members, divisions).where(F.col("id") == member)
    stats = card.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("total_votes", "party_line_pct", "rebel_pct", "missed_pct")])).alias("x")).select(F.lit("stats").alias("section"), "x.key", "x.value")
    scores = O.category_scores(votes.where(F.col("member_id") == member), divisions, bills).select(F.lit("category").alias("section"), F.col("category").alias("key"), F.col("yea_pct").cast("string").alias("value"))
    me = members.where(F.col("id") == member)
    newest = O.recent_votes(votes.where(F.col("member_id") == member), members, divisions, bills, limit).select("division_id", "vote")
    majorities = O.party_majority(near, members.join(me.select("party"), "party", "left_semi")).select("division_id", "majority")
    recent = newest.join(majorities, "division_id", "left").select(F.lit("vote").alias("section"), F.col("division_id").cast("string").alias("key"), F.concat_ws("/", "vote", F.coalesce("majority", F.lit(""))).alias("value"))
    missed = O.missed_votes(member, votes, members, divisions, bills, limit).select(F.lit("missed").alias("section"), F.col("division_id").cast("string").alias("key"), F.col("party_majority").alias("value"))
    return stats.unionByName(scores).unionByName(recent).unionByName(missed)


@query(
    "member_profile",
    f""", tally AS (
  SELECT v.division_id, m.party, count(*) FILTER (vote = 'Yea') AS yeas, count(*) FILTER (vote = 'Nay') AS nays FROM member_votes v JOIN members m ON m.id = v.member_id WHERE m.party <> '' GROUP BY 1, 2),
me AS (SELECT * FROM members WHERE id = {MEMBER}),
own AS (SELECT v.division_id, v.vote, t.yeas, t.nays FROM member_votes v JOIN me ON me.id = v.member_id LEFT JOIN tally t ON t.division_id = v.division_id AND t.party = me.party),
size AS (SELECT count(*) AS n FROM members m, me WHERE m.active AND m.party = me.party AND m.government_level = me.government_level),
line AS (SELECT count(*) AS total, coalesce(sum(CASE WHEN (yeas - (vote = 'Yea')::INT > nays - (vote = 'Nay')::INT AND vote = 'Yea') OR (nays - (vote = 'Nay')::INT > yeas - (vote = 'Yea')::INT AND vote = 'Nay') THEN 1 ELSE 0 END), 0)::BIGINT AS agreed FROM own),
kept AS (SELECT total, CASE WHEN n <= 1 THEN total ELSE agreed END AS k FROM line, size),
term AS (SELECT count(d.id) AS t, count(v.division_id) AS voted FROM me JOIN divisions d ON d.date >= me.term_start AND (me.term_end IS NULL OR d.date <= me.term_end) LEFT JOIN member_votes v ON v.member_id = me.id AND v.division_id = d.id)
SELECT 'stats' AS section, 'total_votes' AS key, total::VARCHAR AS value FROM kept
UNION ALL SELECT 'stats', 'party_line_pct', (CASE WHEN total > 0 THEN k * 100 // total ELSE 0 END)::BIGINT::VARCHAR FROM kept
UNION ALL SELECT 'stats', 'rebel_pct', (CASE WHEN total > 0 THEN (total - k) * 100 // total ELSE 0 END)::BIGINT::VARCHAR FROM kept
UNION ALL SELECT 'stats', 'missed_pct', (CASE WHEN t > 0 THEN (t - voted) * 100 // t ELSE 0 END)::BIGINT::VARCHAR FROM term
UNION ALL SELECT 'category', b.category, (count(*) FILTER (vote = 'Yea') * 100 // count(*))::BIGINT::VARCHAR FROM own o JOIN divisions d ON d.id = o.division_id JOIN bills b ON b.id = d.bill_id WHERE vote IN ('Yea', 'Nay') AND b.category <> '' GROUP BY 2
UNION ALL (SELECT 'vote', o.division_id::VARCHAR, o.vote || '/' || CASE WHEN yeas > nays THEN 'Yea' WHEN nays > yeas THEN 'Nay' ELSE '' END FROM own o JOIN divisions d ON d.id = o.division_id ORDER BY d.date DESC, d.id DESC LIMIT 500)
UNION ALL (SELECT 'missed', d.id::VARCHAR, CASE WHEN yeas > nays THEN 'Yea' WHEN nays > yeas THEN 'Nay' ELSE 'Split' END FROM divisions d JOIN me ON d.date >= me.term_start AND (me.term_end IS NULL OR d.date <= me.term_end)
  LEFT JOIN tally t ON t.division_id = d.id AND t.party = me.party WHERE d.id NOT IN (SELECT division_id FROM member_votes WHERE member_id = {MEMBER}) ORDER BY d.date DESC, d.id DESC LIMIT 500)""",
)
def member_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(MEMBER, *(v(spark, sf_dir) for v in (V.member_votes, V.members, V.divisions, V.bills)))


@query(
    "bill_page",
    f""", {_LINK}, last AS (SELECT user_id, bill_id, arg_max(reaction, (ts, event_id)) AS reaction FROM reactions WHERE bill_id = 13 GROUP BY 1, 2),
on_list AS (SELECT count(*) % 2 = 1 AS subscribed FROM toggles WHERE user_id = 1 AND bill_id = 13)
SELECT b.id, coalesce(m.name, '') AS sponsor, (SELECT list(division_id ORDER BY date DESC, division_id DESC) FROM linked WHERE bill_id = b.id) AS divisions,
       (SELECT count(*) FROM last) AS reactions, (SELECT subscribed FROM on_list) AS subscribed, CASE WHEN part % 9 = 0 THEN 'tabled' ELSE current_stage END AS stage
FROM bills b LEFT JOIN members m ON m.id = b.sponsor_id WHERE b.part = 13""",
)
def bill_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bills(spark, sf_dir).where("part = 13")
    head = B.detail("ab-44-1-13", b, V.members(spark, sf_dir), V.divisions(spark, sf_dir)).dropDuplicates(["id", "division_id"])
    listed = F.nullif(F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("division_id").isNotNull(), F.struct("date", "division_id"))))), lambda x: x["division_id"]), F.array().cast("array<bigint>"))
    page = head.groupBy("id", "sponsor").agg(listed.alias("divisions"))
    tally = R.counts(V.reactions(spark, sf_dir).where("bill_id = 13"), [F.col("ts"), F.col("event_id")]).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("reactions"))
    on = G.toggled(V.toggles(spark, sf_dir).where("user_id = 1 and bill_id = 13"), ["user_id", "bill_id"]).agg((F.count("*") > 0).alias("subscribed"))
    stage = B.timeline(_stages(spark, sf_dir)).where("bill_id = 'ab-44-1-13'").select(F.col("bill_id").alias("id"), F.col("current_stage").alias("stage"))
    return page.crossJoin(tally).crossJoin(on).join(stage, "id")  # one row each


@query(
    "bills_feed",
    """, preferred AS (SELECT DISTINCT category FROM bills WHERE part IN (2, 3)), chosen AS (SELECT * FROM bills WHERE title ILIKE '%widget%')
SELECT id, (SELECT count(*) FROM chosen) AS total FROM (SELECT * FROM chosen ORDER BY CASE WHEN category IN (SELECT category FROM preferred WHERE category IS NOT NULL) THEN 0 ELSE 1 END, last_activity_date DESC NULLS LAST, id DESC LIMIT 20)""",
)
def bills_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's feed: stored preferences order the page. They are at most as many as there are categories."""
    b = V.bills(spark, sf_dir)
    preferred = tuple(sorted(r[0] for r in b.where("part in (2, 3) and category is not null").select("category").distinct().collect()))
    return B.listing(b, V.members(spark, sf_dir), B.BillFilter(search="widget", sort="auto", preferred=preferred)).select("id", "total")


def compare_page(first, second, level: str, party: str, members: DataFrame, votes: DataFrame, divisions: DataFrame, bills: DataFrame, limit: int = 100) -> DataFrame:
    """section, key, value: parties and members to choose from at a level, agreement and the newest shared votes; a member that isn't among them, or is the other one, compares with nobody."""
    at = members.where(F.col("government_level") == level)
    parties = at.where("party <> ''").select(F.lit("party").alias("section"), F.col("party").alias("key"), F.lit("").alias("value")).distinct()
    listed = at.where(F.col("party") == F.lit(party))
    names = listed.select(F.lit("member").alias("section"), F.col("id").cast("string").alias("key"), F.col("name").alias("value"))
    valid = listed.agg(F.coalesce(F.max(F.col("id") == first), F.lit(False)).alias("a"), F.coalesce(F.max(F.col("id") == second), F.lit(False)).alias("b")).where(F.col("a") & F.col("b") & F.lit(first is not None and first != second))
    own = votes.where(F.col("member_id").isin(first, second))
    share = O.agreement(own).select(F.lit("agreement").alias("section"), F.concat_ws("/", F.col("overlap").cast("string"), F.col("total").cast("string")).alias("key"), F.col("share").cast("int").cast("string").alias("value"))
    shared = O.shared_votes(first, second, votes, divisions, bills, limit).select(F.lit("shared").alias("section"), F.col("division_id").cast("string").alias("key"), F.concat_ws("/", "vote_a", "vote_b").alias("value"))
    return parties.unionByName(names).unionByName(share.unionByName(shared).crossJoin(F.broadcast(valid)).drop("a", "b"))  # one row or none


@query(
    "compare_members",
    """, pick AS (SELECT party FROM members WHERE id = 1), listed AS (SELECT m.* FROM members m, pick WHERE m.government_level = 'federal' AND m.party = pick.party),
two AS (SELECT min(id) AS a, max(id) AS b FROM listed), pair AS (SELECT x.division_id, x.vote AS va, y.vote AS vb FROM two JOIN member_votes x ON x.member_id = two.a JOIN member_votes y ON y.member_id = two.b AND y.division_id = x.division_id WHERE two.a <> two.b)
SELECT 'party' AS section, party AS key, '' AS value FROM members WHERE government_level = 'federal' AND party <> '' GROUP BY 2
UNION ALL SELECT 'member', id::VARCHAR, name FROM listed
UNION ALL SELECT 'agreement', (count(*) FILTER (va = vb)) || '/' || count(*), round_even(100.0::DOUBLE * count(*) FILTER (va = vb) / count(*), 0)::INT::VARCHAR FROM pair HAVING count(*) > 0
UNION ALL (SELECT 'shared', d.id::VARCHAR, va || '/' || vb FROM pair JOIN divisions d ON d.id = pair.division_id ORDER BY d.date DESC, d.id DESC LIMIT 100)""",
)
def compare_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.members(spark, sf_dir)
    own = m.where("id = 1").select("party").head(1)  # a member that isn't there has no party, and nobody is compared
    party = own[0].party if own else None
    two = m.where((F.col("party") == F.lit(party)) & (F.col("government_level") == "federal")).agg(F.min("id"), F.max("id")).first()
    return compare_page(two[0], two[1], "federal", party, m, *(v(spark, sf_dir) for v in (V.member_votes, V.divisions, V.bills)))


@query(
    "home_page",
    f"""{_FEED.replace("member_votes v JOIN", f"(SELECT * FROM member_votes WHERE member_id IN ({MEMBER}, {OTHER})) v JOIN")}, {_STATUS}
SELECT member_id, place::INT AS place, division_id, (SELECT CASE max(CASE status WHEN 'in_session' THEN 2 WHEN 'on_break' THEN 1 ELSE 0 END) WHEN 2 THEN 'in session' WHEN 1 THEN 'on break' ELSE 'status unavailable' END FROM status) AS status FROM placed WHERE place <= 5""",
)
def home_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest bill votes of a visitor's two members, and whether any legislature sits."""
    votes = V.member_votes(spark, sf_dir).where(F.col("member_id").isin(MEMBER, OTHER))
    feed = votes.join(O._linked(V.divisions(spark, sf_dir), V.bills(spark, sf_dir)), "division_id")
    status = C.combined_status(C.jurisdiction_status(V.calendars(spark, sf_dir), AS_OF)).select(P.status_text(F.col("status")).alias("status"))
    return O.recent_bill_votes(feed).select("member_id", "place", "division_id").crossJoin(F.broadcast(status))  # one row


