"""The engine's queries over the domain views, each with its SQL twin.

`QUERIES` take (spark, sf_dir); `ORACLES` are the same in SQL over the tables
they read. Both give the same column names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import dates as D
from ..functions import ids as I
from ..functions import places as P
from ..functions import text as T
from ..operators import bills as B
from ..operators import calendar as C
from ..operators import limiter as L
from ..operators import members as M
from ..operators import merge as G
from ..operators import reactions as R
from ..operators import votes as O
from . import choices, contained, evidence, houses, journals, pages, provincial, rules, schedules, upper, writes  # noqa: F401  these register their queries
from .catalog import AS_OF, MEMBER, ORACLES, OTHER, QUERIES, query, votes_by_division  # noqa: F401

_TALLY = """
tally AS (
  SELECT v.division_id, m.party, count(*) FILTER (vote = 'Yea') AS yeas, count(*) FILTER (vote = 'Nay') AS nays
  FROM member_votes v JOIN members m ON m.id = v.member_id WHERE m.party IS NOT NULL AND m.party <> '' GROUP BY 1, 2)"""
_SIDE = "CASE WHEN yeas > nays THEN 'Yea' WHEN nays > yeas THEN 'Nay' END"
_LINKED = """
linked AS (
  SELECT d.id AS division_id, d.date, coalesce(d.bill_id, '') AS bill_id, coalesce(b.number, '') AS bill_number,
         coalesce(nullif(b.short_title, ''), nullif(b.title, ''), '') AS bill_title,
         coalesce(d.description, '') AS description, coalesce(d.result, '') AS result
  FROM divisions d LEFT JOIN bills b ON b.id = d.bill_id)"""


@query(
    "member_scorecard",
    f""", {_TALLY}, sizes AS (
  SELECT party, government_level, count(*) AS size FROM members WHERE active AND party <> '' GROUP BY 1, 2),
own AS (
  SELECT v.member_id, v.vote, t.yeas - (v.vote = 'Yea')::INT AS y, t.nays - (v.vote = 'Nay')::INT AS n
  FROM member_votes v JOIN members m ON m.id = v.member_id LEFT JOIN tally t ON t.division_id = v.division_id AND t.party = m.party),
line AS (
  SELECT member_id, count(*) AS total, coalesce(sum(CASE WHEN (y > n AND vote = 'Yea') OR (n > y AND vote = 'Nay') THEN 1 ELSE 0 END), 0)::BIGINT AS agreed
  FROM own GROUP BY 1),
term AS (
  SELECT m.id, count(d.id) AS in_term, count(v.division_id) AS voted
  FROM members m LEFT JOIN divisions d ON d.date >= m.term_start AND (m.term_end IS NULL OR d.date <= m.term_end)
  LEFT JOIN member_votes v ON v.member_id = m.id AND v.division_id = d.id GROUP BY 1),
joined AS (
  SELECT m.id, coalesce(l.total, 0) AS total, CASE WHEN coalesce(s.size, 0) <= 1 THEN coalesce(l.total, 0) ELSE coalesce(l.agreed, 0) END AS kept,
         greatest(t.in_term - t.voted, 0) AS missed, t.in_term
  FROM members m LEFT JOIN sizes s ON s.party = m.party AND s.government_level = m.government_level
  LEFT JOIN line l ON l.member_id = m.id LEFT JOIN term t ON t.id = m.id)
SELECT id, total::BIGINT AS total_votes, CASE WHEN total > 0 THEN kept * 100 // total ELSE 0 END::BIGINT AS party_line_pct,
       CASE WHEN total > 0 THEN (total - kept) * 100 // total ELSE 0 END::BIGINT AS rebel_pct,
       CASE WHEN in_term > 0 THEN missed * 100 // in_term ELSE 0 END::BIGINT AS missed_pct FROM joined""",
)
def member_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.scorecard(V.member_votes(spark, sf_dir), V.members(spark, sf_dir), V.divisions(spark, sf_dir))


@query("party_majority", f", {_TALLY} SELECT *, {_SIDE} AS majority FROM tally")
def party_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.party_majority(V.member_votes(spark, sf_dir), V.members(spark, sf_dir))


@query("party_sizes", "SELECT party, government_level, count(*) AS size FROM members WHERE active AND party IS NOT NULL AND party <> '' GROUP BY 1, 2")
def party_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.party_sizes(V.members(spark, sf_dir))


@query(
    "recent_votes",
    f""", {_TALLY}, {_LINKED}, ranked AS (
  SELECT v.*, row_number() OVER (PARTITION BY v.member_id ORDER BY d.date DESC, d.id DESC) AS rn
  FROM member_votes v JOIN divisions d ON d.id = v.division_id)
SELECT r.member_id, k.*, r.vote, coalesce(r.vote = {_SIDE}, false) AS with_party, coalesce({_SIDE}, '') AS party_majority
FROM ranked r JOIN members m ON m.id = r.member_id JOIN linked k USING (division_id)
LEFT JOIN tally t ON t.division_id = r.division_id AND t.party = m.party WHERE rn <= 50""",
)
def recent_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.recent_votes(*(v(spark, sf_dir) for v in (V.member_votes, V.members, V.divisions, V.bills)))


@query(
    "missed_votes",
    f""", {_TALLY}, {_LINKED}, missed AS (
  SELECT d.id, m.party FROM divisions d JOIN members m ON m.id = {MEMBER} AND d.date >= m.term_start AND (m.term_end IS NULL OR d.date <= m.term_end)
  WHERE d.id NOT IN (SELECT division_id FROM member_votes WHERE member_id = {MEMBER}) ORDER BY d.date DESC, d.id DESC LIMIT 50)
SELECT k.*, coalesce({_SIDE}, 'Split') AS party_majority
FROM missed x JOIN linked k ON k.division_id = x.id LEFT JOIN tally t ON t.division_id = x.id AND t.party = x.party""",
)
def missed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.missed_votes(MEMBER, *(v(spark, sf_dir) for v in (V.member_votes, V.members, V.divisions, V.bills)))


@query(
    "category_scores",
    """SELECT v.member_id, b.category, count(*) AS total, count(*) FILTER (vote = 'Yea') AS yeas, count(*) FILTER (vote = 'Nay') AS nays,
       (count(*) FILTER (vote = 'Yea') * 100 // count(*))::BIGINT AS yea_pct
FROM member_votes v JOIN divisions d ON d.id = v.division_id JOIN bills b ON b.id = d.bill_id
WHERE vote IN ('Yea', 'Nay') AND b.category <> '' GROUP BY 1, 2""",
)
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.category_scores(V.member_votes(spark, sf_dir), V.divisions(spark, sf_dir), V.bills(spark, sf_dir))


@query(
    "vote_agreement",
    """SELECT a.member_id AS member_a, b.member_id AS member_b, count(*) FILTER (a.vote = b.vote) AS overlap, count(*) AS total,
       round_even(100.0::DOUBLE * count(*) FILTER (a.vote = b.vote) / count(*), 0) AS share
FROM member_votes a JOIN member_votes b ON a.division_id = b.division_id AND a.member_id < b.member_id GROUP BY 1, 2""",
)
def vote_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.agreement(votes_by_division(spark, sf_dir))


@query(
    "shared_votes",
    f""", {_LINKED} SELECT k.*, a.vote AS vote_a, b.vote AS vote_b FROM member_votes a JOIN member_votes b ON a.division_id = b.division_id
JOIN linked k ON k.division_id = a.division_id WHERE a.member_id = {MEMBER} AND b.member_id = {OTHER} ORDER BY k.date DESC, k.division_id DESC LIMIT 50""",
)
def shared_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.shared_votes(MEMBER, OTHER, V.member_votes(spark, sf_dir), V.divisions(spark, sf_dir), V.bills(spark, sf_dir))


_PROVINCE = "CASE " + " ".join(f"WHEN chamber = '{stored}' OR lower(id) LIKE '{code}-%' THEN '{name}'" for code, stored, name in P.LEGISLATURES) + " ELSE '' END"
_LISTED = "SELECT b.id, b.number, title, coalesce(short_title, '') AS short_title, coalesce(b.chamber, '') AS chamber, coalesce(category, '') AS category, current_stage, last_activity_date, coalesce(m.name, '') AS sponsor, (SELECT count(*) FROM chosen) AS total"


def _page(where: str, order: str, offset: int = 0) -> str:
    return f", chosen AS (SELECT * FROM bills WHERE {where}), shown AS (SELECT * FROM chosen ORDER BY {order} LIMIT 20 OFFSET {offset}) {_LISTED} FROM shown b LEFT JOIN members m ON m.id = b.sponsor_id"


_NEWEST = "last_activity_date DESC NULLS LAST, id DESC"


def _listing(name: str, f: B.BillFilter, where: str, order: str, offset: int = 0) -> None:
    query(name, _page(where, order, offset))(lambda spark, sf_dir: B.listing(V.bills(spark, sf_dir), V.members(spark, sf_dir), f))


_local = f"((chamber NOT IN ('commons', 'senate') AND chamber <> '') OR regexp_matches(lower(id), '^({'|'.join(c for c, _, _ in P.LEGISLATURES)})-'))"
_listing("bills_newest", B.BillFilter(page=2), "true", _NEWEST, 20)
_listing("bills_search", B.BillFilter(search="widget", sort="date_asc"), "title ILIKE '%widget%' OR number ILIKE '%widget%' OR short_title ILIKE '%widget%'", "last_activity_date ASC NULLS FIRST, id")
_listing("bills_by_stage", B.BillFilter(level="federal", sort="stage"), f"NOT {_local}", f"current_stage, {_NEWEST}")
_listing("bills_provincial", B.BillFilter(level="provincial", sort="category"), _local, f"category NULLS FIRST, {_NEWEST}")
_listing("bills_of_province", B.BillFilter(province="AB"), f"{_PROVINCE} = 'Alberta'", _NEWEST)
_listing("bills_personal", B.BillFilter(sort="auto", subscribed=("44-1-c-23", "on-44-1-6"), preferred=("ECONOMY BRASS",)), "true", f"CASE WHEN id IN ('44-1-c-23', 'on-44-1-6') THEN 0 ELSE 1 END, CASE WHEN category = 'ECONOMY BRASS' THEN 0 ELSE 1 END, {_NEWEST}")


@query("bill_provinces", f"SELECT DISTINCT {_PROVINCE} AS province FROM bills WHERE {_PROVINCE} <> ''")
def bill_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.provinces(V.bills(spark, sf_dir))


@query("bill_stage_counts", "SELECT current_stage, category, count(*) AS n FROM bills GROUP BY 1, 2")
def bill_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bills(spark, sf_dir).groupBy("current_stage", "category").agg(F.count("*").alias("n"))


@query("bill_detail", "SELECT b.id, b.number, b.title, coalesce(m.name, '') AS sponsor, d.id AS division_id, d.date, d.result FROM bills b LEFT JOIN members m ON m.id = b.sponsor_id LEFT JOIN divisions d ON d.bill_id = b.id WHERE b.id = 'ab-44-1-13'")
def bill_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.detail("ab-44-1-13", V.bills(spark, sf_dir), V.members(spark, sf_dir), V.divisions(spark, sf_dir))


_STAGE_LABEL = "CASE current_stage WHEN 'committee' THEN 'Cmte Reading' WHEN 'royal_assent' THEN 'Assent Reading' ELSE replace(current_stage, '_reading', '') || ' Reading' END"


@query("bill_labels", f"SELECT id, {_PROVINCE} AS province, {_local} AS provincial, CASE WHEN lower(coalesce(chamber, '')) NOT IN ('commons', 'senate') AND regexp_matches(lower(id), '^({'|'.join(c for c, _, _ in P.LEGISLATURES)})-') THEN 'Provincial' ELSE 'Federal' END AS level, {_STAGE_LABEL} AS stage_label, coalesce(nullif(short_title, ''), title, '') AS shown FROM bills")
def bill_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.labels(V.bills(spark, sf_dir)).select("id", "province", "provincial", "level", "stage_label", "shown")


@query("member_directory", "SELECT * FROM members WHERE name ILIKE '%00%' AND government_level = 'federal'")
def member_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.directory(V.members(spark, sf_dir), name="00", level="federal")


@query("member_facets", " UNION ".join(f"SELECT '{x}' AS field, {x} AS value FROM members WHERE {x} <> ''" for x in ("party", "province", "riding")))
def member_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distinct_values(V.members(spark, sf_dir))


@query("members_by_province", "SELECT coalesce(nullif(province, ''), 'Unknown') AS province, count(*) FILTER (government_level = 'federal') AS federal, count(*) FILTER (government_level = 'provincial') AS provincial FROM members GROUP BY 1")
def members_by_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_province_and_level(V.members(spark, sf_dir))


_LAST = "last AS (SELECT user_id, bill_id, arg_max(reaction, (ts, event_id)) AS reaction FROM reactions GROUP BY 1, 2)"
_KINDS = ", ".join(f"count(*) FILTER (reaction = '{k}') AS {k}" for k in R.KINDS)
_SHARES = ", ".join(f"(count(*) FILTER (reaction = '{k}') * 100 // count(*))::BIGINT AS {k}_pct" for k in R.KINDS)


@query("reaction_counts", f", {_LAST} SELECT bill_id, count(*) AS total, {_KINDS}, {_SHARES} FROM last GROUP BY 1")
def reaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts(V.reactions(spark, sf_dir), [F.col("ts"), F.col("event_id")])


@query("subscriptions", "SELECT user_id, bill_id, count(*) AS toggles FROM toggles GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.toggled(V.toggles(spark, sf_dir), ["user_id", "bill_id"])


_GAPS = f"gaps AS (SELECT jurisdiction, date, date - DATE '{AS_OF}' AS gap FROM calendars)"


@query(
    "jurisdiction_status",
    f""", {_GAPS}, near AS (SELECT jurisdiction, min(gap) FILTER (gap >= 0) AS until, min(-gap) FILTER (gap <= 0) AS since FROM gaps GROUP BY 1)
SELECT jurisdiction, CASE WHEN until IS NOT NULL THEN CASE WHEN until <= 7 OR (since <= 7 AND until <= 21) THEN 'in_session' ELSE 'on_break' END
  WHEN since IS NOT NULL THEN CASE WHEN since <= 3 THEN 'in_session' ELSE 'on_break' END ELSE 'status_unavailable' END AS status FROM near""",
)
def jurisdiction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.jurisdiction_status(V.calendars(spark, sf_dir), AS_OF)


@query("calendar_neighbours", f"SELECT jurisdiction, min(date) FILTER (date >= DATE '{AS_OF}') AS next, max(date) FILTER (date <= DATE '{AS_OF}') AS previous, coalesce(max(date = DATE '{AS_OF}'), false) AS sits FROM calendars GROUP BY 1")
def calendar_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.next_and_previous(V.calendars(spark, sf_dir), AS_OF)


@query(
    "rate_limit",
    """, recursive_input AS (SELECT user_id AS key, "at", event_id, row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS rn FROM attempts),
walk(key, rn, "at", event_id, start, n, ok) AS (
  SELECT key, rn, "at", event_id, "at", 1, true FROM recursive_input WHERE rn = 1
  UNION ALL
  SELECT e.key, e.rn, e."at", e.event_id, CASE WHEN e."at" - w.start >= 86400000000 THEN e."at" ELSE w.start END,
         CASE WHEN e."at" - w.start >= 86400000000 THEN 1 WHEN w.n < 2 THEN w.n + 1 ELSE w.n END,
         e."at" - w.start >= 86400000000 OR w.n < 2
  FROM walk w JOIN recursive_input e ON e.key = w.key AND e.rn = w.rn + 1)
SELECT key, "at", event_id, ok FROM walk""",
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.allowed(V.attempts(spark, sf_dir).withColumnRenamed("user_id", "key"), 2, 86_400_000_000)


ORACLES["rate_limit"] = ORACLES["rate_limit"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("bill_id_parts", "SELECT id, upper(coalesce(nullif(array_to_string(string_split(id, '-')[3:], '-'), ''), '')) AS number, try_cast(string_split(id, '-')[1] AS INT) AS parliament, try_cast(string_split(id, '-')[2] AS INT) AS session FROM bills")
def bill_id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("id")
    return V.bills(spark, sf_dir).select("id", I.number_of_bill(c).alias("number"), I.parliament_of_bill(c).alias("parliament"), I.session_of_bill(c).alias("session"))


@query("dates_in_text", "SELECT id, strftime(date, '%Y-%m-%d') AS found, strftime(date, '%b %-d, %Y') AS shown, CAST(date_trunc('week', date) AS DATE) AS monday FROM divisions")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.divisions(spark, sf_dir)
    said = F.concat(F.lit("Sitting of "), F.date_format("date", "MMMM d, yyyy"), F.lit(" (continued)"))
    found = D.in_text(said)
    return d.select("id", found.alias("found"), D.shown(found).alias("shown"), D.monday(F.col("date")).alias("monday"))


@query("page_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s\x{85}\p{Z}]+', ' ', 'g'), ' ') AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", T.visible(F.col("html")).alias("text"))
