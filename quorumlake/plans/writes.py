"""Queries of the writes: a table after a write, and what landed pages and texts hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..operators import calendar as C
from ..operators import extract as X
from ..operators import limiter as L
from ..operators import merge as G
from .catalog import ORACLES, query, spread, votes_by_division


@query(
    "members_upserted",
    """, old AS (SELECT id, name, chamber, government_level FROM members WHERE id % 3 <> 0),
new AS (SELECT id, name || '*' AS name, CASE WHEN id % 4 = 0 THEN 'commons' ELSE chamber END AS chamber, CASE WHEN id % 8 = 0 THEN 'federal' ELSE government_level END AS government_level FROM members WHERE id % 2 = 0)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.chamber ELSE o.chamber END AS chamber,
       CASE WHEN n.id IS NOT NULL THEN n.government_level ELSE o.government_level END AS government_level FROM old o FULL JOIN new n ON n.id = o.id""",
)
def members_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.members(spark, sf_dir).select("id", "name", "chamber", "government_level")
    new = m.where("id % 2 = 0").withColumn("name", F.concat("name", F.lit("*")))
    new = new.withColumn("chamber", F.when(F.col("id") % 4 != 0, F.col("chamber")).when(F.col("id") % 3 == 0, F.lit(""))).withColumn("government_level", F.when(F.col("id") % 8 != 0, F.col("government_level")).otherwise(""))
    return G.upsert(m.where("id % 3 <> 0"), G.defaults(new), ["id"])


@query(
    "bills_upserted",
    """, old AS (SELECT id, part, title, chamber, category, sponsor_id::VARCHAR AS sponsor_id FROM bills WHERE part % 5 <> 0)
SELECT coalesce(o.id, b.id) AS id, CASE WHEN b.part % 3 = 0 THEN b.title || '!' ELSE o.title END AS title,
       CASE WHEN b.part % 3 = 0 THEN coalesce(nullif(CASE WHEN b.part % 2 = 0 THEN '' ELSE 'senate' END, ''), o.chamber, CASE WHEN b.part % 2 = 0 THEN '' ELSE 'senate' END) ELSE o.chamber END AS chamber,
       CASE WHEN b.part % 3 = 0 THEN coalesce(o.category, '') ELSE o.category END AS category, CASE WHEN b.part % 3 = 0 THEN CASE WHEN b.part % 2 = 0 THEN NULL ELSE 'm1' END ELSE o.sponsor_id END AS sponsor_id
FROM bills b LEFT JOIN old o ON o.id = b.id WHERE b.part % 3 = 0 OR o.id IS NOT NULL""",
)
def bills_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bills(spark, sf_dir)
    old = b.where("part % 5 <> 0").select("id", "title", "chamber", "category", F.col("sponsor_id").cast("string").alias("sponsor_id"))
    even = F.col("part") % 2 == 0
    new = b.where("part % 3 = 0").select("id", F.concat("title", F.lit("!")).alias("title"), F.when(even, "").otherwise("senate").alias("chamber"), F.lit("").alias("category"), F.nullif(F.when(even, "").otherwise("m1"), F.lit("")).alias("sponsor_id"))
    return G.upsert(old, new, ["id"], ("chamber", "category"))


@query(
    "divisions_upserted",
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'New' ELSE description END AS description, CASE WHEN id % 2 = 0 THEN 'commons' ELSE 'old' END AS chamber, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN NULL ELSE bill_id END AS bill_id FROM divisions""",
)
def divisions_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.divisions(spark, sf_dir).select("id", "description", "bill_id")
    old = d.withColumn("chamber", F.lit("old"))
    new = d.where("id % 2 = 0").select("id", F.lit("New").alias("description"), F.coalesce(F.nullif(F.lit(""), F.lit("")), F.lit("commons")).alias("chamber"), F.nullif(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("bill_id")), F.lit("")).alias("bill_id"))
    return G.upsert(old, new, ["id"])


_CAST = "CASE l_returnflag WHEN 'A' THEN 'Yea' WHEN 'R' THEN 'Nay' ELSE 'Paired' END"


@query(
    "votes_upserted",
    f"""SELECT l_orderkey AS division_id, l_suppkey AS member_id, arg_max({_CAST}, (l_linenumber, l_shipdate, l_extendedprice, l_partkey, l_quantity)) AS vote FROM lineitem GROUP BY 1, 2""",
)
def votes_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    log = line.select(F.col("l_orderkey").alias("division_id"), F.col("l_suppkey").alias("member_id"), F.when(F.col("l_returnflag") == "A", "Yea").when(F.col("l_returnflag") == "R", "Nay").otherwise("Paired").alias("vote"), "l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey", "l_quantity")
    new = G.latest(log, ["division_id", "member_id"], [F.col(c) for c in ("l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey", "l_quantity")]).select("division_id", "member_id", "vote")
    return G.upsert(new.where("division_id % 2 = 0").withColumn("vote", F.lit("?")), new, ["division_id", "member_id"])


@query(
    "bill_stages_written",
    "SELECT id AS bill_id, current_stage AS stage, introduced_date AS date FROM bills UNION SELECT id, '1st_reading', introduced_date FROM bills WHERE part % 2 = 0",
)
def bill_stages_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bills(spark, sf_dir)
    stored = b.select(F.col("id").alias("bill_id"), F.col("current_stage").alias("stage"), F.col("introduced_date").alias("date"))
    new = b.where("part % 2 = 0").select(F.col("id").alias("bill_id"), F.lit("1st_reading").alias("stage"), F.col("introduced_date").alias("date"))
    return G.insert_missing(stored, new.unionByName(new).unionByName(stored), ["bill_id", "stage", "date"])


@query("sitting_dates_written", "SELECT DISTINCT parliament, session, date FROM divisions")
def sitting_dates_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.divisions(spark, sf_dir).select("parliament", "session", "date")
    return G.insert_missing(d.where("session = 1").distinct(), d, ["parliament", "session", "date"])


@query(
    "calendar_replaced",
    """SELECT jurisdiction, date FROM calendars WHERE jurisdiction >= 'NATION_2'
UNION SELECT DISTINCT jurisdiction, CAST(date + INTERVAL 1 DAY AS DATE) AS date FROM (SELECT jurisdiction, max(date) AS date FROM calendars WHERE jurisdiction < 'NATION_2' GROUP BY 1)""",
)
def calendar_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = V.calendars(spark, sf_dir)
    new = stored.where("jurisdiction < 'NATION_2'").groupBy("jurisdiction").agg(F.date_add(F.max("date"), 1).cast("string").alias("_d"))
    new = new.select("jurisdiction", F.explode(F.array(F.col("_d"), F.concat(F.lit(" "), "_d", F.lit(" ")), F.lit(" "), F.lit(""))).alias("date"))
    return C.replace_dates(stored, new)



@query(
    "users_written",
    """SELECT 'u' || user_id || '@x.ca' AS email, arg_max(event_type, event_id) AS riding, '' AS address FROM events WHERE user_id % 5 <> 0 GROUP BY 1""",
)
def users_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mail = F.when(F.col("user_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.when(F.col("event_id") % 2 == 0, " U").otherwise("u"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "@X.ca ").otherwise("@x.ca")))
    log = e.select(F.lower(F.trim(mail)).alias("email"), "event_id", F.col("event_type").alias("riding")).where("email <> ''")
    return G.latest(log, ["email"], [F.col("event_id")]).select("email", "riding", F.lit("").alias("address"))


@query("follows_written", "SELECT user_id, bill_id, min(event_id) AS event_id FROM toggles GROUP BY 1, 2")
def follows_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first(V.toggles(spark, sf_dir).select("user_id", "bill_id", "event_id"), ["user_id", "bill_id"], [F.col("event_id")])


@query("preferences_saved", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS categories FROM events WHERE event_type <> 'error' GROUP BY 1")
def preferences_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    said = F.trim(F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))))
    return e.select("user_id", said.alias("c")).where("c <> ''").groupBy("user_id").agg(F.array_sort(F.collect_set("c")).alias("categories"))


STEPS = ("view", "click", "purchase", "signup")


@query(
    "tutorial_progress",
    "SELECT u.user_id, s.step, coalesce(bool_or(e.event_type = s.step), false) AS done, bool_or(e.event_type = 'error') AS dismissed, count(DISTINCT e.event_type) FILTER (e.event_type <> 'error') AS n_done FROM (SELECT DISTINCT user_id FROM events) u JOIN events e ON e.user_id = u.user_id, (VALUES " + ", ".join(f"('{x}')" for x in STEPS) + ") s(step) GROUP BY 1, 2",
)
def tutorial_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.when(F.col("event_type") == "error", "dismissed").otherwise(F.col("event_type")).alias("activity"))
    done = G.insert_missing(log.limit(0), log, ["user_id", "activity"]).groupBy("user_id").agg(F.collect_set("activity").alias("a"))
    steps = F.explode(F.array(*[F.lit(x) for x in STEPS])).alias("step")
    return done.select("user_id", steps, "a").select("user_id", "step", F.array_contains("a", F.col("step")).alias("done"), F.array_contains("a", F.lit("dismissed")).alias("dismissed"), F.size(F.array_remove("a", "dismissed")).cast("long").alias("n_done"))


@query(
    "stale_removed",
    """SELECT v.division_id, count(*) AS votes FROM member_votes v WHERE NOT (v.division_id % 4 = 0 AND v.division_id % 3 = 1) GROUP BY 1""",
)
def stale_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    d = V.divisions(spark, sf_dir).select(F.concat(F.when(k % 4 == 0, "MB-43-").otherwise("on-43-"), k.cast("string")).alias("id"), k.alias("division_id"), F.when(k % 3 == 1, "https://x.ca/42nd/").when(k % 3 == 2, "https://x.ca/43RD/a").alias("sitting_url"))
    kept, _ = G.stale(d, "mb-43-", "/43rd/")
    return V.member_votes(spark, sf_dir).join(kept, "division_id", "left_semi").groupBy("division_id").agg(F.count("*").alias("votes"))


@query(
    "known_references",
    """SELECT d.id, CASE WHEN b.part % 2 = 0 THEN d.bill_id END AS bill_id, (SELECT count(*) FROM member_votes v WHERE v.division_id = d.id AND v.member_id % 2 = 0) AS votes FROM divisions d LEFT JOIN bills b ON b.id = d.bill_id""",
)
def known_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.bills(spark, sf_dir).where("part % 2 = 0").select("id")
    d = G.with_known(V.divisions(spark, sf_dir).select("id", "bill_id"), known, "bill_id")
    votes = G.with_known(V.member_votes(spark, sf_dir), V.members(spark, sf_dir).where("id % 2 = 0").select("id"), "member_id", strict=True)
    n = votes.groupBy(F.col("division_id").alias("id")).agg(F.count("*").alias("votes"))
    return d.join(n, "id", "left").select("id", "bill_id", F.coalesce("votes", F.lit(0).cast("long")).alias("votes"))


@query(
    "divisions_to_fetch",
    """SELECT id FROM divisions WHERE id % 3 = 0 OR id NOT IN (SELECT division_id FROM member_votes WHERE member_id % 2 = 0)""",
)
def divisions_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote ingest: detail is asked for where a division is new or has no votes yet."""
    d = V.divisions(spark, sf_dir).select("id")
    stored = d.where("id % 3 <> 0")
    voted = V.member_votes(spark, sf_dir).where("member_id % 2 = 0").select(F.col("division_id").alias("id"))
    return d.join(stored.join(voted, "id", "left_semi"), "id", "left_anti")


@query(
    "cooldown",
    """, recursive_input AS (SELECT user_id AS key, "at", event_id, row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS rn FROM attempts),
walk(key, rn, "at", event_id, start, ok) AS (
  SELECT key, rn, "at", event_id, "at", true FROM recursive_input WHERE rn = 1
  UNION ALL
  SELECT e.key, e.rn, e."at", e.event_id, CASE WHEN e."at" - w.start >= 43200000000 THEN e."at" ELSE w.start END, e."at" - w.start >= 43200000000
  FROM walk w JOIN recursive_input e ON e.key = w.key AND e.rn = w.rn + 1)
SELECT key, "at", event_id, ok FROM walk""",
)
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.allowed(V.attempts(spark, sf_dir).withColumnRenamed("user_id", "key"), 1, 43_200_000_000)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote indexes of ten divisions a page, as a table or, every third page, as a grid."""
    d = V.divisions(spark, sf_dir).select("id", "date", "bill_id", "description", "result")
    k, grid = F.col("id").cast("string"), F.floor(F.col("id") / 10) % 3 == 0
    day = F.when(F.col("id") % 2 == 0, F.date_format("date", "MMMM d, yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    link = F.concat(F.lit("<a class='n' href=\""), F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://x.ca/v/"), k)).otherwise(F.concat(F.lit("/v/"), k)), F.lit('">No. '), k, F.lit("</a>"))
    cells = [link, F.when(F.col("id") % 5 == 0, F.lit("<b>Bill</b> C-12")).otherwise(F.lit("Motion")), F.concat(F.lit("<span>"), F.coalesce("description", F.lit("")), F.lit(" &amp; more</span> of s-7")), F.concat((F.col("id") % 300).cast("string"), F.lit(" / "), (F.col("id") % 200).cast("string"), F.lit(" / "), (F.col("id") % 7).cast("string")), F.concat(F.lit("<i class=x></i> "), "result"), day]
    wrap = lambda a, b: F.concat(*[x for c in cells for x in (F.lit(a), c, F.lit(b))])
    row = F.when(grid, F.concat(F.lit('<div role="row">'), wrap('<div role="gridcell">', "</div>"), F.lit("</div>"))).otherwise(F.concat(F.lit("<tr class=r>"), wrap("<td>", "</td>"), F.lit("</tr>")))
    rows = spread(d.withColumn("page_id", F.floor(F.col("id") / 10)), "page_id").select("page_id", "id", row.alias("row"))
    body = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "row"))), lambda x: x["row"]), "\n").alias("b"), F.first("row").alias("again"))
    return body.select("page_id", F.concat(F.lit("<table><thead><tr><th>No.</th></tr></thead><tbody>"), "b", F.lit("<tr><td>1</td><td>too few</td></tr></tbody></table>")).alias("html"))


@query(
    "vote_index_pages",
    """SELECT id // 10 AS page_id, '44-1-' || id AS id, id::INT AS number, strftime(date, '%Y-%m-%d') AS date, CASE WHEN id % 5 = 0 THEN 'C-12' ELSE 'S-7' END AS bill_number,
       trim(coalesce(description, '') || ' & more of s-7') AS description, (id % 300)::INT AS yeas, (id % 200)::INT AS nays, (id % 7)::INT AS paired, result, CASE WHEN id % 4 = 0 THEN 'https://x.ca/v/' ELSE 'https://y.ca/v/' END || id AS detail_url FROM divisions""",
)
def vote_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vote_index(_pages(spark, sf_dir), 44, 1, "https://y.ca")


@query(
    "vote_detail_pages",
    "SELECT division_id, member_id::VARCHAR AS member_id, vote FROM member_votes WHERE member_id % 7 <> 0 AND member_id % 6 <> 0",
)
def vote_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = votes_by_division(spark, sf_dir), F.col("member_id").cast("string")
    href = F.when(F.col("member_id") % 7 == 0, F.lit("/people/x")).when(F.col("member_id") % 2 == 0, F.concat(F.lit("/members/en/ann-lee("), k, F.lit(")"))).otherwise(F.concat(F.lit("https://x.ca/Members/en/"), k))
    said = F.when(F.col("member_id") % 6 == 0, F.lit("—")).when(F.col("member_id") % 5 == 0, F.upper("vote")).otherwise(F.concat(F.lit(" <b>"), "vote", F.lit("</b> ")))
    row = F.concat(F.lit("<tr><td><a href='"), href, F.lit("'>A. Lee</a></td><td>Party</td><td>"), said, F.lit("</td><td></td></tr>"))
    return X.vote_detail(v.select("division_id", row.alias("row")).groupBy("division_id").agg(F.concat(F.lit("<table class='votes'><tbody>"), F.array_join(F.collect_list("row"), ""), F.lit("</tbody></table>")).alias("html")))


@query(
    "bill_list_pages",
    """SELECT part // 8 AS page_id, 'on-43-1-' || CASE part % 4 WHEN 1 THEN part || 'a' ELSE part::VARCHAR END AS id, CASE part % 4 WHEN 1 THEN part || 'A' ELSE part::VARCHAR END AS number,
       CASE part % 4 WHEN 2 THEN 'Bill ' || part WHEN 3 THEN 'An Act' ELSE 'An Act of ' || part END AS title, '/bills/' || part AS href, CASE WHEN part % 2 = 0 THEN strftime(introduced_date, '%Y-%m-%d') ELSE '' END AS date FROM bills""",
)
def bill_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = V.bills(spark, sf_dir), F.col("part").cast("string")
    said = F.when(F.col("part") % 4 == 0, F.concat(F.lit("Bill "), k, F.lit(": An Act of "), k)).when(F.col("part") % 4 == 1, F.concat(F.lit("Bill No. "), k, F.lit("a - An Act of "), k)).when(F.col("part") % 4 == 2, F.concat(F.lit("<b>Bill "), k, F.lit("</b>"))).otherwise(F.lit("An Act"))
    day = F.when(F.col("part") % 2 == 0, F.concat(F.lit(" <em>Introduced "), F.date_format("introduced_date", "MMMM d, yyyy"), F.lit("</em>"))).otherwise(F.lit(" soon"))
    item = F.concat(F.lit("<li><a href='/bills/"), k, F.lit("'>"), said, F.lit("</a>"), day, F.when(F.col("part") % 3 == 0, F.lit("</li>")).otherwise(F.lit("\n")))
    page = b.select(F.floor(F.col("part") / 8).alias("page_id"), item.alias("item")).groupBy("page_id").agg(F.concat(F.lit("<ul><li><a href='/about'>About</a></li>"), F.array_join(F.collect_list("item"), ""), F.lit("</ul>")).alias("html"))
    return X.bill_links(page, "on", 43, 1)


@query(
    "vote_report_texts",
    """, counted AS (SELECT id, id // 4 AS text_id, 1 + (id % 90)::INT AS yeas, (id % 70)::INT AS nays FROM divisions)
SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY id)::INT AS number, yeas, nays, CASE WHEN nays > yeas THEN 'Negatived' ELSE 'Carried' END AS result,
       ['Smith', 'O''Neil', 'Lee-' || chr((65 + id % 26)::INT) || 'x'] AS yea_names, CASE WHEN nays = 0 THEN [] ELSE ['Jones', 'Côté'] END AS nay_names FROM counted""",
)
def vote_report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.divisions(spark, sf_dir).select("id", F.floor(F.col("id") / 4).alias("text_id"))
    section = F.concat(
        F.when(F.col("id") % 2 == 0, "YEAS: ").otherwise("Yeas - "), (1 + F.col("id") % 90).cast("string"), F.lit("\nMr. Smith, Ms. O'Neil; Hon. Lee-"), F.char((65 + F.col("id") % 26).cast("int")), F.lit("x and smith (Smith)\n"),
        F.when(F.col("id") % 2 == 0, "NAYS: ").otherwise("Nays – "), (F.col("id") % 70).cast("string"), F.when(F.col("id") % 70 == 0, "\n").otherwise("\nJones, Côté. Jones\n"),
    )
    texts = d.select("text_id", F.struct("id", section.alias("s")).alias("x")).groupBy("text_id").agg(F.concat(F.lit("the house divided on the motion.\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "carried.\n")).alias("text"))
    return X.vote_counts(texts)


ORACLES["cooldown"] = ORACLES["cooldown"].replace("WITH ", "WITH RECURSIVE ", 1)
