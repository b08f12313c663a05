"""Queries of upper-house pages, link discovery, page detectors and login sessions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import checks as K
from ..operators import extract as X
from .catalog import query, spread, votes_by_division


def _pick(key, *xs: str):
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (key % len(xs) + 1).cast("int"))


@query(
    "upper_index_pages",
    """SELECT id // 10 AS page_id, 'senate-44-1-' || id AS id, id::INT AS number, strftime(date, '%Y-%m-%d') AS date, CASE WHEN id % 5 = 0 THEN 'S-209' ELSE '' END AS bill_number,
       trim('Motion ' || id || ' & ' || coalesce(description, '')) AS description, CASE WHEN id % 7 = 0 THEN 0 ELSE (id % 90)::INT END AS yeas, (id % 70)::INT AS nays, result,
       CASE WHEN id % 3 = 0 THEN '' WHEN id % 4 = 0 THEN 'https://x.ca/v/' || id ELSE 'https://y.ca/v/' || id END AS detail_url FROM divisions WHERE id % 11 <> 0""",
)
def upper_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh row lacks its number; every third has a link without the title's class."""
    d = V.divisions(spark, sf_dir).select("id", "date", "description", "result")
    i, k = F.col("id"), F.col("id").cast("string")
    order = F.when(i % 11 == 0, F.lit("x")).otherwise(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00 "), k))
    href = F.concat(F.when(i % 4 == 0, "https://x.ca/v/").otherwise("/v/"), k)
    tag = F.when(i % 3 == 0, F.lit("<a ")).when(i % 2 == 0, F.lit("<a class='b vote-web-title-link' ")).otherwise(F.lit('<a class="vote-web-title-link" '))
    counts = F.concat(F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("Yeas: "), (i % 90).cast("string"))), F.lit(" | Nays:\n"), (i % 70).cast("string"), F.lit(" | Total: 99"))
    row = F.concat(
        F.lit('<tr><td class="d" data-order="'), order, F.lit('">\n'), F.date_format("date", "yyyy-MM-dd"), F.lit("</td><td>"), tag, F.lit('href="'), href, F.lit('">Motion '), k, F.lit(" &amp; "), F.coalesce("description", F.lit("")), F.lit("</a><p>"), counts,
        F.lit("</p></td><td>"), F.when(i % 5 == 0, "<a href='/b'>s-\n 209</a>").otherwise("—"), F.lit("</td><td> "), "result", F.lit(" </td></tr>"),
    )
    page = spread(d.withColumn("page_id", F.floor(i / 10)), "page_id").select("page_id", row.alias("row")).groupBy("page_id").agg(F.array_join(F.collect_list("row"), "\n").alias("b"))
    other = F.lit("</tbody></table><table><tr><td data-order='1 2'>2000-01-01</td><td>a</td><td></td><td>b</td></tr></table>")
    return X.upper_house_index(page.select("page_id", F.concat(F.lit("<table><thead><tr><th>Date</th></tr></thead><tbody><tr><td data-order='3'>few</td></tr>"), "b", other).alias("html")), 44, 1, "https://y.ca")


@query(
    "upper_detail_pages",
    """SELECT division_id, member_id::VARCHAR AS member_id, CASE vote WHEN 'Paired' THEN 'Abstain' ELSE vote END AS vote FROM member_votes WHERE member_id % 7 <> 0 AND (division_id % 4 = 3 OR member_id % 6 <> 0)""",
)
def upper_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of four hold the table, the others lists; rows with a foreign link or no mark are no votes."""
    v = votes_by_division(spark, sf_dir)
    m, k = F.col("member_id"), F.col("member_id").cast("string")
    href = F.when(m % 7 == 0, F.lit("/people/x")).when(m % 2 == 0, F.concat(F.lit("/en/in-the-chamber/votes/senator/"), k, F.lit("/44-1"))).otherwise(F.concat(F.lit("/Members/en/ann-lee("), k, F.lit(")")))
    link = F.concat(F.lit("<a href='"), href, F.lit("'>Lee, Ann</a>"))
    mark = lambda vote: F.when((F.col("vote") == vote) & (m % 6 != 0), _pick(m, '<td data-order="aaa"></td>', "<td><i class='fa fa-times'></i></td>", "<td> × </td>", "<td>X</td>")).otherwise('<td data-order="zzz"><i class="fa-times-x"></i></td>')
    row = F.concat(F.lit("<tr><td>"), link, F.lit("</td><td>ISG</td><td>X</td>"), mark("Yea"), mark("Nay"), mark("Paired"), F.lit("</tr>"))
    item = F.concat(F.lit("<li>"), link, F.lit("</li>"))
    lists = lambda vote, head: F.concat(F.lit(head), F.array_join(F.collect_list(F.when(F.col("vote") == vote, item)), "\n"), F.lit("</ul>"))
    table = F.concat(F.lit('<table class="t" id="sc-vote-details-table"><tbody>'), F.array_join(F.collect_list(row), "\n"), F.lit("<tr><td><a href='/Members/en/1'>x</a></td><td>X</td></tr></tbody></table>"))
    old = F.concat(lists("Yea", "<ul class='a vote-yea'>"), lists("Nay", '<ul class="nay">'), lists("Paired", "<ul class='listAbstainers'>"))
    return X.upper_house_detail(v.groupBy("division_id").agg(table.alias("t"), old.alias("o")).select("division_id", F.when(F.col("division_id") % 4 == 3, F.col("o")).otherwise(F.col("t")).alias("html")))


@query(
    "vote_link_pages",
    """, links AS (SELECT DISTINCT part // 100 AS page_id, CASE part % 8 WHEN 0 THEN 'https://x.ca/votes/' || part WHEN 1 THEN 'https://z.ca/votes/' || part WHEN 2 THEN 'https://x.ca/a/b/v' || part || '?d=1#t' WHEN 3 THEN 'https://x.ca/a/v' || part
         WHEN 4 THEN 'https://x.ca/a/b/c?vote=' || part WHEN 5 THEN 'http://w.ca/votes' WHEN 6 THEN 'https://x.ca/a/b/c?q=1#votes' || part END AS link FROM bills)
SELECT page_id, link FROM links WHERE link IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY link DESC) <= 40""",
)
def vote_link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = V.bills(spark, sf_dir), F.col("part").cast("string")
    hrefs = [("/votes/", ""), ("//z.ca/votes/", ""), ("./v", "?d=1#t"), ("x/../../v", ""), ("?vote=", ""), ("http://w.ca/votes", None), ("#votes", ""), ("/bills/", "")]
    href = F.element_at(F.array(*[F.lit(a) if z is None else F.concat(F.lit(a), k, F.lit(z)) for a, z in hrefs]), (F.col("part") % 8 + 1).cast("int"))
    said = F.when(F.col("part") % 8 == 7, "About").otherwise("<b>Votes</b> of the day")
    anchor = F.concat(F.lit('<a class="l" href="'), href, F.lit('">'), said, F.lit("</a>"))
    page = b.select(F.floor(F.col("part") / 100).alias("page_id"), anchor.alias("a")).groupBy("page_id").agg(F.concat(F.lit("<p><a name='votes'>Votes</a>"), F.array_join(F.collect_list("a"), "\n"), F.lit("</p>")).alias("html"))
    return X.vote_links(page.withColumn("url", F.lit("https://x.ca/a/b/c?q=1#s")), r"(?i)\bvotes?\b")


@query(
    "fetch_rules",
    """SELECT part, part % 4 >= 2 AS retry, part % 3 < 2 AS outcome, part % 3 <> 2 OR part % 5 = 0 AS within, part % 5 = 0 AND part % 4 = 3 AS expired, part % 6 = 0 AS robots, part % 2 = 0 AS chosen,
       CASE WHEN part % 3 = 0 AND part % 4 > 1 THEN range(part % 4, 0, -1) ELSE [part % 4] END AS sessions FROM bills""",
)
def fetch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, p = V.bills(spark, sf_dir), F.col("part")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 429, 500)]), (p % 4 + 1).cast("int"))
    said = _pick(p, "Carried on\n the following division:", " LOST on the following  division", "Carried on division")
    within = F.when((p % 3 != 2), F.concat(F.lit("The motion was "), said)).when(p % 5 == 0, "Yes, ON the\tfollowing division.").otherwise(said)
    url = F.when(p % 5 == 0, "https://Docs.assembly.pe.ca/Download/dms?id=1").when(p % 5 == 1, "https://docs.assembly.pe.ca/x?y=/download/dms").otherwise("https://docs.assembly.pe.ca.x/download/dms")
    return b.select(
        "part", K.retryable(status).alias("retry"), K.outcome_line(said).alias("outcome"), K.outcome_within(within).alias("within"), K.link_expired(url, status, F.lit("Error retrieving file: this Link is expired.")).alias("expired"),
        K.any_sign(_pick(p, "<b>Robot-Check</b>", "", "a", "robot", "b", "check"), ("robot-check", "captcha")).alias("robots"), K.valid_choice(_pick(p, "", "c", "a", "B"), F.array(F.lit("a"), F.lit("b"))).alias("chosen"),
        F.transform(K.sessions_to_read((p % 4).cast("int"), p % 3 == 0), lambda x: x.cast("long")).alias("sessions"),
    )


@query(
    "reaction_rings",
    """, n AS (SELECT bill_id, count(*) FILTER (reaction = 'support') AS s, count(*) FILTER (reaction = 'oppose') AS o, count(*) FILTER (reaction = 'neutral') AS u FROM reactions WHERE bill_id IS NOT NULL GROUP BY 1)
SELECT bill_id, 0 AS arc, round(s / (s + o + u) * (80 * pi()), 2) AS length, -90.0::DOUBLE AS turn FROM n UNION ALL
SELECT bill_id, 1, round(o / (s + o + u) * (80 * pi()), 2), round(s / (s + o + u) * 360 - 90, 4) FROM n UNION ALL
SELECT bill_id, 2, round(u / (s + o + u) * (80 * pi()), 2), round((s + o) / (s + o + u) * 360 - 90, 4) FROM n""",
)
def reaction_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.reactions(spark, sf_dir).where("bill_id is not null").groupBy("bill_id").agg(*[F.count_if(F.col("reaction") == x).alias(x) for x in ("support", "oppose", "neutral")])
    return n.select("bill_id", F.posexplode(K.donut([F.col(x) for x in ("support", "oppose", "neutral")])).alias("arc", "x")).select("bill_id", "arc", "x.length", "x.turn")


@query(
    "session_users",
    """, edge AS (SELECT min("at") + (max("at") - min("at")) // 2 AS now FROM attempts) SELECT event_id, user_id FROM attempts, edge WHERE event_id % 2 = 0 AND "at" + 3600000000 >= now""",
)
def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of presented tokens: sessions are stored by the token's hash and hold up to their end. Every other token shown is unknown."""
    a = V.attempts(spark, sf_dir)
    token = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    stored = a.select(F.sha2(token, 256).alias("id"), "user_id", (F.col("at") + 3_600_000_000).alias("ends"))
    shown = F.when(F.col("event_id") % 2 == 0, token).otherwise(F.concat(F.lit("x"), token))
    asked = a.select("event_id", F.sha2(shown, 256).alias("id"))
    edge = a.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select(F.expr("lo + (hi - lo) div 2").alias("now"))
    return asked.join(stored, "id").join(F.broadcast(edge), F.col("ends") >= F.col("now")).select("event_id", "user_id")
