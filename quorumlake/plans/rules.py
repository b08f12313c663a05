"""Queries of the scalar rules: inputs are written from the tables in several forms, and SQL knows what went in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..functions import dates as D
from ..functions import ids as I
from ..functions import places as P
from ..functions import text as T
from ..operators import bills as B
from ..operators import members as M
from ..operators.resolve import resolve
from .catalog import AS_OF, query


def _forms(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """part and texts by SQL expressions over k, the part key as text."""
    keyed = V.bills(spark, sf_dir).select("part", F.col("part").cast("string").alias("k"))
    return keyed.select("part", "k", *[F.expr(e).alias(c) for c, e in columns.items()])


@query(
    "ids_of_links",
    r"""SELECT part, CASE WHEN part % 5 = 0 THEN '' ELSE '44-1-c-' || part END AS bill,
       CASE WHEN part % 7 = 0 THEN '' ELSE part::VARCHAR END AS member,
       CASE part % 3 WHEN 0 THEN '/a/' || part WHEN 1 THEN 'https://x.ca/' || part ELSE '/y' END AS href,
       CASE part % 4 WHEN 0 THEN 'jo ' || part WHEN 1 THEN part::VARCHAR WHEN 2 THEN '' ELSE 'a' || part END AS segment,
       'https://x.ca/p' || part AS log_url,
       CASE part % 4 WHEN 0 THEN 'https://x.ca/' || part WHEN 1 THEN '#' WHEN 2 THEN 'http://y.ca' ELSE '#' END AS safe_url,
       CASE part % 5 WHEN 0 THEN 'mailto:m' || part || '@x.ca' ELSE '#' END AS mailto,
       CASE part % 4 WHEN 0 THEN 'set-jo-' || part WHEN 1 THEN 'set-ann-lee' || part WHEN 2 THEN 'set-ann-lee' || part ELSE '' END AS set_member,
       CASE part % 4 WHEN 0 THEN 'on-historical-j-oneil-' || chr((97 + part % 26)::INT) WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'on-historical-a-b' END AS provisional
FROM bills""",
)
def ids_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _forms(
        spark, sf_dir,
        bill="if(part % 5 = 0, concat('https://x.ca/bills/', k), concat('https://x.ca/LegisInfo/en/bill/44-1/', if(part % 2 = 0, 'C-', 'c-'), k, if(part % 3 = 0, '?view=a', '')))",
        member="if(part % 7 = 0, concat('/people/', k), concat('https://x.ca/Members/en/', if(part % 2 = 0, concat('ann-o-lee(', k, ')'), k), if(part % 3 = 0, '/votes', '')))",
        href="element_at(array(concat('\\\\a\\\\', k), concat('//x.ca/', k), ' /y '), int(part % 3 + 1))",
        segment="element_at(array(concat('https://x.ca/mps/jo%20', k, '/index.html?x=1'), concat('https://x.ca/mps/', k, '/'), '', concat('/b/a', k, '#t')), int(part % 4 + 1))",
        log="concat('https://x.ca/p', k, if(part % 2 = 0, '?token=1#x', '#y'))",
        url="element_at(array(concat(' https://x.ca/', k), 'javascript:alert(1)', 'http://y.ca', 'ftp://x.ca'), int(part % 4 + 1))",
        mail="element_at(array(concat('m', k, '@x.ca'), 'a@b', 'a b@x.ca', 'a@b@x.ca', '@x.ca'), int(part % 5 + 1))",
        page="element_at(array(concat('https://x.ca/jo-', k), 'https://x.ca/member-details?first=a', '', ''), int(part % 4 + 1))",
        name="if(part % 4 = 3, '', concat('Ann Lee', k))",
        said="element_at(array(concat('J. O''Neil ', char(int(97 + part % 26))), 'MR SMITH', 'John 12', ' A-b '), int(part % 4 + 1))",
    )
    c = F.col
    return t.select(
        "part", I.bill_id_from_url(c("bill")).alias("bill"), I.member_id_from_url(c("member")).alias("member"), I.clean_href(c("href")).alias("href"), I.last_segment(c("segment")).alias("segment"),
        I.log_url(c("log")).alias("log_url"), I.safe_url(c("url")).alias("safe_url"), I.safe_mailto(c("mail")).alias("mailto"), I.member_id_of_set(F.lit("set"), c("page"), c("name")).alias("set_member"),
        I.provisional_member_id(F.lit("on"), c("said")).alias("provisional"),
    )


@query(
    "ids_of_parts",
    r"""SELECT part, '44-2-' || part AS division, CASE WHEN part % 4 = 0 THEN '' ELSE '44-2-c-' || part END AS bill,
       CASE part % 3 WHEN 0 THEN '' WHEN 1 THEN 'C-' || part ELSE 'S-' || part END AS in_text,
       CASE WHEN part % 3 = 2 THEN 'senate' ELSE 'commons' END AS chamber,
       CASE part % 5 WHEN 0 THEN part || 'A' WHEN 1 THEN part::VARCHAR WHEN 2 THEN part::VARCHAR WHEN 3 THEN 'C-' || part ELSE '' END AS provincial_number,
       CASE WHEN part % 4 = 0 THEN '' ELSE 'on-43-1-pr' || part || '-a-b' END AS provincial_bill,
       'on-43-1-2024-05-06-' || part AS provincial_division, sha256(part::VARCHAR) AS token_hash, sha256(part::VARCHAR) AS code_hash
FROM bills""",
)
def ids_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _forms(
        spark, sf_dir,
        number="if(part % 4 = 0, '  ', concat(' C-', k, ' '))",
        said="element_at(array('An Act of 2024', concat('An Act (bill c-', k, ') and S-1'), concat('S-', k, ', an Act')), int(part % 3 + 1))",
        local="element_at(array(concat('Bill No. ', k, 'a, amended'), concat('see bill ', k), concat('BILL (No. ', k, ')'), concat('on c-', k, ' alone'), 'Billing 12'), int(part % 5 + 1))",
        own="if(part % 4 = 0, ' ', concat(' Pr ', k, '/A–b '))",
    )
    c = F.col
    return t.select(
        "part", I.division_id(F.lit(44), F.lit(2), c("part")).alias("division"), I.bill_id(F.lit(44), F.lit(2), c("number")).alias("bill"), I.bill_number(c("said")).alias("in_text"),
        I.chamber_of_number(F.when(c("part") % 3 == 2, F.concat(F.lit("s-"), "k")).otherwise(F.concat(F.lit("C-"), "k"))).alias("chamber"), I.provincial_bill_number(c("local")).alias("provincial_number"),
        I.provincial_bill_id(F.lit("on"), F.lit(43), F.lit(1), c("own")).alias("provincial_bill"), I.provincial_division_id(F.lit("on"), F.lit(43), F.lit(1), F.lit("2024-05-06"), c("part")).alias("provincial_division"),
        F.sha2("k", 256).alias("token_hash"), F.sha2(F.trim(F.concat(F.lit(" "), "k", F.lit(" "))), 256).alias("code_hash"),
    )


@query(
    "name_rules",
    r"""SELECT part, 'ann marie oneil' || part || ' lee' AS normal, CASE WHEN part % 2 = 0 THEN 'Ann Lee' || part ELSE 'Ann Lee' END AS turned, 'Eleonore Cote' || part AS folded,
       'helene-d-arcy-jp-' || part AS slug, (2 + length(part::VARCHAR))::INT AS prefix, part % 4 = 0 AS person, 'Lee' || part AS token,
       part || CASE WHEN part % 100 IN (11, 12, 13) THEN 'th' WHEN part % 10 = 1 THEN 'st' WHEN part % 10 = 2 THEN 'nd' WHEN part % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
       CASE WHEN length(title) > 12 THEN title[:12] || '…' ELSE title END AS shortened, CASE WHEN part % 5 = 0 THEN '?' ELSE coalesce(title[1], '?') END AS initial,
       CASE part % 6 WHEN 0 THEN 'Yea' WHEN 1 THEN 'Nay' WHEN 2 THEN 'Paired' WHEN 3 THEN 'Yea' WHEN 4 THEN 'Nay' ELSE 'Abstain' END AS vote,
       CASE WHEN part % 3 = 0 THEN 'abcd' || '~' || 'yz' ELSE 'abcdyz' END AS cut, coalesce(nullif(short_title, ''), title, '') AS shown
FROM bills""",
)
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.bills(spark, sf_dir).withColumn("k", F.col("part").cast("string"))
    t = t.withColumns({
        "name": F.expr("concat(' Hon. Ann-Marie O''Neil', k, ' (Lee), K.C. ')"),
        "last_first": F.expr("if(part % 2 = 0, concat('Lee', k, ', Ann'), 'Ann Lee')"),
        "accents": F.expr("concat('Éléonore Côté', k)"),
        "french": F.expr("concat(' Hélène  D''Arcy_J.P. -', k, '! ')"),
        "said": F.expr("element_at(array('Ann Lee', 'ANN LEE', 'Ann 12', '1Ann'), int(part % 4 + 1))"),
        "mark": F.expr("concat('(\"Lee', k, ').,')"),
        "raw": F.expr("element_at(array(' OUI ', 'Contre', 'apparié', 'Yes', 'NO', 'x'), int(part % 6 + 1))"),
        "long": F.expr("if(part % 3 = 0, 'abcdefgyz', 'abcdyz')"),
    })
    c = F.col
    return t.select(
        "part", T.normal_name(c("name")).alias("normal"), T.last_first(c("last_first")).alias("turned"), T.folded(c("accents")).alias("folded"), T.slug(c("french")).alias("slug"),
        T.common_prefix(F.concat(F.lit("ab"), "k", F.lit("x")), F.concat(F.lit("ab"), "k", F.lit("yy"))).alias("prefix"), T.person_name(c("said")).alias("person"), T.vote_token(c("mark")).alias("token"),
        T.ordinal(c("part")).alias("ordinal"), T.shortened(c("title"), 12).alias("shortened"), T.initial(F.when(c("part") % 5 == 0, F.lit("")).otherwise(c("title"))).alias("initial"), T.vote(c("raw")).alias("vote"),
        T.head_and_tail(c("long"), 8, 4, 2, "~").alias("cut"), T.first_title(c("short_title"), c("title")).alias("shown"),
    )


_LONG = "strftime(day, '%Y-%m-%d')"


@query(
    "date_rules",
    rf"""SELECT part, CASE WHEN part % 6 = 5 THEN '' ELSE {_LONG} END AS parsed, CASE WHEN part % 4 = 3 THEN '' ELSE {_LONG} END AS in_text,
       CASE WHEN part % 4 = 3 THEN '' ELSE {_LONG} END AS in_url, CASE WHEN part % 3 = 2 THEN '' ELSE {_LONG} END AS canonical,
       CASE WHEN part % 2 = 0 THEN strftime(day, '%b %-d, %Y') ELSE 'soon' END AS shown, CASE WHEN part % 5 = 0 THEN NULL ELSE make_date(2024, month(day), least(day(day), 28)) END AS month_day,
       month(day) AS french_month, '20' || strftime(day, '%y-%m-%d') AS slug_day, '20' || strftime(day, '%y-%m-%d') AS short_day,
       CASE WHEN part % 3 = 2 THEN '{AS_OF}' ELSE {_LONG} END AS of_document,
       2000 + part % 20 AS first_year, CASE part % 3 WHEN 0 THEN 9999 WHEN 1 THEN 2021 + part % 20 ELSE 2000 + part % 20 END AS last_year,
       CAST(date_trunc('week', day) AS DATE) AS monday,
       CAST((SELECT min(d) FROM range(make_date(1990 + (part % 40)::INT, 2, 1), make_date(1990 + (part % 40)::INT, 2, 8), INTERVAL 1 DAY) r(d) WHERE dayofweek(d) = 2) + INTERVAL 21 DAY AS DATE) AS opening,
       CAST((SELECT min(d) FROM range(make_date(1990 + (part % 40)::INT, 11, 1), make_date(1990 + (part % 40)::INT, 11, 8), INTERVAL 1 DAY) r(d) WHERE dayofweek(d) = 2) AS DATE) AS resumption,
       CASE WHEN abs(part % 3) = 0 THEN ['1997-12-24', '1998-07-01'] ELSE ['1998-07-01'] END AS near
FROM (SELECT part, introduced_date AS day FROM bills)""",
)
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.bills(spark, sf_dir).select("part", F.col("introduced_date").alias("day"))
    form = lambda layout: F.date_format("day", layout)
    pick = lambda n, *xs: F.element_at(F.array(*xs), (F.col("part") % n + 1).cast("int"))
    lit, c = F.lit, F.col
    iso = form("yyyy-MM-dd")
    layouts = pick(6, iso, form("MMMM d, yyyy"), form("d MMMM yyyy"), form("MMM d, yyyy"), form("yyyy/MM/dd"), lit("Monday next"))
    said = pick(4, F.concat(lit("Sat on "), iso, lit(" and 2001-01-01")), F.concat(lit("The House met "), form("MMMM d, yyyy"), lit(".")), F.concat(lit("le "), form("d MMMM yyyy"), lit(" (suite)")), lit("no day 12, 1999"))
    url = pick(4, F.concat(lit("/votes/"), iso, lit("/1")), F.concat(lit("/x"), form("yyyyMMdd"), lit(".pdf")), F.concat(lit("/"), form("yyyyMMdd"), lit("-extra/2000-01-01")), lit("/18231301/x"))
    stamp = pick(3, F.concat(iso, lit("T10:00:00Z")), F.concat(lit(" "), iso, lit(" ")), lit("n/a"))
    text, link = F.when(c("part") % 3 == 0, said).otherwise(lit("nothing")), F.when(c("part") % 3 == 1, F.concat(lit("/d/"), iso)).otherwise(lit("/d/"))
    text = F.when(c("part") % 3 == 0, F.concat(lit("on "), iso)).otherwise(text)
    french = F.element_at(F.array(*[lit(x) for x in ("Janvier", "février", "MARS", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")]), F.month("day"))
    years = F.concat((2000 + c("part") % 20).cast("string"), pick(3, lit("-present"), F.concat(lit(" – "), (2021 + c("part") % 20).cast("string")), lit("")))
    span = D.year_range(years)
    calendar = F.concat(lit("Sits July 1, 1998; not 1996-01-01 or 2 May 1999"), F.when(c("part") % 3 == 0, lit(", 24 December 1997, 1998-07-01")).otherwise(lit("")))
    year = (1990 + c("part") % 40).cast("int")
    return t.select(
        "part", D.parse(layouts).alias("parsed"), D.in_text(said).alias("in_text"), D.in_url(url, 2030).alias("in_url"), D.canonical(stamp).alias("canonical"), D.shown(F.when(c("part") % 2 == 0, iso).otherwise(lit("soon"))).alias("shown"),
        D.month_day(F.when(c("part") % 5 == 0, lit("Nowhere")).otherwise(F.concat(lit(" "), form("MMMM"))), F.least(F.dayofmonth("day"), lit(28)).cast("string"), lit(2024)).alias("month_day"), D.french_month(french).cast("long").alias("french_month"),
        D.in_slug(F.concat(lit("/hansard/house_"), form("yy"), F.lower(form("MMM")), form("dd"), lit("/"))).alias("slug_day"), D.short(form("yy-MM-dd")).alias("short_day"), D.of_document(text, link, lit(AS_OF), 2030).alias("of_document"),
        span["first"].cast("long").alias("first_year"), span["last"].cast("long").alias("last_year"), D.monday(c("day")).alias("monday"), D.nth_weekday(year, 2, "TU", 4).alias("opening"), D.nth_weekday(year, 11, "TU", 1).alias("resumption"),
        D.near(calendar, lit(AS_OF).cast("date")).alias("near"),
    )


# People come in pairs of one surname and province, whose terms don't overlap.
_LETTERS = "abdefgilmo"
_KINDS = (
    ("Hon. {first} {mid} {last}", 3), ("{mid} {last}", 4), ("{initial}. {last}", 5), ("{last}", 6), ("{last}xx", 7), ("{first} {last}xx", 8), ("Other {last}xx", 9), ("{last} (Elsewhere)", 1), ("{last} (Riding {id})", 2), ("Nobody Unknown", None),
)


@query(
    "resolved_names",
    "SELECT s_suppkey * 10 + kind AS name_id, CASE WHEN kind < 9 THEN s_suppkey END AS member_id, CASE kind " + " ".join(f"WHEN {k} THEN {r if r else 'NULL'}" for k, (_, r) in enumerate(_KINDS)) + " END AS rule FROM supplier, range(10) r(kind)",
)
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = V.members(spark, sf_dir).select("id")
    pair = F.floor(F.col("id") / 2)
    spelled = lambda n, a: F.translate(F.reverse(F.lpad(n.cast("string"), 9, "0")), "0123456789", a)
    even = F.col("id") % 2 == 0
    who = who.select(
        "id", F.initcap(spelled(pair, _LETTERS)).alias("last"), F.concat(F.lit("Q"), spelled(F.col("id"), "qrstuvwxyz")).alias("mid"), F.concat(F.when(even, "J").otherwise("P"), spelled(F.col("id"), "cehijknuvw")).alias("first"),
        F.element_at(F.array(*[F.lit(x) for x in ("Ontario", "Quebec", "Alberta")]), (pair % 3 + 1).cast("int")).alias("province"), F.concat(F.lit("Riding "), F.col("id").cast("string")).alias("riding"),
        F.when(~even, F.lit("2000-01-01").cast("date")).alias("term_start"), F.when(even, F.lit("1999-12-31").cast("date")).alias("term_end"),
    )
    day = F.when(even, F.lit("1998-06-01")).otherwise(F.lit("2004-06-01")).cast("date")

    def asked(k: int, form: str) -> DataFrame:
        parts = {"first": F.col("first"), "mid": F.col("mid"), "last": F.col("last"), "initial": F.left("first", F.lit(1)), "id": F.col("id").cast("string")}
        pieces = [parts[x[1:-1]] if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", form) if x]
        return who.select((F.col("id") * 10 + k).alias("name_id"), F.concat(*pieces).alias("name"), F.upper("province").alias("province"), F.when(F.lit(k != 8), day).alias("date"))

    names = asked(0, _KINDS[0][0])
    for k, (form, _) in enumerate(_KINDS[1:], 1):
        names = names.unionByName(asked(k, form))
    people = who.select("id", F.concat_ws(" ", "first", "mid", "last").alias("name"), "riding", "province", "term_start", "term_end")
    return resolve(names, people)


@query(
    "summary_rules",
    r"""SELECT part, part % 5 <> 4 AS found, CASE WHEN part % 5 = 4 THEN NULL ELSE title END AS one_sentence, CASE WHEN part % 5 = 4 THEN NULL ELSE part % 3 END AS changes,
       part % 5 <> 3 AS has_summary,
       CASE part % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE introduced_date > DATE '1998-06-01' END AS needs
FROM bills""",
)
def summary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, lit, c = V.bills(spark, sf_dir), F.lit, F.col
    body = F.to_json(F.struct(F.col("title").alias("one_sentence"), F.array_repeat(F.lit("x"), (c("part") % 3).cast("int")).alias("key_changes")))
    pick = lambda n, *xs: F.element_at(F.array(*xs), (c("part") % n + 1).cast("int"))
    reply = pick(5, body, F.concat(lit("```json\n"), body, lit("\n```")), F.concat(lit("Here it is: "), body, lit(" Good?")), F.concat(lit(" "), body, lit(" ")), lit("{no json"))
    found = T.json_object(reply)
    read = T.summary(found)
    at = lambda x: F.concat(lit('{"generated_at": "'), x, lit('"}'))
    summary = pick(7, lit(" "), lit("not json"), lit("{}"), at(lit("1998-06-01T00:00:00Z")), at(lit("1998-06-01T00:00:00Z")), at(lit("1998-06-01T00:00:00Z")), at(lit("1998-06-01T00:00:00Z")))
    day = F.date_format("introduced_date", "yyyy-MM-dd")
    incoming = pick(7, day, day, day, lit(" "), lit("some day"), day, lit(""))
    stored = pick(7, day, day, day, lit(""), day, lit("1900-01-01"), day)
    return b.select("part", found.isNotNull().alias("found"), read["one_sentence"].alias("one_sentence"), F.when(found.isNotNull(), F.size(read["key_changes"]).cast("long")).alias("changes"), (F.trim(F.when(c("part") % 5 == 3, lit("  ")).otherwise(lit("x"))) != "").alias("has_summary"), B.needs_summary(b, incoming, stored, summary).alias("needs"))


@query(
    "place_rules",
    """SELECT id, CASE id % 4 WHEN 0 THEN 'Ontario' WHEN 1 THEN 'Prince Edward Island' WHEN 2 THEN 'Québec' ELSE 'Yukon' END AS expanded,
       CASE id % 4 WHEN 0 THEN 'provincial-ON' WHEN 1 THEN 'provincial-PE' WHEN 2 THEN 'provincial-QC' ELSE 'provincial-YT' END AS jurisdiction,
       id % 4 = 0 AS local, id % 4 <> 0 AS federal, id % 5 < 3 AS office,
       CASE chamber WHEN 'ontario' THEN 'Ontario' WHEN 'senate' THEN 'Senate' ELSE 'House of Commons' END AS chamber_label,
       CASE id % 3 WHEN 0 THEN 'in session' WHEN 1 THEN 'on break' ELSE 'status unavailable' END AS status_text FROM members""",
)
def place_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, c = V.members(spark, sf_dir), F.col
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c("id") % len(xs) + 1).cast("int"))
    said = pick(" on ", "pei", "Québec", "yt")
    return m.select(
        "id", P.expand_province(said).alias("expanded"), P.jurisdiction_key(said).alias("jurisdiction"), M.at_level("provincial").alias("local"), M.at_level("federal").alias("federal"),
        M.provincial_office(pick("MPP (Toronto)", " Member of the Legislative Assembly for X", "mna", "MP", "Senator")).alias("office"), P.chamber_label(c("chamber")).alias("chamber_label"), P.status_text(pick("in_session", " on_break ", "x")).alias("status_text"),
    )


@query(
    "page_rules",
    """SELECT part, pages, has_prev, has_next, stage_index::BIGINT AS stage_index, reached, greatest(0, least(part % 9, part % 7)) AS smaller, total * 100 // greatest(part % 11, 1) AS pct,
       CASE WHEN pages <= 5 THEN range(1, pages + 1) WHEN now <= 2 THEN [1, 2, 3, 4, -1, pages] WHEN now >= pages - 1 THEN [1, -1, pages - 3, pages - 2, pages - 1, pages]
            WHEN now = 3 THEN CASE WHEN pages = 6 THEN [1, 2, 3, 4, -1, 6] ELSE [1, 2, 3, 4, -1, pages] END
            WHEN now = pages - 2 THEN [1, -1, pages - 3, pages - 2, pages - 1, pages] ELSE [1, -1, now - 1, now, now + 1, -1, pages] END AS shown
FROM (SELECT part, part % 12 AS total, greatest(ceil((part % 200) / 10.0::DOUBLE)::BIGINT, 1) AS pages, 1 + part % 3 AS now, 1 + part % 3 > 1 AS has_prev, 1 + part % 3 < greatest(ceil((part % 200) / 10.0::DOUBLE), 1) AS has_next,
        CASE current_stage WHEN '1st_reading' THEN 0 WHEN '2nd_reading' THEN 1 WHEN 'committee' THEN 2 WHEN '3rd_reading' THEN 4 ELSE 6 END AS stage_index,
        current_stage IN ('committee', '3rd_reading', 'royal_assent') AS reached FROM bills)""",
)
def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = V.bills(spark, sf_dir), F.col
    info = B.page_info(c("part") % 200, 1 + c("part") % 3, F.lit(10))
    return b.select(
        "part", info["pages"].alias("pages"), info["has_prev"].alias("has_prev"), info["has_next"].alias("has_next"), P.stage_index(c("current_stage")).cast("long").alias("stage_index"), B.reached(c("current_stage"), F.lit("committee")).alias("reached"),
        F.greatest(F.lit(0), F.least(c("part") % 9, c("part") % 7)).alias("smaller"), T.percent(c("part") % 12, F.greatest(c("part") % 11, F.lit(1))).alias("pct"), F.transform(B.visible_pages(info["pages"], info["current"]), lambda x: x.cast("long")).alias("shown"),
    )
