"""Queries of sessions by evidence and of printed calendars, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as V
from ..operators import printed as P
from ..operators import sessions as S
from .catalog import query, spread

_CODES = "[" + ", ".join(repr(x) for x in V.PREFIXES) + "]"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")


def _session_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a customer, with evidence of six kinds that agrees or contradicts itself."""
    k = F.col("c_custkey")
    n, s = (10 + k % 80).cast("int"), (1 + k % 8).cast("int")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    url = F.when(k % 6 == 2, t("https://x/assembly-", n, "-session-", s)).when(k % 6 == 3, t("https://x/", n, "th-parliament/", s, "-session")).otherwise(F.lit("https://x/bills"))
    html = (
        F.when(k % 6 == 0, t("<title>", n, "th Parliament, ", s, "st Session</title><a href='/90-parliament-9-session'>current</a>"))
        .when(k % 6 == 1, t("<ul><li><a href='/assembly-", n, "-session-", s, "/'>Votes</a><li><a href='/assembly-", n, "-session-9'>archives</a><li><a href='/assembly-", n - 1, "-session-9/'>Votes</a></ul><p>99th legislature 9th session"))
        .when(k % 6 == 2, t("<h1>Archive of the <i>95th</i> General Assembly, 9th session</h1><a href='#'>Latest: 3rd legislature, 1 session</a>"))
        .when(k % 6 == 3, t("<nav><a href='/m/97-3'>", n + 1, "th legislature 1 session overview</a></nav>"))
        .when(k % 6 == 4, t("<h4>Legislature, Session 31-2 (2025)</h4><h5>43 - 3 (2025- )</h5><a href='/41-1/'>session</a>"))
    )
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in V.PREFIXES]), (k % 10 + 1).cast("int")), F.when(k % 6 == 5, "").otherwise(t("~", k)))
    return spread(_customers(spark, sf_dir), "c_custkey", like=_customers(spark, sf_dir)).select(k.alias("page_id"), F.when(k % 6 == 4, F.element_at(F.array(*[F.lit(x) for x in V.PREFIXES]), (k % 10 + 1).cast("int"))).otherwise(code).alias("code"), url.alias("url"), html.alias("html"))


@query(
    "resolved_sessions",
    f"""SELECT {_CODES}[c_custkey % 10 + 1] || '~' || c_custkey AS code, 'pages' AS origin, (10 + c_custkey % 80)::INT + CASE WHEN c_custkey % 6 = 3 THEN 1 ELSE 0 END AS legislature, CASE WHEN c_custkey % 6 = 3 THEN 1 ELSE 1 + c_custkey % 8 END::INT AS session FROM customer WHERE c_custkey % 6 < 4
    UNION ALL SELECT code, CASE WHEN code IN ('ab', 'mb', 'qc') THEN 'pages' WHEN stored THEN 'stored' ELSE 'constant' END,
      CASE code WHEN 'ab' THEN 31 WHEN 'mb' THEN 43 WHEN 'qc' THEN 41 ELSE CASE WHEN stored THEN 44 WHEN code = 'on' THEN 43 ELSE 1 END END, CASE code WHEN 'ab' THEN 2 WHEN 'mb' THEN 3 ELSE 1 END
      FROM (SELECT DISTINCT {_CODES}[c_custkey % 10 + 1] AS code FROM customer WHERE c_custkey % 6 > 3) LEFT JOIN (SELECT DISTINCT left(id, 2) AS code, true AS stored FROM bills) USING (code)""",
)
def resolved_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bills(spark, sf_dir).select("id", F.lit(44).alias("parliament"), F.lit(1).alias("session"))
    return S.resolve(_session_pages(spark, sf_dir), b, {"on": (43, 1)})


@query(
    "session_options",
    "SELECT c_custkey AS page_id, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'v' || c_custkey ELSE 'first' END AS value FROM customer",
)
def session_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A select element with the session among others, without it, or of another class."""
    k = F.col("c_custkey")
    n, s = (10 + k % 80).cast("int"), (1 + k % 8).cast("int")
    own = F.concat(F.lit("<option title='"), n.cast("string"), F.lit("th Legislature' value='v"), k.cast("string"), F.lit("'>"), s.cast("string"), F.lit(" session"))
    html = F.concat(F.lit("<select class='"), F.when(k % 4 == 0, "other").otherwise("x sessionLegislature"), F.lit("'><option value='-1'>"), n.cast("string"), F.lit("th legislature "), s.cast("string"), F.lit(" session<option value='first'>1"), n.cast("string"), F.lit(" legislature 2 session"), F.when(k % 4 == 1, own).otherwise(""), F.lit("</select>"))
    return S.chosen_option(spread(_customers(spark, sf_dir), "c_custkey", like=_customers(spark, sf_dir)).select(k.alias("page_id"), html.alias("html"), n.alias("legislature"), s.alias("session")))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, date, on: the days of orders and the days after them on a page a customer and year; a day may be on and off, by different words."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("date").alias("date"))
    both = o.select("c", F.inline(F.array(F.struct("date", F.lit(True).alias("on")), F.struct(F.date_add("date", 1).alias("date"), F.lit(False).alias("on")))))
    return spread(both.select((F.col("c") * 10000 + F.year("date")).alias("page_id"), F.year("date").alias("year"), "date", "on"), "page_id", like=o).distinct()


def _words(days: DataFrame) -> DataFrame:
    """The days as words in months' boxes, far from each other, and the headings."""
    x, y = (F.month("date") - 1) % 3, F.floor((F.month("date") - 1) / 3)
    share = lambda c: F.when(c, F.lit(12)).otherwise(F.lit(7))
    one = days.select("page_id", F.dayofmonth("date").cast("string").alias("text"), (x * 900 + 20 * F.weekday("date")).cast("int").alias("left"), (y * 700 + 40 + 3 * F.dayofmonth("date")).cast("int").alias("top"), F.lit(15).alias("width"), F.lit(9).alias("height"), F.when(F.dayofmonth("date") % 2 == 0, 0.0).otherwise(90.0).alias("confidence"), F.lit(100).alias("pixels"), share(F.col("on")).alias("sitting"), F.lit(0).alias("violet"))
    heads = days.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("m"))
    name = F.element_at(F.array(*[F.lit(n[: 3 + k % 4].upper() if k % 2 else n.title()) for k, n in enumerate(P.MONTHS)]), F.col("m") + 1)
    head = heads.select("page_id", name.alias("text"), (F.col("m") % 3 * 900 + 60).cast("int").alias("left"), (F.floor(F.col("m") / 3) * 700).cast("int").alias("top"), F.lit(60).alias("width"), F.lit(20).alias("height"), F.lit(0.0).alias("confidence"), F.lit(100).alias("pixels"), F.lit(99).alias("sitting"), F.lit(0).alias("violet"))
    unsure = days.select("page_id", F.lit("17").alias("text"), F.lit(40).alias("left"), F.lit(60).alias("top"), F.lit(15).alias("width"), F.lit(9).alias("height"), F.lit(12.5).alias("confidence"), F.lit(100).alias("pixels"), F.lit(99).alias("sitting"), F.lit(0).alias("violet")).distinct()
    return one.unionByName(head).unionByName(unsure)


@query("printed_days", "SELECT DISTINCT o_custkey * 10000 + year(o_orderdate) AS page_id, CAST(o_orderdate AS DATE) AS date FROM orders")
def printed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    return P.highlighted_days(_words(days), days.select("page_id", "year", F.lit(3000).alias("height_of_page")).distinct())


_YEARS = """, days AS (SELECT DISTINCT n_nationkey * 10000 + year(o_orderdate) AS page_id, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  grids AS (SELECT page_id FROM (SELECT page_id, date FROM days UNION SELECT page_id, date + 1 FROM days WHERE year(date + 1) = page_id % 10000) GROUP BY 1 HAVING count(*) >= 150 AND count(DISTINCT month(date)) = 12)"""


@query(
    "printed_weeks",
    f"""{_YEARS}, weeks AS (SELECT DISTINCT page_id, CAST(date_trunc('week', date) AS DATE) AS monday FROM days JOIN grids USING (page_id)),
    open AS (SELECT page_id, CAST(monday + unnest([1, 2, 3, 4]) AS DATE) AS date FROM weeks)
    SELECT page_id, date FROM open o WHERE year(date) = page_id % 10000 AND NOT EXISTS (SELECT 1 FROM days d WHERE d.page_id = o.page_id AND d.date = o.date AND day(d.date) % 3 = 0)""",
)
def printed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a nation and year, where 150 days of all months are there; every third sitting day is a holiday; neighbours in one line run together."""
    o, c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    on = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select((F.col("n_nationkey") * 10000 + F.year("o_orderdate")).alias("page_id"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("date").alias("date")).distinct()  # nation: a fixed dimension of 25 rows
    both = on.withColumn("on", F.lit(True)).unionByName(on.select("page_id", "year", F.date_add("date", 1).alias("date"), F.lit(False).alias("on"))).where(F.year("date") == F.col("year"))
    days = both.groupBy("page_id", "year", "date").agg(F.max("on").alias("on"))
    whole = days.groupBy("page_id").agg((F.count("*") >= 150).alias("a"), (F.count_distinct(F.month("date")) == 12).alias("b")).where("a and b").select("page_id")
    days = days.join(whole, "page_id")
    words = _words(days.select("page_id", "date", "on")).where(~F.col("text").rlike("[A-Za-z]") & (F.col("confidence") != 12.5))
    words = words.withColumn("violet", F.when((F.col("sitting") == 12) & (F.col("text").cast("int") % 3 == 0), 8).otherwise(7)).withColumn("confidence", F.lit(0.0))
    return P.highlighted_weeks(words, days.select("page_id", "year", F.lit(3000).alias("height_of_page")).distinct())


@query(
    "day_tokens",
    "SELECT o_orderkey, CASE d WHEN 10 THEN [10, 11, 1, 2] WHEN 12 THEN [1, 2, 13, 14] WHEN 21 THEN [2, 1, 2, 2, 2, 3] WHEN 23 THEN [2, 3, 24, 25] WHEN 31 THEN [3, 10] ELSE CASE WHEN d <= 26 THEN [d, d + 1, d + 2] END END AS days FROM (SELECT o_orderkey, day(o_orderdate)::INT AS d FROM orders)",
)
def day_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days in a row whose digits run together, twice with a split of a higher score; and a token that two days make up or none."""
    d = F.dayofmonth("o_orderdate")
    token = F.when(d <= 26, F.concat(d.cast("string"), (d + 1).cast("string"), (d + 2).cast("string"))).otherwise(F.concat(d.cast("string"), F.lit("0")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", P.day_split(token).alias("days"))


@query(
    "word_clusters",
    "SELECT o_custkey, CASE WHEN n >= 3 THEN [round(m, 6), round(m + 1000, 6), round(m + 5000, 6)]::DOUBLE[] END AS centers FROM (SELECT o_custkey, count(*) AS n, avg(o_orderkey % 10) AS m FROM orders GROUP BY 1)",
)
def word_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clusters of each customer's numbers, which are the same but for their places; a customer with fewer than three has none."""
    v = (F.col("o_orderkey") % 10).cast("double")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.collect_list(v).alias("v"))
    spread = F.concat("v", F.transform("v", lambda x: x + 5000), F.transform("v", lambda x: x + 1000))
    centers = P.clusters(F.when(F.size("v") >= 3, spread).otherwise(F.slice("v", 1, 2)), 3)
    return o.select("o_custkey", F.transform(centers, lambda x: F.round(x, 6)).alias("centers"))
