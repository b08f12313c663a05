"""Domain tables over the TPC-H-like test tables; the only module that knows those.

SQL holds the same definitions for the oracle, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefixes of bill ids by part key modulo 13; the rest are federal.
PREFIXES = ("ab", "bc", "mb", "nb", "nl", "ns", "on", "pe", "qc", "sk")
CHAMBERS = ("alberta", "british_columbia", "manitoba", "new_brunswick", "newfoundland_labrador", "", "", "", None, None, "senate", "commons", None)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bill_key(part: Column) -> Column:
    prefix = F.element_at(F.array(*[F.lit(x) for x in (*PREFIXES, "44", "44", "44")]), (part % 13 + 1).cast("int"))
    return F.concat(prefix, F.when(part % 13 < 10, F.lit("-44-1-")).otherwise(F.lit("-1-c-")), part.cast("string"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (_read(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    # nation and region are fixed dimensions of 25 and 5 rows
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    k = F.col("s_suppkey")
    return joined.select(
        k.alias("id"),
        F.col("s_name").alias("name"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("party"),
        F.col("n_name").alias("riding"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.col("n_name")).alias("province"),
        F.when(k % 4 == 0, F.lit("provincial")).otherwise(F.lit("federal")).alias("government_level"),
        F.when(k % 4 == 0, F.lit("ontario")).when(k % 4 == 1, F.lit("senate")).otherwise(F.lit("commons")).alias("chamber"),
        (k % 10 != 9).alias("active"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k * 37 % 900).cast("int")).alias("term_start"),
        F.when(k % 3 != 0, F.date_add(F.lit("1999-01-01").cast("date"), (k * 53 % 700).cast("int"))).alias("term_end"),
    )


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    of = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"))
    joined = o.join(of, o.o_orderkey == of.l_orderkey, "left")
    day = F.col("o_orderdate").cast("date")
    return joined.select(F.col("o_orderkey").alias("id"), F.lit(44).alias("parliament"), F.when(day < F.lit("1998-01-01").cast("date"), 1).otherwise(2).alias("session"), day.alias("date"), F.when(F.col("o_orderkey") % 9 != 0, bill_key(F.col("part"))).alias("bill_id"), F.col("o_orderpriority").alias("description"), F.col("o_orderstatus").alias("result"))


def vote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("division_id"), F.col("l_suppkey").alias("member_id"), F.when(F.col("l_returnflag") == "A", "Yea").when(F.col("l_returnflag") == "R", "Nay").otherwise("Paired").alias("vote"))


def member_votes(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    line = vote_lines(spark, sf_dir) if lines is None else lines
    return line.groupBy("division_id", "member_id").agg(F.min("vote").alias("vote"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, size = _read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    last = F.date_add(F.lit("1995-01-01").cast("date"), (k * 71 % 2400).cast("int"))
    return p.select(
        bill_key(k).alias("id"),
        k.alias("part"),
        F.concat(F.lit("C-"), k.cast("string")).alias("number"),
        F.col("p_name").alias("title"),
        F.when(k % 5 == 0, F.lit("")).when(k % 5 != 1, F.concat(F.col("p_brand"), F.lit(" Act"))).alias("short_title"),
        F.element_at(F.array(*[F.lit(x) for x in CHAMBERS]), (k % 13 + 1).cast("int")).alias("chamber"),
        F.when(k % 11 == 0, F.lit("")).when(k % 11 != 1, F.col("p_type")).alias("category"),
        F.when(size <= 10, "1st_reading").when(size <= 20, "2nd_reading").when(size <= 30, "committee").when(size <= 40, "3rd_reading").otherwise("royal_assent").alias("current_stage"),
        (k % 97).alias("sponsor_id"),
        F.when(k % 7 != 0, last).alias("last_activity_date"),
        F.date_sub(last, size).alias("introduced_date"),
    )


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "support").when(F.col("event_type") == "error", "oppose").when(F.col("event_type") == "view", "neutral")
    return e.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").try_cast("long").alias("bill_id"), kind.alias("reaction")).where("reaction is not null")


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").try_cast("long").alias("bill_id"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (_read(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = o.where("o_orderkey % 7 = 0").join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return joined.select(F.col("n_name").alias("jurisdiction"), F.col("o_orderdate").cast("date").alias("date")).distinct()


_BILL = "(CASE {p} % 13 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(PREFIXES)) + " ELSE '44' END || CASE WHEN {p} % 13 < 10 THEN '-44-1-' ELSE '-1-c-' END || {p}::VARCHAR)"
_CHAMBER = "CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(CHAMBERS) if x is not None) + " END"

SQL = f"""
members AS (
  SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 17 <> 0 THEN r_name END AS party, n_name AS riding,
         CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE n_name END AS province,
         CASE WHEN s_suppkey % 4 = 0 THEN 'provincial' ELSE 'federal' END AS government_level,
         CASE s_suppkey % 4 WHEN 0 THEN 'ontario' WHEN 1 THEN 'senate' ELSE 'commons' END AS chamber,
         s_suppkey % 10 <> 9 AS active,
         CAST(DATE '1995-01-01' + CAST(s_suppkey * 37 % 900 AS INTEGER) AS DATE) AS term_start,
         CASE WHEN s_suppkey % 3 <> 0 THEN CAST(DATE '1999-01-01' + CAST(s_suppkey * 53 % 700 AS INTEGER) AS DATE) END AS term_end
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
divisions AS (
  SELECT o_orderkey AS id, 44 AS parliament, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN 1 ELSE 2 END AS session,
         CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 9 <> 0 THEN {_BILL.format(p="part")} END AS bill_id,
         o_orderpriority AS description, o_orderstatus AS result
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS part FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
member_votes AS (
  SELECT l_orderkey AS division_id, l_suppkey AS member_id, min(CASE l_returnflag WHEN 'A' THEN 'Yea' WHEN 'R' THEN 'Nay' ELSE 'Paired' END) AS vote
  FROM lineitem GROUP BY 1, 2),
bills AS (
  SELECT {_BILL.format(p="p_partkey")} AS id, p_partkey AS part, 'C-' || p_partkey::VARCHAR AS number, p_name AS title,
         CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 <> 1 THEN p_brand || ' Act' END AS short_title, {_CHAMBER} AS chamber,
         CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 11 <> 1 THEN p_type END AS category,
         CASE WHEN p_size <= 10 THEN '1st_reading' WHEN p_size <= 20 THEN '2nd_reading' WHEN p_size <= 30 THEN 'committee' WHEN p_size <= 40 THEN '3rd_reading' ELSE 'royal_assent' END AS current_stage,
         p_partkey % 97 AS sponsor_id,
         CASE WHEN p_partkey % 7 <> 0 THEN CAST(DATE '1995-01-01' + CAST(p_partkey * 71 % 2400 AS INTEGER) AS DATE) END AS last_activity_date,
         CAST(DATE '1995-01-01' + CAST(p_partkey * 71 % 2400 AS INTEGER) - CAST(p_size AS INTEGER) AS DATE) AS introduced_date
  FROM part),
reactions AS (
  SELECT event_id, ts, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS bill_id,
         CASE event_type WHEN 'purchase' THEN 'support' WHEN 'error' THEN 'oppose' ELSE 'neutral' END AS reaction
  FROM events WHERE event_type IN ('purchase', 'error', 'view')),
toggles AS (
  SELECT event_id, ts, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS bill_id FROM events WHERE event_type = 'click'),
attempts AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events),
calendars AS (
  SELECT DISTINCT n_name AS jurisdiction, CAST(o_orderdate AS DATE) AS date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 7 = 0)
"""
