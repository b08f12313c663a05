"""Party majorities, member statistics and vote listings.

`votes` has division_id, member_id, vote; `members` id, party, ...;
`divisions` id, date, bill_id, ...; `bills` id, number, title, short_title,
category. Members are a dimension that Spark broadcasts where its statistics
allow; the fact table is shuffled once, by division and party.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def _count(when: Column) -> Column:
    return F.sum(F.when(when, 1).otherwise(0))


def majority(yeas: Column, nays: Column) -> Column:
    """Yea or Nay by count; a tie has none."""
    return F.when(yeas > nays, F.lit("Yea")).when(nays > yeas, F.lit("Nay"))


def party_majority(votes: DataFrame, members: DataFrame, level_aware: bool = False) -> DataFrame:
    """division_id, party, yeas, nays, majority of every division and party that voted. Members without a party don't count."""
    keys = ["division_id", "party", *(["government_level"] if level_aware else [])]
    side = members.select(F.col("id").alias("member_id"), *keys[1:]).where("party is not null and party <> ''")
    tally = votes.join(side, "member_id").groupBy(*keys).agg(_count(F.col("vote") == "Yea").alias("yeas"), _count(F.col("vote") == "Nay").alias("nays"))
    return tally.withColumn("majority", majority(F.col("yeas"), F.col("nays")))


def party_sizes(members: DataFrame) -> DataFrame:
    """party, government_level, size: active members."""
    named = members.where("active and party is not null and party <> ''")
    return named.groupBy("party", F.coalesce("government_level", F.lit("federal")).alias("government_level")).agg(F.count("*").alias("size"))


def in_term(date: Column, start: Column, end: Column) -> Column:
    """Within a term whose end may be open; false without a start."""
    return F.coalesce((date >= start) & (end.isNull() | (date <= end)), F.lit(False))


def term_counts(members: DataFrame, divisions: DataFrame) -> DataFrame:
    """id, in_term: the divisions of a member's term.

    Divisions are counted by date and summed up to each calendar day, so a
    member's count is the difference of two look-ups and no member meets every
    division.
    """
    by_day = divisions.where("date is not null").groupBy("date").agg(F.count("*").alias("n"))
    span = by_day.agg(F.date_sub(F.min("date"), 1).alias("lo"), F.max("date").alias("hi")).where("lo is not null")  # one row
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    # one row a calendar day, whatever the number of divisions
    upto = days.join(by_day, "date", "left").select("date", F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("date")).alias("upto"))
    ends = F.array(F.struct(F.date_sub("term_start", 1).alias("date"), F.lit(-1).alias("sign")), F.struct(F.coalesce("term_end", "hi").alias("date"), F.lit(1).alias("sign")))
    edges = members.where("term_start is not null").crossJoin(F.broadcast(span)).select("id", "lo", "hi", F.explode(ends).alias("e"))
    edges = edges.select("id", F.least(F.greatest("e.date", "lo"), "hi").alias("date"), "e.sign")
    return edges.join(upto, "date").groupBy("id").agg(F.greatest(F.sum(F.col("sign") * F.col("upto")), F.lit(0)).alias("in_term"))


def scorecard(votes: DataFrame, members: DataFrame, divisions: DataFrame) -> DataFrame:
    """id, total_votes, party_line_pct, rebel_pct, missed_pct of every member.

    A member's own vote is taken out of the party's tally. A party with one
    active member at the member's level, or none, has every vote in line.
    """
    who = members.select("id", F.nullif("party", F.lit("")).alias("party"), F.coalesce("government_level", F.lit("federal")).alias("government_level"))
    named = votes.join(members.select(F.col("id").alias("member_id"), F.nullif("party", F.lit("")).alias("party"), "term_start", "term_end"), "member_id")
    dated = named.join(divisions.select(F.col("id").alias("division_id"), "date"), "division_id", "left")
    side = W.partitionBy("division_id", "party")  # rows stand together by division already
    yea, nay = (F.col("vote") == "Yea").cast("long"), (F.col("vote") == "Nay").cast("long")
    others = F.when(F.col("party").isNotNull(), majority(F.sum(yea).over(side) - yea, F.sum(nay).over(side) - nay))
    own = dated.withColumn("_others", others)
    during = F.when(in_term(F.col("date"), F.col("term_start"), F.col("term_end")), 1)
    line = own.groupBy(F.col("member_id").alias("id")).agg(F.count("*").alias("total_votes"), _count(F.col("vote") == F.col("_others")).alias("agreed"), F.count(during).alias("voted"))
    out = who.join(party_sizes(members), ["party", "government_level"], "left").join(line, "id", "left").join(term_counts(members, divisions), "id", "left")
    total = F.coalesce("total_votes", F.lit(0).cast("long"))
    kept = F.when(F.coalesce("size", F.lit(0)) <= 1, total).otherwise(F.coalesce("agreed", F.lit(0)))
    missed = F.greatest(F.coalesce("in_term", F.lit(0)) - F.coalesce("voted", F.lit(0)), F.lit(0))
    return out.select("id", total.alias("total_votes"), T.percent(kept, total).alias("party_line_pct"), T.percent(total - kept, total).alias("rebel_pct"), T.percent(missed, F.coalesce("in_term", F.lit(0))).alias("missed_pct"))


def _linked(divisions: DataFrame, bills: DataFrame) -> DataFrame:
    """Divisions with number and title of their bill."""
    b = bills.select(F.col("id").alias("bill_id"), F.col("number").alias("bill_number"), T.first_title(F.col("short_title"), F.col("title")).alias("bill_title"))
    d = divisions.join(b, "bill_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return d.select(F.col("id").alias("division_id"), "date", empty("bill_id"), empty("bill_number"), empty("bill_title"), empty("description"), empty("result"))


def recent_votes(votes: DataFrame, members: DataFrame, divisions: DataFrame, bills: DataFrame, limit: int = 50) -> DataFrame:
    """The `limit` newest votes of each member, with the party's majority (own vote included)."""
    d = divisions.select(F.col("id").alias("division_id"), "date")
    rank = W.partitionBy("member_id").orderBy(F.desc("date"), F.desc("division_id"))
    newest = votes.join(d, "division_id").withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= limit).drop("date")
    named = newest.join(members.select(F.col("id").alias("member_id"), "party"), "member_id")
    out = named.join(_linked(divisions, bills), "division_id").join(party_majority(votes, members).select("division_id", "party", "majority"), ["division_id", "party"], "left")
    return out.select("member_id", "division_id", "date", "bill_id", "bill_number", "bill_title", "description", "vote", "result", F.coalesce(F.col("vote") == F.col("majority"), F.lit(False)).alias("with_party"), F.coalesce("majority", F.lit("")).alias("party_majority"))


def missed_votes(member_id, votes: DataFrame, members: DataFrame, divisions: DataFrame, bills: DataFrame, limit: int = 50) -> DataFrame:
    """The newest divisions of one member's term without a vote of theirs; nothing without a start of term."""
    who = members.where(F.col("id") == member_id).select("party", "term_start", "term_end")
    during = divisions.join(F.broadcast(who), in_term(F.col("date"), F.col("term_start"), F.col("term_end")))  # one row
    own = votes.where(F.col("member_id") == member_id).select(F.col("division_id").alias("id"))
    missed = during.join(own, "id", "left_anti").orderBy(F.desc("date"), F.desc("id")).limit(limit)
    few = missed.select(F.col("id").alias("division_id"), "party")  # `limit` rows at most: only their votes are counted
    tally = party_majority(votes.join(few.select("division_id"), "division_id", "left_semi"), members.join(who.select("party"), "party", "left_semi"))
    out = few.join(_linked(divisions, bills), "division_id").join(tally.select("division_id", "party", "majority"), ["division_id", "party"], "left")
    return out.select("division_id", "date", "bill_id", "bill_number", "bill_title", "description", "result", F.coalesce("majority", F.lit("Split")).alias("party_majority"))


def category_scores(votes: DataFrame, divisions: DataFrame, bills: DataFrame) -> DataFrame:
    """member_id, category, total, yeas, nays, yea_pct over Yea and Nay votes on bills with a category."""
    d = divisions.select(F.col("id").alias("division_id"), "bill_id")
    b = bills.where("category is not null and category <> ''").select(F.col("id").alias("bill_id"), "category")
    both = votes.where(F.col("vote").isin("Yea", "Nay")).join(d, "division_id").join(b, "bill_id")
    out = both.groupBy("member_id", "category").agg(F.count("*").alias("total"), _count(F.col("vote") == "Yea").alias("yeas"), _count(F.col("vote") == "Nay").alias("nays"))
    return out.withColumn("yea_pct", T.percent(F.col("yeas"), F.col("total")))


def agreement(votes: DataFrame) -> DataFrame:
    """member_a < member_b, overlap, total, and the share in percent, rounded half to even, of every pair that shared a division."""
    a = votes.select("division_id", F.col("member_id").alias("member_a"), F.col("vote").alias("vote_a"))
    b = votes.select("division_id", F.col("member_id").alias("member_b"), F.col("vote").alias("vote_b"))
    out = a.join(b, "division_id").where("member_a < member_b").groupBy("member_a", "member_b").agg(_count(F.col("vote_a") == F.col("vote_b")).alias("overlap"), F.count("*").alias("total"))
    return out.withColumn("share", F.bround(F.lit(100.0) * F.col("overlap") / F.col("total"), 0))


def shared_votes(first, second, votes: DataFrame, divisions: DataFrame, bills: DataFrame, limit: int = 50) -> DataFrame:
    """The newest divisions in which both members voted, with both votes."""
    a = votes.where(F.col("member_id") == first).select("division_id", F.col("vote").alias("vote_a"))
    b = votes.where(F.col("member_id") == second).select("division_id", F.col("vote").alias("vote_b"))
    return a.join(b, "division_id").join(_linked(divisions, bills), "division_id").orderBy(F.desc("date"), F.desc("division_id")).limit(limit)


def recent_bill_votes(feed: DataFrame, limit: int = 5) -> DataFrame:
    """From a member's feed: the newest vote on each bill, then divisions without a bill, `limit` of each member."""
    key = F.when(F.trim("bill_id") != "", F.concat(F.lit("b:"), F.col("bill_id"))).otherwise(F.concat(F.lit("d:"), F.col("division_id").cast("string")))
    newest = W.partitionBy("member_id", key).orderBy(F.desc("date"), F.desc("division_id"))
    first = feed.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k")
    place = W.partitionBy("member_id").orderBy((F.trim("bill_id") == "").cast("int"), F.desc("date"), F.desc("division_id"))
    return first.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)
