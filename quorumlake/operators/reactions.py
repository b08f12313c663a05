"""Reactions to bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .merge import latest

# The kinds of reaction.
KINDS = ("support", "oppose", "neutral")


def counts(log: DataFrame, order: list[Column]) -> DataFrame:
    """bill_id, total, support, oppose, neutral and their percentages; a user's last reaction to a bill counts, other kinds don't."""
    last = latest(log.where(F.col("reaction").isin(*KINDS)), ["user_id", "bill_id"], order)
    out = last.groupBy("bill_id").agg(F.count("*").alias("total"), *[F.sum(F.when(F.col("reaction") == k, 1).otherwise(0)).alias(k) for k in KINDS])
    return out.select("*", *[T.percent(F.col(k), F.col("total")).alias(f"{k}_pct") for k in KINDS])


def of_bills(bills: DataFrame, tally: DataFrame) -> DataFrame:
    """The counts of every bill, zeros where there are none."""
    cols = ["total", *KINDS]
    return bills.select("bill_id").join(tally.select("bill_id", *cols), "bill_id", "left").na.fill(0, cols)
