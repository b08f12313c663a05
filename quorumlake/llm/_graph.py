"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); the component is its smallest node.

    Each step is a pre-aggregated minimum by node and a join on it, so the
    neighbours of one node never meet in one task. A step's edges are written
    to the shared folder.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_n")).agg(F.min("b").alias("_m"))
        large = both.join(least, F.col("a") == F.col("_n")).where("b > a").select(F.col("b").alias("a"), F.least("_m", "a").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("_n")).agg(F.min("b").alias("_m"))
        small = large.join(least, F.col("a") == F.col("_n"))
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = staged(small.where("a <> b").distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
