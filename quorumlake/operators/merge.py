"""Writes as merges of a stored table with updates; each gives the table after the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(updates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last update of each key; `order` descends. max_by aggregates before the shuffle, so a hot key isn't sorted."""
    rest = [c for c in updates.columns if c not in key]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*key, "_x.*")


def first(updates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first update of each key: insert, do nothing on conflict."""
    rest = [c for c in updates.columns if c not in key]
    return updates.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*key, "_x.*")


def upsert(stored: DataFrame, updates: DataFrame, key: list[str], keep_if_empty: tuple[str, ...] = ()) -> DataFrame:
    """Updates replace rows of their key; the columns of keep_if_empty keep the stored value where the new one is null or ''."""
    new = updates.select(*key, *[F.col(c).alias(f"_{c}") for c in updates.columns if c not in key], F.lit(True).alias("_new"))
    both = stored.join(new, key, "full_outer")

    def pick(c: str) -> Column:
        if f"_{c}" not in new.columns:
            return F.col(c)
        fresh = F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c), F.col(f"_{c}")) if c in keep_if_empty else F.col(f"_{c}")
        return F.when(F.col("_new"), fresh).otherwise(F.col(c)).alias(c)

    return both.select(*key, *[pick(c) for c in stored.columns if c not in key])


def defaults(members: DataFrame) -> DataFrame:
    """A member's chamber and level where none is given."""
    return members.withColumn("chamber", F.coalesce(F.nullif("chamber", F.lit("")), F.lit("commons"))).withColumn("government_level", F.coalesce(F.nullif("government_level", F.lit("")), F.lit("federal")))


def insert_missing(stored: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows and the updates whose key is new, each once."""
    return stored.unionByName(updates.dropDuplicates(key).join(stored, key, "left_anti"))


def toggled(log: DataFrame, key: list[str]) -> DataFrame:
    """Keys that an odd number of toggles leaves on."""
    return log.groupBy(*key).agg(F.count("*").alias("toggles")).where("toggles % 2 = 1")


def stale(divisions: DataFrame, prefix: str, path: str) -> tuple[DataFrame, Column]:
    """Divisions without those whose id has the prefix but whose URL doesn't have the path; and the condition."""
    gone = F.col("id").ilike(f"{prefix}%") & F.col("sitting_url").isNotNull() & ~F.col("sitting_url").ilike(f"%{path}%")
    return divisions.where(~F.coalesce(gone, F.lit(False))), gone


def with_known(child: DataFrame, parent: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """A foreign key that the parent doesn't have becomes null, or its row goes (strict)."""
    known = parent.select(F.col("id").alias(column)).distinct()
    if strict:
        return child.join(known, column, "left_semi")
    out = child.join(known.withColumn("_ok", F.lit(True)), column, "left")
    return out.withColumn(column, F.when(F.col("_ok"), F.col(column))).drop("_ok").select(*child.columns)


def numbered(rows: DataFrame, group: list[str], order: list[Column], into: str = "number") -> DataFrame:
    return rows.withColumn(into, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
