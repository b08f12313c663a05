"""Representatives of an address and the stored members they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from .members import provincial_office


def _folded(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _of_districts(reps: DataFrame, members: DataFrame) -> DataFrame:
    """Members with the districts (`_d`) that their riding's name holds.

    'Holds' is an equality join here: the parts of each distinct riding against
    the distinct districts. A riding of n characters has n * (n + 1) / 2 parts.
    """
    n = F.length("_r")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(a, n), lambda b: F.substring(F.col("_r"), a, b - a + 1))))
    ridings = members.select(F.lower("riding").alias("_r")).where("length(_r) > 0").distinct()
    asked = reps.select(_folded(F.col("district")).alias("_d")).where("_d <> ''").distinct()
    held = ridings.select("_r", F.explode(F.array_distinct(parts)).alias("_d")).join(asked, "_d")
    return members.withColumn("_r", F.lower("riding")).join(held, "_r")


def member_ids(reps: DataFrame, members: DataFrame) -> DataFrame:
    """rep_id, local_id, member_id of reps (rep_id, name, district, office, local_id), '' where there is none.

    Members of a district come by name and id. local_id: the given one, else of
    federal representatives the member of the same name. member_id: local_id,
    else the member of that name at the office's level, the first one at the
    level, the one of that name at any level. Members are reduced to the first
    one a district, name and level before they meet the representatives.
    """
    found = _of_districts(reps, members).withColumns({"_n": _folded(F.col("name")), "_l": _folded(F.col("government_level"))})
    first = lambda name, *by: found.groupBy(*by).agg(F.min(F.struct("name", "id"))["id"].alias(name))
    federal = F.lower("office") == "mp"
    rows = reps.withColumns({"_d": _folded(F.col("district")), "_n": _folded(F.col("name")), "_l": F.when(federal, "federal").otherwise("provincial")})
    rows = rows.join(first("_exact", "_d", "_n", "_l"), ["_d", "_n", "_l"], "left").join(first("_any", "_d", "_n"), ["_d", "_n"], "left").join(first("_level", "_d", "_l"), ["_d", "_l"], "left")
    own = F.nullif(F.trim(F.coalesce("local_id", F.lit(""))), F.lit(""))
    named = F.col("_n") != ""
    local = F.coalesce(own, F.when(federal & named, F.col("_any")))
    best = F.coalesce(local, F.when(named, F.col("_exact")), F.col("_level"), F.when(named, F.col("_any")), F.lit(""))
    return rows.select("rep_id", F.coalesce(local, F.lit("")).alias("local_id"), best.alias("member_id"))


def lookups(reps: DataFrame) -> DataFrame:
    """lookup_id, federal, provincial: rep_id of the first federal and provincial representative, in order of position, of rows (lookup_id, position, rep_id, office, district).

    One with a district comes before those without; of these the last one stays.
    """
    bare = F.coalesce("district", F.lit("")) == ""
    order = F.struct(bare, F.when(bare, -F.col("position")).otherwise(F.col("position")))
    federal = F.lower("office") == "mp"
    pick = lambda ok: F.min_by(F.when(ok, F.col("rep_id")), F.when(ok, order))
    return reps.groupBy("lookup_id").agg(pick(federal).alias("federal"), pick(~federal & provincial_office(F.col("office"))).alias("provincial"))


def office_province(offices: Column) -> Column:
    """Name of the province whose code an office's postal address (array<struct<type, postal>>) has, constituency offices first; '' without one."""
    codes = {k: v for k, v in P.ABBREVIATIONS.items() if len(k) == 2}
    found = lambda some: F.filter(F.transform(some, lambda o: F.regexp_extract(F.coalesce(o["postal"], F.lit("")), rf"\b({'|'.join(codes)})\b", 1)), lambda c: c != "")
    both = F.concat(found(F.filter(offices, lambda o: o["type"] == "constituency")), found(offices))
    return F.coalesce(P.lookup(codes, F.try_element_at(both, F.lit(1))), F.lit(""))
