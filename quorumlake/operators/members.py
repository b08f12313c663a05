"""Member directory, facets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as T
from .bills import contains


def directory(members: DataFrame, name: str = "", party: str = "", province: str = "", riding: str = "", level: str = "") -> DataFrame:
    """Members by name, filtered by substring of the name and equality of the rest."""
    out = members
    if name:
        out = out.where(contains(F.col("name"), name))
    for value, column in ((party, "party"), (riding, "riding"), (level, "government_level")):
        if value:
            out = out.where(F.col(column) == value)
    if province:
        out = out.where(F.col("province") == P.expand_province(F.lit(province)))
    return out.orderBy("name", "id")


def in_riding(members: DataFrame, riding: str) -> DataFrame:
    return members.where(contains(F.col("riding"), riding)).orderBy("name", "id")


def distinct_values(members: DataFrame, level: str = "") -> DataFrame:
    """(field, value) for the non-empty parties, provinces and ridings, from one scan."""
    out = members.where(F.col("government_level") == level) if level else members
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("value")) for x in ("party", "province", "riding")])).alias("x")
    return out.select(pairs).select("x.field", "x.value").where("value is not null and value <> ''").distinct()


def by_province(members: DataFrame) -> DataFrame:
    return members.groupBy(F.coalesce(F.nullif("province", F.lit("")), F.lit("Unknown")).alias("province")).agg(F.count("*").alias("members"))


def by_province_and_level(members: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("province", F.lit("")), F.lit("Unknown")).alias("province")
    return members.groupBy(name).pivot("government_level", ["federal", "provincial"]).agg(F.count(F.lit(1))).na.fill(0, ["federal", "provincial"])


def at_level(level: str) -> Column:
    """Whether a member sits at a level, by government level or else by chamber."""
    chamber = F.lower(F.trim(F.coalesce("chamber", F.lit(""))))
    own = F.lower(F.coalesce("government_level", F.lit(""))) == level
    return own | (~chamber.isin("", "commons", "senate") if level == "provincial" else chamber.isin("", "commons", "senate"))


# Titles of provincial offices, and what a longer title of one holds.
OFFICES = ("mla", "mpp", "mna", "mha", "member of the legislative assembly", "member of provincial parliament", "member of the national assembly", "member of the house of assembly")
ASSEMBLIES = ("legislative assembly", "national assembly", "provincial parliament", "house of assembly")


def provincial_office(office: Column) -> Column:
    plain = F.lower(F.trim(office))
    bare = F.trim(F.regexp_replace(plain, r"\(.*", ""))
    return bare.isin(*OFFICES) | plain.rlike("|".join(ASSEMBLIES))


def of_riding(members: DataFrame, riding: str, level: str) -> DataFrame:
    """One member for a riding: an exact one first, then one whose riding holds the words, at the level."""
    fits = members.where(contains(F.col("riding"), riding) & at_level(level))
    return fits.orderBy(F.when(F.lower("riding") == riding.lower(), 0).otherwise(1), "name", "id").limit(1)


def with_photos(members: DataFrame, photos: DataFrame) -> DataFrame:
    """members with photo_url filled where it is blank, by (position, name, photo_url) of the same normalized name; the last of a name counts."""
    found = photos.groupBy(T.normal_name(F.col("name")).alias("_n")).agg(F.max_by("photo_url", "position").alias("_photo")).where("_n <> ''")
    rows = members.withColumn("_n", T.normal_name(F.col("name"))).join(found, "_n", "left")
    own = F.coalesce("photo_url", F.lit(""))
    return rows.withColumn("photo_url", F.when(own == "", F.coalesce("_photo", F.lit(""))).otherwise(own)).select(*members.columns)
