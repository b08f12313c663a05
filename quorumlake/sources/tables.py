"""The domain's tables: schemas, reading landed files, and writing them whole or by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "members": "id string, name string, party string, riding string, province string, role string, photo_url string, email string, website string, chamber string, active boolean, last_scraped string, government_level string, term_start date, term_end date",
    "bills": "id string, parliament int, session int, number string, title string, short_title string, bill_type string, chamber string, sponsor_id string, current_stage string, current_status string, category string, summary_ai string, full_text_url string, legisinfo_url string, introduced_date date, last_activity_date date, last_scraped string",
    "divisions": "id string, parliament int, session int, number int, date date, bill_id string, description string, yeas int, nays int, paired int, result string, chamber string, sitting_url string, last_scraped string",
    "member_votes": "division_id string, member_id string, vote string",
    "bill_stages": "bill_id string, stage string, chamber string, date date, notes string",
    "sitting_calendar": "parliament int, session int, date date",
    "legislature_calendar_dates": "jurisdiction string, date date, last_scraped string",
    "users": "id string, email string, display_name string, address string, riding string, province string, email_verified boolean, created_at timestamp",
    "user_follows": "user_id string, member_id string, created_at timestamp",
    "bill_reactions": "user_id string, bill_id string, reaction string, note string, created_at timestamp",
    "policy_submissions": "id bigint, user_id string, member_id string, subject string, body string, created_at timestamp",
    "bill_reaction_counts": "bill_id string, total bigint, support bigint, oppose bigint, neutral bigint, refreshed_at timestamp",
    "email_verification_tokens": "id bigint, user_id string, token string, code string, expires_at timestamp, used_at timestamp, created_at timestamp",
    "oauth_identities": "provider string, provider_user_id string, user_id string, created_at timestamp",
    "user_sessions": "id string, user_id string, expires_at timestamp, created_at timestamp",
    "user_category_preferences": "user_id string, category string",
    "user_bill_subscriptions": "user_id string, bill_id string, created_at timestamp",
    "user_tutorial_progress": "user_id string, activity string, completed_at timestamp",
}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its declared schema; columns that old files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that df has rows for and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def json_pages(spark: SparkSession, path: str, item: str, key: str = "objects") -> DataFrame:
    """The items of landed API pages ({key: [...]}), a row each."""
    pages = spark.read.schema(f"{key} array<struct<{item}>>").option("multiLine", True).json(path)
    return pages.select(F.explode(key).alias("x")).select("x.*")


def feed(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Items of landed RSS files."""
    return spark.read.format("xml").option("rowTag", "item").schema(fields).load(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed HTML or text files, one row each: path, html."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def pdfs(spark: SparkSession, path: str, limit: int = 32 << 20) -> DataFrame:
    """Landed PDF files up to `limit` bytes: path, content. Other content is left out."""
    found = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit)
    return found.where(F.expr("startswith(content, X'255044462D')")).select("path", "content")


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of landed OCR tables (12 tab-separated columns); rows that aren't words are left out."""
    rows = spark.read.option("wholetext", False).text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 12)
    number = lambda k, kind: F.try_element_at("c", F.lit(k)).try_cast(kind)
    out = rows.select(F.trim(F.try_element_at("c", F.lit(12))).alias("text"), number(7, "int").alias("left"), number(8, "int").alias("top"), number(9, "int").alias("width"), number(10, "int").alias("height"), number(11, "double").alias("confidence"))
    return out.where("text <> '' and left is not null and top is not null and width is not null and height is not null and confidence is not null")
