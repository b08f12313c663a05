"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorumlake.llm import mixing, near_dedup, packing, passages, quality
from quorumlake.llm._store import shared_dir, table

STAGES = [
    ("quality_rules", quality.stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", passages.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Chaining, the n-gram classifier and tokenizers aren't expressible in SQL; tests/llm checks the stages one by one and run() on odd rows and an empty table, and run() has no plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
