"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where it is unset: a temporary folder in local mode, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        base = tempfile.mkdtemp(prefix="quorumlake-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"
        if local:
            spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: this cuts the lineage, and the files outlive an executor."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many more underscores in front as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder that shared_dir() named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
