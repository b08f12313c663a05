"""Streams of landed rows into tables: each batch is merged by key, so a batch that runs twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge as G


def upserting(stream: DataFrame, path: str, key: list[str], order: list[Column], checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key (within a batch by `order`, and later batches win): a version folder for each batch, read by current().

    A batch's version is written from the version before it; writing it again
    after a lost run replaces the same folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = G.latest(batch, key, order)
        stored = current(batch.sparkSession, path, number)
        table = new if stored is None else G.upsert(stored.select(*new.columns), new, key)
        table.write.mode("overwrite").parquet(f"{path}/v={number:020d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the table, or the newest before a batch; None where there is none yet."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(base):
        return None
    versions = sorted(x.getPath().getName() for x in files.listStatus(base) if x.getPath().getName().startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))
    versions = [v for v in versions if before is None or int(v[2:]) < before]
    return spark.read.parquet(f"{path}/{versions[-1]}") if versions else None


def to_fetch(stubs: DataFrame, stored: DataFrame, votes: DataFrame) -> DataFrame:
    """Stubs (a stream or a table) of divisions that are new or have no votes yet."""
    complete = stored.select("id").join(votes.select("division_id").distinct().withColumnRenamed("division_id", "id"), "id", "left_semi")
    return stubs.join(complete, "id", "left_anti")
