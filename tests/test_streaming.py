"""Streaming forms against their batch twins."""

from pyspark.sql import functions as F

from quorumlake.operators import limiter
from quorumlake.operators import merge as G
from quorumlake.streaming import ingest
from quorumlake.streaming import limiter as stream_limiter


def test_limiter_keeps_its_window_across_batches(spark, tmp_path):
    rows = [("a", 10 * k, k) for k in range(30)] + [("b", 7 * k, 100 + k) for k in range(20)]
    for part in range(2):
        some = [r for r in rows if (r[1] >= 70) == bool(part)]
        spark.createDataFrame(some, "key string, at long, event_id long").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    events = spark.readStream.schema("key string, at long, event_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = stream_limiter.allowed(events, 2, 50)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("key", "at", "event_id", "ok").collect()))
    want = sorted(map(tuple, limiter.allowed(spark.createDataFrame(rows, "key string, at long, event_id long"), 2, 50).select("key", "at", "event_id", "ok").collect()))
    assert got == want


def test_upserts_of_a_stream(spark, tmp_path):
    rows = [(k % 5, k, f"v{k}") for k in range(40)]
    spark.createDataFrame(rows, "id long, seq long, name string").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, seq long, name string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "table")
    ingest.upserting(stream.withColumn("name", F.col("name")), path, ["id"], [F.col("seq")], str(tmp_path / "c")).awaitTermination()
    got = {r.id: r.seq for r in ingest.current(spark, path).collect()}
    assert set(got) == set(range(5))
    last = spark.createDataFrame([(i, 100 + i, "x") for i in range(5)], "id long, seq long, name string")
    last.write.mode("append").parquet(str(tmp_path / "in"))
    ingest.upserting(stream, path, ["id"], [F.col("seq")], str(tmp_path / "c")).awaitTermination()
    assert {r.id: r.seq for r in ingest.current(spark, path).collect()} == {i: 100 + i for i in range(5)}


def test_divisions_to_fetch(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")
    votes = spark.createDataFrame([(1, 9), (1, 8)], "division_id long, member_id long")
    assert sorted(r.id for r in ingest.to_fetch(ids(1, 2, 3), ids(1, 2), votes).collect()) == [2, 3]
    assert G.insert_missing(ids(1), ids(1, 2, 2), ["id"]).count() == 2
