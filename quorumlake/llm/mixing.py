"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words. Sources in code-point order, null
last, weigh 1, 2, 3, repeating; they share the sum of all sizes by weight,
where no target goes beyond `most` times the source's size and the excess is
reshared by weight. A source's target is met by as many complete epochs as
fit, then by a fractional one: documents in the order of exponential keys
-ln(u) / w, with u from the MD5 of seed and id and w the document's quality
weight, as long as the running sum stays below the rest; the document that
crosses it is taken if that comes nearer.

No source's rows meet in one task: sums by source and key bucket find the
bucket in which the rest ends, and only its rows are sorted. The window over
sources has one row each. Rows: null and empty texts have size 0 and take no
words; a null source is one source; repeated rows with equal ids share a key.
Columns other than doc_id, text and source go along under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import free, staged, table

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
SEED = 7
BUCKETS = 4096
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose; less for a share of symbols, half for under 50 words."""
    n = F.coalesce(F.length(text), F.lit(0))
    symbols = n - F.coalesce(F.length(F.translate(text, _SYMBOLS, "")), F.lit(0))
    return F.when(size < 50, F.lit(0.5)).otherwise(F.lit(1.0)) / (F.lit(1.0) + F.lit(10.0) * symbols / F.greatest(n, F.lit(1)))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long") + 1) / F.lit(2.0**48 + 1)
    return -F.log(u) / weight


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """_source, source_size, target: one row a source."""
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    src = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("_w", ((F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    src = src.withColumn("_cap", (most * F.col("source_size")).cast("double")).withColumn("_level", F.col("_cap") / F.col("_w"))
    rise = W.orderBy("_level", F.col("_source").asc_nulls_last())
    before = rise.rowsBetween(W.unboundedPreceding, -1)
    src = src.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_rest", F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    src = src.withColumn("_share", (F.sum(F.col("source_size").cast("double")).over(total) - F.col("_full")) / F.col("_rest"))
    src = src.withColumn("_share", F.min_by(F.when(F.col("_share") <= F.col("_level"), F.col("_share")), F.when(F.col("_share") <= F.col("_level"), F.col("_level"))).over(total))
    return src.select("_source", "source_size", F.least("_cap", F.col("_w") * F.coalesce("_share", F.lit(0.0))).alias("target"))


def counted(docs: DataFrame, *, most: int = MOST, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, text_hash, size, source_size, target and times (how often the mix takes the document)."""
    text = F.col("text")
    sized = docs.select(F.col("doc_id"), F.col("source").alias("_source"), F.xxhash64(text).alias("text_hash"), words(text).alias("size"), quality_weight(text, words(text)).alias("_weight"))
    sized = sized.withColumn("_key", exponential_key(F.col("doc_id"), F.col("_weight"), seed)).drop("_weight")
    sized = staged(sized.withColumn("_bucket", F.floor(buckets * (1 - F.exp(-F.col("_key")))).cast("int")), "mix-sizes")

    goal = targets(sized, most).withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size"))
    sums = sized.groupBy(F.col("_source").alias("_of"), "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(W.partitionBy("_of").orderBy("_bucket")) - F.col("_sum"))
    cut = sums.join(goal, F.col("_of").eqNullSafe(F.col("_source")))
    cut = cut.groupBy("_source", "source_size", "target", "_epochs", "_left").agg(F.max(F.when(F.col("_before") < F.col("_left"), F.struct("_bucket", "_before"))).alias("_cut"))
    cut = cut.select(F.col("_source").alias("_of"), "source_size", "target", "_epochs", "_left", F.coalesce("_cut._bucket", F.lit(-1)).alias("_end"), F.col("_cut._before").alias("_base"))

    rows = sized.join(cut, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    inner = rows.where("_bucket = _end")
    order = W.partitionBy("_source").orderBy("_key", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    inner = inner.withColumn("_at", F.col("_base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    inner = inner.withColumn("_more", ((F.col("_at") < F.col("_left")) & (2 * (F.col("_left") - F.col("_at")) > F.col("size"))).cast("long")).drop("_at")
    outer = rows.where("_bucket <> _end").withColumn("_more", (F.col("_bucket") < F.col("_end")).cast("long"))
    return outer.unionByName(inner).select("doc_id", "text_hash", "size", "source_size", "target", (F.col("_epochs") + F.col("_more")).alias("times"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = counted(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, *, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: rows of docs as often as the mix takes them, with the columns of docs. Rows of size 0 stay once."""
    id_, hash_, own, times, n = free(docs.columns, "_id", "_hash", "_own", "_times", "_n")
    drawn = counted(docs, most=most, seed=seed).groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("times"))).cast("int").alias(times))
    joined = docs.withColumn(own, F.xxhash64("text")).join(drawn, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)))
    return joined.where(F.col(times) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0) AS n, coalesce(length(translate(text, '#*$%&|<>', '')), 0) AS plain
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE)
           / ((CASE WHEN size < 50 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) / (1.0::DOUBLE + 10.0::DOUBLE * (n - plain) / greatest(n, 1))) AS k
  FROM sized),
src AS (
  SELECT source, sum(size)::BIGINT AS s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM keyed GROUP BY source),
level AS (
  SELECT *, 3.0::DOUBLE * s / w AS lv FROM src),
water AS (
  SELECT *, (sum(s::DOUBLE) OVER () - coalesce(sum(3.0::DOUBLE * s) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS share
  FROM level WINDOW o AS (ORDER BY lv, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, s, least(3.0::DOUBLE * s, w * coalesce((SELECT arg_min(share, lv) FROM water WHERE share <= lv), 0)) AS target FROM water),
run AS (
  SELECT d.doc_id, d.size, g.s, g.target, CASE WHEN g.s > 0 THEN floor(g.target / g.s) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s AS source_size, target,
       (size * (epochs + CASE WHEN before < target - epochs * s AND 2 * (target - epochs * s - before) > size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
