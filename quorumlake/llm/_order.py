"""Splitting an ordered column into ranges without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantiles(df: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 ascending boundaries; range k holds the values from boundary k - 1 up to below boundary k."""
    if parts < 2:
        return []
    at = df.agg(F.percentile_approx(F.col(column), [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    return sorted(set(at or []))


def search(column: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most `column`, as a balanced tree of comparisons; 0 for null."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def running(df: DataFrame, bucket: str, by: list[Column], size: Column, into: str) -> DataFrame:
    """Adds the sum of `size` over all rows before a row, ordered by bucket and `by`.

    One row a bucket goes to the driver. The window needs one exchange by
    bucket; `by` must order the rows of a bucket fully for a defined result.
    """
    from pyspark.sql import Window as W

    sums = {r[0]: r[1] for r in df.groupBy(bucket).agg(F.sum(size)).collect()}
    base, bounds, total = [], sorted(sums), 0
    for b in bounds:
        base.append(total)
        total += sums[b]
    before = F.element_at(F.array(*[F.lit(x).cast("long") for x in base]), search(F.col(bucket), bounds[1:]) + 1) if base else F.lit(0).cast("long")
    w = W.partitionBy(bucket).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(into, before + F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
