"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together.
Candidate boundaries start evenly over the hash range, as many as the bytes
fill ranges of RANGE_BYTES (RANGES at most); each round counts the
exact bytes and rows below every candidate and puts new candidates (quantiles
of the keys there) into the gaps that hold a shard's end too coarsely or hold
too many rows. When all ends are within tolerance, one exchange brings the rows
of each gap together, and a row's slot is its place in the gap plus the counted
rows before.

The law is near equal bytes. A shard ends between groups of equal texts where
such an end is within tolerance, and beside the group that its goal falls into
where that costs WHOLE of a shard's share at most: a group of up to twice WHOLE
of a share stays in one shard. A larger one that a goal falls into is split by
doc_id, as near equal bytes would be lost otherwise.

The driver holds the candidates with their counts only. Rows: a null text has
size 1 and the hash of no text; a null doc_id sorts first; repeated rows take
slots of their own; an empty table gives no rows; columns of docs go along
under any name but shard and slot, which are replaced.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import free, staged, table

SHARDS = 8
#: Of a shard's share: how far an end may be from its goal, and how far so that a group of equal texts stays whole.
TOLERANCE = 0.002
WHOLE = 0.01
#: Fewest and most ranges of the exchange, and the bytes that one is meant to hold.
START = 64
RANGES = 1 << 14
RANGE_BYTES = 128 << 20
PROBES = 16
_LOW = -(1 << 63)

Bound = tuple[int, int]


def _below(h: Column, d: Column, bounds: list[Bound], power: int) -> Column:
    """How many of the ascending bounds are at most (h, d), beside the 2^power - 1 even ones."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        at, of = bounds[mid]
        return F.when((h > at) | ((h == at) & (d >= of)) if of != _LOW else h >= at, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    even = F.shiftrightunsigned(h.bitwiseXOR(F.lit(_LOW)), 64 - power).cast("int")
    return even + tree(0, len(bounds))


def size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def histogram(keys: DataFrame, shards: int, tolerance: float, power: int, probes: int, whole: float = WHOLE) -> tuple[list[Bound], list[Bound], list[int], list[int]]:
    """(all boundaries, those beside the even ones, rows below each, the boundaries' places that end a shard)."""
    even = {(_LOW + (k << (64 - power)), _LOW) for k in range(1, 1 << power)}
    bounds, more = sorted(even), []
    h, d = F.col("_h"), F.col("_d")
    done: set[Bound] = set()
    while True:
        got = {r[0]: r for r in keys.groupBy(_below(h, d, more, power).alias("_gap")).agg(F.sum("_size"), F.count("*"), F.min("_h"), F.max("_h"), F.min("_d"), F.max("_d")).collect()}
        gap_bytes = [got[k][1] if k in got else 0 for k in range(len(bounds) + 1)]
        gap_rows = [got[k][2] if k in got else 0 for k in range(len(bounds) + 1)]
        upto, rows = [0], [0]
        for b, n in zip(gap_bytes, gap_rows, strict=True):
            upto.append(upto[-1] + b)
            rows.append(rows[-1] + n)
        below = upto[1:-1]  # of bounds[k]
        between = [k for k, b in enumerate(bounds) if b[1] == _LOW]  # these split no group
        at_groups = [below[k] for k in between]
        total, n_rows = upto[-1], rows[-1]
        ends, rough = [], set()
        for s in range(1, shards):
            goal = total * s / shards
            off = lambda k, goal=goal: abs(below[k] - goal)
            k, g = bisect.bisect_left(below, goal), bisect.bisect_left(at_groups, goal)
            best = min((x for x in (k - 1, k) if 0 <= x < len(below)), key=off)
            safe = min((between[x] for x in (g - 1, g) if 0 <= x < len(between)), key=off)
            alone = k in got and got[k][3] == got[k][4]  # the goal falls into one group
            limit = (whole if alone else tolerance) * total / shards
            ends.append(safe if off(safe) <= limit else best)
            if off(ends[-1]) > max(limit, tolerance * total / shards):
                rough.add(k)
        rough |= {k for k, n in enumerate(gap_rows) if n > max(2000, 2 * n_rows >> power)}
        rough = {k for k in rough if k in got and (got[k][3], got[k][5]) != (got[k][4], got[k][6]) and (*((bounds[k - 1] if k else (_LOW, _LOW))), got[k][2]) not in done}
        if not rough:
            return bounds, more, rows[1:-1], ends
        at = [q / (probes + 1) for q in range(1, probes + 1)]
        found = keys.withColumn("_gap", _below(h, d, more, power)).where(F.col("_gap").isin(sorted(rough))).groupBy("_gap").agg(F.percentile_approx(h, at, 1000), F.percentile_approx(d, at, 1000)).collect()
        new: set[Bound] = set()
        for gap, by_h, by_d in found:
            done.add((*(bounds[gap - 1] if gap else (_LOW, _LOW)), got[gap][2]))
            if got[gap][3] != got[gap][4]:
                new |= {(x + up, _LOW) for x in by_h for up in (0, 1) if x + up < 1 << 63}
            else:
                new |= {(got[gap][3], x + up) for x in by_d for up in (0, 1) if x + up < 1 << 63}
        if new <= set(bounds):
            return bounds, more, rows[1:-1], ends
        bounds = sorted(set(bounds) | new)
        more = [b for b in bounds if b not in even]


def shard(docs: DataFrame, shards: int = SHARDS, *, tolerance: float = TOLERANCE, start: int = START, probes: int = PROBES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All columns of docs, with shard and slot (these names replace columns of docs); shards have near equal bytes."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    h, d, gap = free([*keep, "shard", "slot"], "_h", "_d", "_gap")
    keyed = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64("text").alias(h), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias(d))
    keys = staged(docs.select(F.xxhash64("text").alias("_h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("_d"), size(F.col("text")).alias("_size")), "shard-keys")
    total = keys.agg(F.sum("_size")).first()[0] or 0
    power = (max(start, shards, min(RANGES, total // range_bytes)) - 1).bit_length()
    bounds, more, rows, ends = histogram(keys, shards, tolerance, power, probes)
    before = [0, *rows]
    of, first, s = [], [], 0
    for k in range(len(bounds) + 1):
        while s < len(ends) and k > ends[s]:
            s += 1
        of.append(s)
        first.append(before[k] - (before[ends[s - 1] + 1] if s else 0))
    pick = lambda xs, kind: F.element_at(F.lit(xs).cast(f"array<{kind}>"), F.col(gap) + 1)
    placed = keyed.withColumn(gap, _below(F.col(h), F.col(d), more, power))
    placed = placed.withColumn("slot", pick(first, "long") + F.row_number().over(W.partitionBy(gap).orderBy(h, d)) - 1)
    return placed.withColumn("shard", pick(of, "int")).drop(h, d, gap)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
