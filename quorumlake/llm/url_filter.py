"""URL filters: host and path rules, then a list of keys held in a Bloom filter cascade.

Keys of a url are its host, each parent domain of two labels or more, and its
address (host and path). A cascade's first level encodes the listed keys; the
next one encodes the keys of the universe that pass it though they aren't
listed, the one after that the listed keys which pass the second, and so on
until nothing passes wrongly. The first level that a key fails tells whether it
is listed, exactly for every key of the universe, without a join. (Larisch et
al., CRLite, 2017, describe the structure.) Levels from the second on pass
half of what they don't encode.

The universe is the distinct keys of all urls of the table. Sizes of the
levels come from exact counts. The bits are a literal of the plan while they
stay below LITERAL_BITS; beyond, keys are dealt into segments by hash, each
with levels of its own below that size, and a row meets its segment's bits in
a join on the segment's number, salted for hot hosts.

Rules win over the list, the longest one that fits first. Rows: a null url and
one without `://` have an empty host and path and are allowed; repeated urls
are judged alike; an empty table gives no rows; other columns go along under
any name but host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import free, staged, table

#: Fixed values of the query: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Words that put a domain on the query's list where they stand alone between the hyphens of its first label.
WORDS = ["ads", "adult", "bets", "betting", "casino", "gambling", "loans", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx"]
#: Bits of a cascade that may stand in a plan (8 MB), and copies of a segment's bits beyond that.
LITERAL_BITS = 1 << 26
SALTS = 8
#: Least bits of the first level: with few bits, double hashing deals keys into too few patterns.
FIRST_BITS = 4096

Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z lowered; empty without `://`."""
    got = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(name: Column) -> Column:
    """The host and its parent domains of two labels or more; a host of one label is its only one."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def keys(name: Column, way: Column) -> Column:
    """All keys of an address; a path always starts with `/`, so domains and addresses don't meet but where it is empty."""
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains(name), F.array(F.concat(name, way)))))


def named(domain: Column, words: list[str]) -> Column:
    """Whether one of the words stands between the hyphens of the first label of a domain of two labels or more."""
    return domain.contains(".") & ~domain.contains("/") & F.arrays_overlap(F.split(F.substring_index(domain, ".", 1), "-"), F.array(*[F.lit(w) for w in words]))


def rule_of(name: Column, way: Column, rules: list[Rule], pick: int | None = None) -> Column:
    """Of the longest rule that fits: `host/path`, or its part `pick`; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((name == rule[1]) | name.endswith(f".{rule[1]}")) & way.startswith(rule[2])
        out = F.when(fits, F.lit(rule[1] + rule[2] if pick is None else rule[pick])).otherwise(out)
    return out


@dataclass
class Level:
    """m bits a segment and k hashes; bits start at word `at` of the segment's array."""

    m: int
    k: int
    at: int


@dataclass
class Cascade:
    levels: list[Level]
    segments: int
    #: (segment, bits array<long>); a literal of one segment where there is one.
    bits: list[int] | DataFrame

    def _passes(self, key: Column, bits: Column, n: int) -> Column:
        level, out = self.levels[n], F.lit(True)
        for word, bit in _positions(key, n, level):
            out = out & (F.element_at(bits, word + level.at + 1).bitwiseAND(bit) != 0)
        return out

    def holds(self, key: Column, bits: Column) -> Column:
        """The first level that the key fails decides: it is listed where that level's number is odd, from 0."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            out = F.when(~self._passes(key, bits, n), F.lit(n % 2 == 1)).otherwise(out)
        return out


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(segments)).cast("int") if segments > 1 else F.lit(0)


def _positions(key: Column, n: int, level: Level) -> list[tuple[Column, Column]]:
    """(word, bit) of the key's k places in level n, by double hashing."""
    one, two = (F.pmod(F.xxhash64(key, F.lit(2 * n + i)), F.lit(level.m).cast("long")) for i in (0, 1))
    spots = [one if i == 0 else (one + two * i) % F.lit(level.m).cast("long") for i in range(level.k)]
    return [(F.shiftright(at, 6).cast("int"), _bit(at)) for at in spots]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def _shape(encoded: int, others: int, n: int) -> tuple[int, int]:
    """(bits, hashes) of level n over `encoded` keys of a segment: the first one passes a share of the others near encoded / others, later ones a half."""
    rate = min(0.5, math.sqrt(0.5) * max(encoded, 1) / max(others, 1)) if n == 0 else 0.5
    bits = max(FIRST_BITS if n == 0 else 64, max(encoded, 1) * math.log2(1 / rate) / math.log(2))
    return 64 * math.ceil(bits / 64), max(1, round(math.log2(1 / rate)))


def cascade(universe: DataFrame, literal_bits: int = LITERAL_BITS) -> Cascade:
    """The cascade over a table (key, listed) of distinct keys. Each level is a count, a filter and an aggregate by word of its bits."""
    n_in, n_out = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    first, _ = _shape(n_in, n_out, 0)
    segments = max(1, math.ceil(6 * first / literal_bits)) if first > literal_bits // 6 else 1
    seg = _segment(F.col("key"), segments)
    rows = universe.select("key", "listed", seg.alias("seg"))
    encode, test = rows.where("listed").select("key", "seg"), rows.where(~F.col("listed")).select("key", "seg")
    found = Cascade([], segments, [])
    words, at, blocks = [], 0, None
    others = n_out
    while n_in:
        most = encode.groupBy("seg").count().agg(F.max("count")).first()[0] if segments > 1 else n_in
        level = Level(*_shape(most, math.ceil(others / segments), len(found.levels)), at)
        found.levels.append(level)
        n = len(found.levels) - 1
        spots = F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _positions(F.col("key"), n, level)]))
        set_ = encode.select("seg", spots.alias("s")).groupBy("seg", "s.word").agg(F.bit_or("s.bit").alias("bits"))
        size = level.m // 64
        if segments == 1:
            own = [0] * size
            for r in set_.collect():
                own[r["word"]] = r["bits"]
            words += own
            passed = found._passes(F.col("key"), F.lit(words).cast("array<long>"), n)
            wrong = staged(test.where(passed), "url-wrong")
        else:
            full = set_.groupBy("seg").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_m"))
            full = full.select("seg", F.expr(f"transform(sequence(0, {size - 1}), w -> coalesce(try_element_at(_m, w), 0L))").alias("own"))
            blocks = full.withColumnRenamed("own", "bits") if blocks is None else blocks.join(full, "seg", "left").select("seg", F.concat("bits", F.coalesce("own", F.array_repeat(F.lit(0).cast("long"), size))).alias("bits"))
            blocks = staged(blocks, "url-bits")
            wrong = staged(_with_bits(test, blocks, "seg").where(found._passes(F.col("key"), F.col("bits"), n)).select("key", "seg"), "url-wrong")
        at += size
        encode, test, others = wrong, encode, n_in
        n_in = wrong.count()
    found.bits = words if blocks is None else blocks
    return found


def _with_bits(rows: DataFrame, blocks: DataFrame, seg: str) -> DataFrame:
    """Rows with their segment's bits; each segment stands there SALTS times, so that a hot host's rows spread."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    copies = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("seg", "_seg")
    return rows.withColumn("_s", salt).join(copies, (F.col(seg) == F.col("_seg")) & (F.col("_s") == F.col("_salt")), "left").drop("_s", "_salt", "_seg")


def universe(pages: DataFrame, listed: DataFrame | Column) -> DataFrame:
    """(key, listed) of all keys of all urls, once each; listed: a table with the column key, or a condition on it."""
    found = pages.select(F.explode(keys(host(F.col("url")), path(F.col("url")))).alias("key"))
    if isinstance(listed, Column):
        return staged(found.distinct().withColumn("listed", listed), "url-keys")
    both = found.select("key", F.lit(False).alias("on"), F.lit(True).alias("seen")).unionByName(listed.select("key", F.lit(True).alias("on"), F.lit(False).alias("seen")))
    return staged(both.groupBy("key").agg(F.max("on").alias("listed"), F.max("seen").alias("seen")).where(F.col("seen") & F.col("key").isNotNull()).drop("seen"), "url-keys")


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame | Column, literal_bits: int = LITERAL_BITS) -> DataFrame:
    """All columns of pages, with host, path, rule and verdict (these names replace columns of pages).

    listed: a table of blocked domains and addresses (column key), or a
    condition on the column key. A url with a listed key is blocked unless a
    rule fits.
    """
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    found = cascade(universe(pages, listed), literal_bits)
    id_, name, way, each, on, bits, seg = free([*keep, "host", "path", "rule", "verdict"], "_row", "_host", "_path", "_keys", "_on", "bits", "_sg")
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], host(F.col("url")).alias(name), path(F.col("url")).alias(way))
    ruled = rule_of(F.col(name), F.col(way), rules)
    if not found.levels:
        rows = rows.withColumn(on, F.lit(False))
    elif found.segments == 1:
        one = F.lit(found.bits).cast("array<long>")
        rows = rows.withColumn(on, F.exists(keys(F.col(name), F.col(way)), lambda k: found.holds(k, one)))
    else:
        # one judgement a distinct address, so that pages themselves never move with bits
        addresses = rows.select(F.col(name).alias("_h"), F.col(way).alias("_p")).distinct()
        parts = addresses.withColumn("key", F.explode(keys(F.col("_h"), F.col("_p"))))
        parts = _with_bits(parts.withColumn("seg", _segment(F.col("key"), found.segments)), found.bits, "seg")
        hits = parts.where(found.holds(F.col("key"), F.col("bits"))).select("_h", "_p").distinct().withColumn(on, F.lit(True))
        rows = rows.join(hits, (F.col(name) == F.col("_h")) & (F.col(way) == F.col("_p")), "left").withColumn(on, F.coalesce(on, F.lit(False))).drop("_h", "_p")
    verdict = F.coalesce(rule_of(F.col(name), F.col(way), rules, 0), F.when(F.col(on), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col(name).alias("host"), F.col(way).alias("path"), ruled.alias("rule"), verdict.alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES, named(F.col("key"), WORDS)).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in longest]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, longest, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, longest, strict=True))
    words = rf"(^|[.-])({'|'.join(WORDS)})(-[^.]*)?[.]"
    return f"""
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN regexp_matches(host, '{words}') THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


ORACLE = _oracle()
