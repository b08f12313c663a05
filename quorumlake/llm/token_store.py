"""Content-addressed store of token ids.

Writing: a document's ids (with an end id) are cut where a rolling hash over
the last 16 ids has zero low bits, so equal stretches give equal chunks
wherever they stand. A chunk's address is the SHA-256 of its ids as unsigned
32-bit little-endian integers. One exchange carries each chunk that is new to
a task to the writer of its address, which stores it once, and each document's
recipe (its addresses in order) to the recipe table.

Files below `path`:
  raw/kind=chunk    digest, n, payload: zstd of the ids, 2 bytes each where all are below 65536, else 4
  raw/kind=recipe   recipes before they have their place
  recipes           bucket, doc_id, start, n_tokens, root, digests, sizes, tails: in ascending doc_id order within
                    buckets of ascending ranges; start counts the ids of all documents before, tails those after a chunk
  manifest          a tree over the documents' Merkle roots. level 0: a row a stretch of RUN_TOKENS ids, of the documents
                    that start there; level k + 1: a row for each FOLD rows of level k, up to the level with one row

Reading verifies: payloads hash to their addresses, recipes to their roots,
and roots to the manifest; a mismatch is an error.

Rows: an empty or null text is its end id alone; a special token spelled out in
a text is encoded as the library does by default. Documents of one id are
ordered by root. A null doc_id comes first. An empty table has no recipes and an
empty manifest; columns other than doc_id and text aren't stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._order import quantiles, running, search
from ._store import shared_dir, staged, table
from ._tokens import encoder, with_end

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 2
#: Cut where the hash has this many zero bits; shortest and longest chunk, in ids.
BITS, SHORTEST, LONGEST = 10, 256, 8192
#: Documents in a bucket of the recipes, about.
BUCKET_ROWS = 20_000
#: Ids of a stretch, which so many documents share at most, and rows of a level of the manifest that the next one folds.
RUN_TOKENS, FOLD = 1 << 18, 1024

_RAW = "kind string, digest binary, n bigint, payload binary, doc_id bigint, digests array<binary>, sizes array<bigint>, root binary"


def cuts(ids: np.ndarray, bits: int = BITS, shortest: int = SHORTEST, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of a sequence. The hash at i is the sum of g(id[i-k]) << k for k below 16."""
    h = T.mix(ids.astype(np.uint64) + np.uint64(0x51ED270B))
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint64(step)
        h = more
    found = np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1
    ends, at, n = [], 0, len(ids)
    k = 0
    while n - at > longest or k < len(found):
        k = int(np.searchsorted(found, at + shortest))
        to = int(found[k]) if k < len(found) else n
        to = min(to, at + longest)
        if to >= n:
            break
        ends.append(to)
        at = to
    ends.append(n)
    return ends


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary tree over digests; an odd last node moves up."""
    level = digests
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return hashlib.sha256(b"\x02" + level[0]).digest() if level else b""


def _pack(ids: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    small = int(ids.max()) < 65536
    return (b"\x02" if small else b"\x04") + squeeze.compress(ids.astype("<u2" if small else "<u4").tobytes())


def unpack(payload: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(payload[1:])
    return np.frombuffer(data, "<u2" if payload[:1] == b"\x02" else "<u4").astype("<u4")


def write(docs: DataFrame, path: str, *, tokenizer: str = TOKENIZER, end: int = END) -> str:
    """Stores the ids of all documents below `path`; gives path."""
    spark = docs.sparkSession
    schema = pa.schema([("kind", pa.string()), ("digest", pa.binary()), ("n", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("root", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        sent: set[bytes] = set()
        for batch in T.slices(batches, "_text"):
            ids, off = with_end(*encoder(tokenizer).ids(batch.column(1)), end)
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = ids[off[i] : off[i + 1]]
                at, digests, sizes = 0, [], []
                for to in cuts(own):
                    part = own[at:to]
                    digest = hashlib.sha256(part.astype("<u4").tobytes()).digest()
                    digests.append(digest)
                    sizes.append(to - at)
                    if digest not in sent:
                        if len(sent) >= 200_000:  # a chunk may be sent again; its writer stores it once
                            sent.clear()
                        sent.add(digest)
                        rows.append(("chunk", digest, to - at, _pack(part, squeeze), None, None, None, None))
                    at = to
                root = merkle(digests)
                rows.append(("recipe", None, None, None, doc_id, digests, sizes, root))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            digests = batch.column(1).to_pylist()
            keep = [d is None or d != (digests[k - 1] if k else last) for k, d in enumerate(digests)]
            last = digests[-1] if digests else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    raw = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).mapInArrow(encode, _RAW)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = raw.repartition(parts, F.when(F.col("digest").isNull(), F.xxhash64("doc_id", "root")).otherwise(F.xxhash64("digest"))).sortWithinPartitions("kind", "digest").mapInArrow(once, _RAW)
    raw.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/raw")

    recipes = spark.read.schema("kind string, doc_id bigint, digests array<binary>, sizes array<bigint>, root binary").parquet(f"{path}/raw").where("kind = 'recipe'").drop("kind")
    recipes = recipes.withColumn("n_tokens", F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))
    rows = recipes.select("doc_id").count()
    bounds = quantiles(recipes, "doc_id", max(1, min(1000, rows // BUCKET_ROWS)))
    recipes = recipes.withColumn("bucket", search(F.col("doc_id"), bounds))
    recipes = running(recipes, "bucket", [F.col("doc_id"), F.col("root")], F.col("n_tokens"), "start")
    recipes = recipes.withColumn("tails", F.expr("transform(sizes, (s, i) -> n_tokens - aggregate(slice(sizes, 1, i + 1), 0L, (a, x) -> a + x))"))
    recipes.sortWithinPartitions("bucket", "start").select("bucket", "doc_id", "start", "n_tokens", "root", "digests", "sizes", "tails").write.option("compression", "zstd").parquet(f"{path}/recipes")
    for level, rows in enumerate(_manifest(_recipes(spark, path))):
        rows.write.parquet(f"{path}/manifest/level={level}")
    return path


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket int, doc_id bigint, start bigint, n_tokens bigint, root binary, digests array<binary>, sizes array<bigint>, tails array<bigint>").parquet(f"{path}/recipes")


_NODE = "part bigint, n_docs bigint, n_tokens bigint, first_start bigint, root string"


def _manifest(recipes: DataFrame) -> Iterator[DataFrame]:
    """The levels of the manifest; what one row folds is bounded on each."""
    folded = lambda by, root: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, root.alias("root")))), lambda x: x["root"]), ""), 256).alias("root")
    last = recipes.agg(F.max("start")).first()[0]
    part = F.floor(F.col("start") / RUN_TOKENS).cast("long").alias("part")
    now = recipes.groupBy(part).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("first_start"), folded(F.col("start"), F.hex("root")))
    top = (last or 0) // RUN_TOKENS
    while True:
        now = staged(now, "manifest-level")
        yield now
        if not top:
            return
        now = now.groupBy(F.floor(F.col("part") / FOLD).cast("long").alias("part")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("first_start").alias("first_start"), folded(F.col("part").alias("p"), F.col("root")))
        top //= FOLD


def _checked(spark: SparkSession, path: str, want_ids: bool) -> DataFrame:
    """Chunks whose ids were hashed anew: digest, n, crc32 and (if asked for) ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, n, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = unpack(payload).tobytes()
                if hashlib.sha256(ids).digest() != digest or len(ids) != 4 * n:
                    raise ValueError(f"chunk {digest.hex()} doesn't hold what its address says")
                out.append((digest, n, zlib.crc32(ids), ids if want_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["digest", "n", "crc", "ids"])

    chunks = spark.read.schema("kind string, digest binary, n bigint, payload binary").parquet(f"{path}/raw").where("kind = 'chunk'").drop("kind")
    return chunks.mapInArrow(read, "digest binary, n bigint, crc bigint, ids binary")


def _placed(spark: SparkSession, path: str, want_ids: bool) -> DataFrame:
    """A row for each chunk of each document."""
    recipes = _recipes(spark, path)
    parts = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode(F.arrays_zip("digests", "sizes", "tails")).alias("pos", "part"))
    parts = parts.select("doc_id", "start", "n_tokens", "root", "pos", F.col("part.digests").alias("digest"), F.col("part.sizes").alias("size"), F.col("part.tails").alias("tail"))
    found = parts.join(_checked(spark, path, want_ids), "digest", "left")
    return found.withColumn("n", F.when(F.col("n") == F.col("size"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("chunk missing: "), F.hex("digest")))))


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo that of CRC-32, bits reflected."""
    a, b = np.broadcast_arrays(a.astype(np.uint32), b.astype(np.uint32))
    b, out = b.copy(), np.zeros(a.shape, np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(_POLY), b >> np.uint32(1))
    return out


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a CRC-32 contributes when n_bytes more follow; the CRC of a whole is the XOR of its parts' contributions."""
    out = crc.astype(np.uint32)
    n = n_bytes.astype(np.int64)
    power = np.array([0x00800000], np.uint32)  # x^8: one byte
    while (n > 0).any():
        odd = (n & 1).astype(bool)
        if odd.any():
            out[odd] = _times(power, out[odd])
        power = _times(power, power)
        n = n >> 1
    return out


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks and root (hex) of every document, from the files.

    The CRC of a document's ids is put together from those of its chunks, so
    the ids themselves don't move.
    """

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(), 4 * tail.to_numpy()).astype(np.int64))

    verify(spark, path)
    parts = _placed(spark, path, False).withColumn("part_crc", shifted("crc", "tail"))
    out = parts.groupBy("doc_id", "start").agg(F.first("n_tokens").alias("want"), F.sum("n").alias("n_tokens"), F.bit_xor("part_crc").alias("ids_crc32"), F.count("*").alias("n_chunks"), F.hex(F.first("root")).alias("root"))
    same: Column = F.col("n_tokens") == F.col("want")
    return out.select("doc_id", "start", F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe's ids don't add up"))).alias("n_tokens"), "ids_crc32", "n_chunks", "root")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (unsigned 32-bit, little-endian) of every document, put together from its chunks."""
    rows = _placed(spark, path, True).groupBy("doc_id", "start").agg(F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    return rows.select("doc_id", "start", "n_tokens", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


def verify(spark: SparkSession, path: str) -> None:
    """Recomputes documents' roots and the manifest from the recipes; a difference is an error."""
    recipes = _recipes(spark, path)

    @F.pandas_udf("boolean")
    def true_root(digests: pd.Series, root: pd.Series) -> pd.Series:
        return pd.Series([merkle(list(d)) == r for d, r in zip(digests, root, strict=True)])

    if not recipes.where(~true_root("digests", "root")).isEmpty():
        raise ValueError("a recipe doesn't hash to its root")
    for level, rows in enumerate(_manifest(recipes)):
        said = spark.read.schema(_NODE).parquet(f"{path}/manifest/level={level}")
        if not said.exceptAll(rows).isEmpty() or not rows.exceptAll(said).isEmpty():
            raise ValueError("the recipes don't hash to the manifest")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(table(spark, sf_dir, "documents"), shared_dir(spark, "token-store"))
    return read_digests(spark, path)
