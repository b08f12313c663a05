"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph pieces.

A paragraph (line) is cut into pieces of at most `PIECE_WORDS` words; the set
of the pieces' 64-bit digests stands for the text. A sketch has three rows of m
cells; a digest goes into one cell of each row, which holds a count, the XOR of
its digests and the XOR of their check hashes. The fingerprint is the number
of digests and the sketch with m = 4.

Two versions are compared by subtracting sketches cell by cell, where equal
digests cancel, and peeling: a cell with a count of 1 or -1 and a fitting check
gives up its digest, which is taken out of its other cells, until nothing is
left. Long texts are sketched in blocks of digests by hash, so that the work
grows with the number of pieces. Where peeling sticks, the block is sketched
again with larger m; after the last size the sets themselves are compared.
Likeness is the Jaccard index, |A and B| / |A or B|, 1 for two empty sets.

Everything is SQL functions on rows. One exchange brings documents to their
neighbours in doc_id order. Rows: a null text is empty; repeated ids are
ordered by hash of text; one document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._order import quantiles, search
from ._store import table

PIECE_WORDS = 8
#: Digests a block and version, about; cells of each of a block's three rows, size after size.
BLOCK = 6
SIZES = (8, 32, 128)
ROUNDS = 7
BASE = 4
#: Documents a bucket, about.
BUCKET_ROWS = 2000

_PIECES = rf"[^ \t\r\n\x0b\f]+(?:[ \t\r\x0b\f]+[^ \t\r\n\x0b\f]+){{0,{PIECE_WORDS - 1}}}"


def digests(text: str) -> str:
    """SQL: the array of distinct digests of a text."""
    pattern = _PIECES.replace("\\", "\\\\")
    return f"array_distinct(transform(regexp_extract_all({text}, '{pattern}', 0), p -> xxhash64(p)))"


def _cell(key: str, row: str, m: int) -> str:
    return f"cast(shiftrightunsigned({key}, 7 * {row}) & {m - 1} as int)"


def fingerprint(units: str) -> str:
    """SQL: the base sketch as text; count, key and check of each cell in hex."""
    cell = f"aggregate(filter({units}, u -> {_cell('u', f'(i div {BASE})', BASE)} = i % {BASE}), named_struct('c', 0, 'k', 0L, 'h', 0L), (a, u) -> named_struct('c', a.c + 1, 'k', a.k ^ u, 'h', a.h ^ (xxhash64(u) & 4294967295L)), a -> concat(lpad(hex(a.c), 4, '0'), lpad(hex(a.k), 16, '0'), lpad(hex(a.h), 8, '0')))"
    return f"concat(hex(size({units})), ':', array_join(transform(sequence(0, {3 * BASE - 1}), i -> {cell}), ''))"


def _placed(key: str, sign: str, check: str, m: int) -> str:
    """SQL: a digest with the numbers of its cells, one of each row."""
    rows = ", ".join(f"'r{row}', {row * m} + {_cell(key, str(row), m)}" for row in range(3))
    return f"named_struct('k', {key}, 's', {sign}, 'h', {check}, {rows})"


def _difference(entries: str, m: int) -> str:
    """SQL: the non-zero cells of the difference of two sketches, from struct<k, s, h> with s 1 or -1 by version; only cells that a digest goes into are made."""
    ids = "array_distinct(flatten(transform(es, x -> array(x.r0, x.r1, x.r2))))"
    cell = "aggregate(filter(es, x -> x.r0 = i or x.r1 = i or x.r2 = i), named_struct('i', i, 'c', 0, 'k', 0L, 'h', 0L), (a, x) -> named_struct('i', i, 'c', a.c + x.s, 'k', a.k ^ x.k, 'h', a.h ^ x.h))"
    cells = f"filter(transform({ids}, i -> {cell}), c -> c.c <> 0 or c.k <> 0L or c.h <> 0L)"
    return f"transform(array(transform({entries}, x -> {_placed('x.k', 'x.s', 'x.h', m)})), es -> {cells})[0]"


def _peel(entries: str, m: int) -> str:
    """SQL: struct<cells, plus, minus>: what is left, and the recovered digests of either version."""
    pure = lambda s: f"transform(array_distinct(transform(filter(st.cells, c -> c.c = {s} and c.h = xxhash64(c.k)), c -> c.k)), k -> {_placed('k', str(s), 'xxhash64(k)', m)})"
    taken = "transform(st.cells, c -> aggregate(filter(p, x -> x.r0 = c.i or x.r1 = c.i or x.r2 = c.i), c, (a, x) -> named_struct('i', c.i, 'c', a.c - x.s, 'k', a.k ^ x.k, 'h', a.h ^ x.h)))"
    step = f"aggregate(array(concat({pure(1)}, {pure(-1)})), st, (z, p) -> if(size(p) = 0, z, named_struct('cells', filter({taken}, c -> c.c <> 0 or c.k <> 0L or c.h <> 0L), 'plus', st.plus + size(filter(p, x -> x.s = 1)), 'minus', st.minus + size(filter(p, x -> x.s = -1)))))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {_difference(entries, m)}, 'plus', 0, 'minus', 0), (st, r) -> if(size(st.cells) = 0, st, {step}))"


def _compare(df: DataFrame, side: int, into: str) -> DataFrame:
    """Adds struct<plus, minus> of the block's digests of the text against those of another version (side)."""
    entries = f"transform(filter(pieces, x -> x.side = 0 or x.side = {side}), x -> named_struct('k', x.digest, 's', if(x.side = 0, 1, -1), 'h', xxhash64(x.digest)))"
    df = df.withColumn("_e", F.expr(entries)).withColumn(into, F.expr(_peel("_e", SIZES[0])))
    for m in SIZES[1:]:
        df = df.withColumn(into, F.expr(f"if(size({into}.cells) = 0, {into}, {_peel('_e', m)})"))
    own, other = "transform(filter(_e, x -> x.s = 1), x -> x.k)", "transform(filter(_e, x -> x.s = -1), x -> x.k)"
    exact = f"named_struct('plus', size(array_except({own}, {other})), 'minus', size(array_except({other}, {own})))"
    return df.withColumn(into, F.expr(f"if(size({into}.cells) = 0, named_struct('plus', {into}.plus, 'minus', {into}.minus), {exact})")).drop("_e")


def neighbours(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """bucket, rn, doc_id, text, units and those of the next document (next_text, next_units), by one exchange."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = plain.count()
    bounds = quantiles(plain, "doc_id", max(1, min(2048, n // bucket_rows)))
    plain = plain.withColumn("_h", F.xxhash64("text")).withColumn("bucket", search(F.col("doc_id"), bounds))
    first = {r[0]: (r[1][0], r[1][1]) for r in plain.groupBy("bucket").agg(F.min(F.struct("doc_id", "_h"))).collect()}
    order = sorted(first)
    before = {first[b]: order[k - 1] for k, b in enumerate(order)}
    home = F.struct(F.col("bucket"), F.lit(False).alias("end"))
    guest = F.lit(None).cast("int")
    for (doc_id, h), b in list(before.items()) if len(before) <= 8 else []:
        guest = F.when(F.col("doc_id").eqNullSafe(F.lit(doc_id).cast("long")) & (F.col("_h") == h), F.lit(b)).otherwise(guest)
    if len(before) > 8:
        named = F.create_map(*[F.lit(x) for (doc_id, h), b in before.items() for x in (f"{doc_id}:{h}", b)])
        ids = [doc_id for doc_id, _ in before if doc_id is not None]
        may = F.col("doc_id").isin(ids) | F.col("doc_id").isNull()
        guest = F.when(may, F.try_element_at(named, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit(":"), F.col("_h").cast("string"))))
    spread = F.when(guest.isNotNull(), F.array(home, F.struct(guest.alias("bucket"), F.lit(True).alias("end")))).otherwise(F.array(home))
    rows = plain.withColumn("units", F.expr(digests("text"))).withColumn("_at", F.explode(spread))
    rows = rows.select("doc_id", "text", "_h", "units", F.col("_at.bucket").alias("bucket"), F.col("_at.end").alias("_end"))
    w = W.partitionBy("bucket").orderBy("_end", "doc_id", "_h")
    rows = rows.select("bucket", F.row_number().over(w).alias("rn"), "doc_id", "text", "units", "_end", F.lead("text").over(w).alias("next_text"), F.lead("units").over(w).alias("next_units"))
    return rows.where(~F.col("_end")).drop("_end")


def compared(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document."""
    rows = neighbours(docs, bucket_rows).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("_edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))"))
    rows = rows.withColumn("_units", F.expr(digests("_edited")))
    wide = F.struct("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), F.expr(fingerprint("units")).alias("fingerprint"), F.expr(fingerprint("_units")).alias("edited_fingerprint"), F.size("units").alias("a"), F.size("_units").alias("e"), F.size("next_units").alias("n"))
    rows = rows.select("bucket", "rn", "units", "_units", "next_units", wide.alias("wide"))
    rows = rows.withColumn("_blocks", F.expr(f"greatest(1L, cast(greatest(wide.a, wide.e, wide.n) as bigint) div {BLOCK})"))
    empty = f"cast(null as {rows.schema['wide'].dataType.simpleString()})"
    piece = lambda units, side: f"transform({units}, u -> named_struct('block', cast(shiftrightunsigned(u, 24) % _blocks as int), 'digest', u, 'side', {side}, 'wide', {empty}))"
    rows = rows.withColumn("_x", F.explode(F.expr(f"concat(array(named_struct('block', -1, 'digest', 0L, 'side', -1, 'wide', wide)), {piece('units', 0)}, {piece('_units', 1)}, {piece('next_units', 2)})")))
    rows = rows.select("bucket", "rn", "_x.block", "_x.digest", "_x.side", "_x.wide")
    blocks = rows.groupBy("bucket", "rn", "block").agg(F.collect_list(F.struct("digest", "side")).alias("pieces"), F.first("wide", ignorenulls=True).alias("wide"))
    blocks = blocks.withColumn("pieces", F.expr("filter(pieces, x -> x.side >= 0)"))
    blocks = _compare(_compare(blocks, 1, "by_edit"), 2, "by_next")
    sums = blocks.groupBy("bucket", "rn").agg(F.first("wide", ignorenulls=True).alias("w"), *[F.sum(f"{by}.{k}").alias(f"{by}_{k}") for by in ("by_edit", "by_next") for k in ("plus", "minus")])
    like = lambda by: F.when(F.col("w.a") + F.col(f"{by}_minus") == 0, F.lit(1.0)).otherwise((F.col("w.a") - F.col(f"{by}_plus")) / (F.col("w.a") + F.col(f"{by}_minus")))
    return sums.select("w.doc_id", "w.n_chars", "w.edited_sha256", "w.fingerprint", "w.edited_fingerprint", like("by_edit").alias("near_edited"), like("by_next").alias("near_next"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
