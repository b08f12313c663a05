"""MinHash near-dedup by an inverted join on signature coordinates.

A document is the set of its distinct shingles (n words, A-Z lowered; fewer
words: all of them as one). Equal sets form a class, and the class with the
smallest doc_id of its members is joined:

1. Its signature has K minima. A pair of Jaccard index `threshold` agrees on
   at least t coordinates but for a chance of 1e-6.
2. A class is posted under its coordinate-value pairs. Pairs that are rarer in
   the corpus come first; two classes with t common ones share one of the
   first (K - t + 1) of each, so only these are merged and the long lists are
   skipped but by classes that have too few short ones.
3. Within a list, collisions are counted on 8 bits a coordinate; pairs with t
   or more, and sizes that allow the threshold, are candidates. Long lists are
   cut into sublists by hash, and every member meets the list's first class.
4. Candidates are confirmed on full sets, the edge to a class's smallest
   candidate first; what is linked by then needs no further look.
5. Long lists whose members are still in several components are compared whole,
   in blocks: a first pass finds members with a candidate of another component,
   a second one carries their sets, confirms candidates where they meet and
   returns a spanning forest of the links, so fewer rows than a block has.

So each link between different texts is found or joins two classes that other
links have joined. No step emits all pairs of a group. Rows: null and empty
texts have no shingles and no links; so has a row without doc_id, which is
kept; repeated rows are in one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._graph import components
from ._store import free, staged, table
from ._tokens import release, tidy

COORDINATES = 32
MISS = 1e-6
#: Members of a list that are compared with each other at once; of a block.
SUBLIST = 16
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20

_FACTORS = T.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def match_threshold(jaccard: float, k: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t for which a pair of that index has fewer than t equal coordinates with a chance of `miss` at most."""
    tail, t = 0.0, 0
    while t < k:
        tail += math.comb(k, t) * jaccard**t * (1 - jaccard) ** (k - t)
        if tail > miss:
            break
        t += 1
    return max(1, t)


def shingles(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    buf, off = T.buffers(texts)
    low = T.LOWER[buf]
    starts, ends, first = T.words(low, off)
    h = T.span_hashes(low, starts, ends)
    g = T.grams(h, n)
    for i in range(len(off) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield T.mix(T.grams(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """doc_id, n (set size), x and y (128 bits of the set), tokens (coordinate-value pairs) and bits (8 of each)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("tokens", pa.list_(pa.int64())), ("bits", pa.binary())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in T.slices(batches, "_text"):
            rows = []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingles(batch.column(1), words), strict=True):
                if not len(s):
                    rows.append((doc_id, 0, 0, 0, None, None))
                    continue
                low = np.array([(s * f).min() for f in _FACTORS[:k]], np.uint64) >> np.uint64(32)
                tokens = (np.arange(k, dtype=np.int64) << 32) | low.astype(np.int64)
                m = T.mix(s)
                rows.append((doc_id, len(s), int(m.sum(dtype=np.uint64).view(np.int64)), int(T.mix(m + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), tokens, T.mix(low).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).mapInArrow(run, "doc_id bigint, n bigint, x bigint, y bigint, tokens array<bigint>, bits binary")


def _passing(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: np.ndarray, t: int, pct: int) -> np.ndarray:
    ok = 100 * np.minimum(n[a], n[b]) >= pct * np.maximum(n[a], n[b])
    a, b = a[ok], b[ok]
    near = (bits[a] == bits[b]).sum(1) >= t
    return np.stack([a[near], b[near]])


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


def _bits(batch: pa.RecordBatch, name: str = "bits") -> np.ndarray:
    got = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(got), np.uint8).reshape(len(got), -1)


def _list_pairs(t: int, pct: int):
    """Candidates within the sublists of sorted postings (list, sub, rep, n, bits); a sublist has a bounded length."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def pairs(part: pa.RecordBatch) -> pa.RecordBatch:
            tok, sub, rep, n = _arrays(part, "tok", "sub", "rep", "n")
            bits = _bits(part)
            edge = np.r_[True, (tok[1:] != tok[:-1]) | (sub[1:] != sub[:-1])]
            group = np.cumsum(edge)
            found, d = [], 1
            while d < len(rep):
                at = np.flatnonzero(group[d:] == group[:-d])
                if not len(at):
                    break
                found.append(_passing(at, at + d, n, bits, t, pct))
                d += 1
            got = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
            both = np.unique(np.stack([np.maximum(rep[got[0]], rep[got[1]]), np.minimum(rep[got[0]], rep[got[1]])], 1), axis=0)
            both = both[both[:, 0] != both[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tok, sub = _arrays(batch, "tok", "sub")
            last = int(np.searchsorted((tok != tok[-1]) | (sub != sub[-1]), False)) if (tok[0], sub[0]) == (tok[-1], sub[-1]) else int(np.flatnonzero((tok != tok[-1]) | (sub != sub[-1]))[-1]) + 1
            if last:  # the batch's last sublist may go on
                whole = pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks().to_batches()
                yield pairs(whole[0])
                rest = []
            rest.append(batch.slice(last))
        if rest:
            yield pairs(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])

    return run


def _block(table_: pa.Table) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, rep, n, component's number, and the rows of the two blocks) of a group (tok, i, j)."""
    batch = table_.combine_chunks().to_batches()[0]
    rep, n, comp, block, i, j = _arrays(batch, "rep", "n", "comp", "block", "i", "j")
    return batch, rep, n, np.unique(comp, return_inverse=True)[1], np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])


def _block_members(t: int, pct: int):
    """Of the two blocks of a group (tok, i, j): the members that are a candidate with one of another component."""

    def run(table_: pa.Table) -> pa.Table:
        batch, _, n, comp, left, right = _block(table_)
        bits = _bits(batch)
        near = np.zeros(len(n), bool)
        for a in left:
            b = right[comp[right] != comp[a]]
            got = _passing(np.full(len(b), a), b, n, bits, t, pct)
            near[got[1]] = True
            near[a] |= got.shape[1] > 0
        return pa.Table.from_batches([batch.filter(pa.array(near))])

    return run


def _block_links(t: int, pct: int):
    """Links between the two blocks of a group (tok, i, j), confirmed on full sets: a spanning forest of the components."""

    def run(table_: pa.Table) -> pa.Table:
        batch, rep, n, comp, left, right = _block(table_)
        bits = _bits(batch)
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(batch.schema.get_field_index("set")).to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        place = np.unique(np.concatenate(sets), return_inverse=True)[1]
        has = np.zeros(place.max() + 1, bool)
        out = []
        for a in left:
            b = right[comp[right] != comp[a]]
            b = _passing(np.full(len(b), a), b, n, bits, t, pct)[1]
            if not len(b):
                continue
            own = place[first[a] : first[a + 1]]
            has[own] = True
            common = np.add.reduceat(has[place[T.ragged(first[b], n[b])]].astype(np.int64), np.cumsum(n[b]) - n[b])
            has[own] = False
            for c in b[100 * common >= pct * (n[a] + n[b] - common)]:
                if comp[c] != comp[a]:
                    out.append((max(rep[a], rep[c]), min(rep[a], rep[c])))
                    comp[comp == comp[c]] = comp[a]
        got = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    return run


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(rep, set) of texts: the sorted shingle hashes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingles(batch.column(1), words)], pa.binary())], names=["rep", "set"])

    return texts.select("rep", "text").mapInArrow(run, "rep bigint, set binary")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, pct: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "u", 2 << 20):
            u, v = shingles(batch.column(2), words), shingles(batch.column(3), words)
            ok = []
            for p, q in zip(u, v, strict=True):
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(len(p) > 0 and 100 * common >= pct * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    one = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("v")), "b")
    both = one.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("u")), "a")
    return both.select("a", "b", "u", "v").mapInArrow(run, "a bigint, b bigint")


def _rarest(reps: DataFrame, t: int) -> DataFrame:
    """(rep, tok): of the tokens that a class has in common with others the first that t common ones can't all miss, rarest first.

    Spark takes a table of exploded arrays for as small as the arrays' rows and
    would send the counts, some for each class, through the driver: so both
    sides are shuffled.
    """
    posts = reps.select("rep", F.explode("tokens").alias("tok"))
    often = posts.groupBy("tok").agg(F.count("*").alias("often")).where("often > 1")
    shared = posts.join(often.hint("merge"), "tok").groupBy("rep").agg(F.collect_list(F.struct("often", "tok")).alias("all")).where(F.size("all") >= t)
    return shared.select("rep", F.explode(F.slice(F.array_sort("all"), 1, F.size("all") - t + 1)).alias("p")).select("rep", "p.tok")


def classes(docs: DataFrame, *, words: int, percent: int, k: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    t = match_threshold(percent / 100, k)
    sketch = staged(sketches(docs, words, k), "sketches")
    whole = sketch.where("n > 0 and doc_id is not null")
    reps = staged(whole.groupBy("n", "x", "y").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits")), "classes")

    first = _rarest(reps, t)
    lists = first.join(reps.select("rep", "n", "bits"), "rep")
    length = first.groupBy("tok").agg(F.count("*").alias("length")).where("length > 1")
    lists = staged(lists.join(length, "tok"), "postings")

    cut = F.expr(f"cast(pow(2, greatest(0, ceil(log2(length / {SUBLIST // 2})))) as bigint)")
    subs = lists.withColumn("sub", F.when(F.col("length") <= SUBLIST, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("rep"), cut)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    subs = subs.select("tok", "sub", "rep", "n", "bits").repartition(parts, "tok", "sub").sortWithinPartitions("tok", "sub", "rep")
    near = subs.mapInArrow(_list_pairs(t, percent), "a bigint, b bigint")
    long = lists.where(F.col("length") > SUBLIST)
    pivot = long.groupBy("tok").agg(F.min(F.struct("rep", "n", "bits")).alias("p"))
    star = long.join(pivot, "tok").where("rep <> p.rep")
    same = " + ".join(f"if(substring(bits, {i}, 1) = substring(p.bits, {i}, 1), 1, 0)" for i in range(1, k + 1))
    star = star.where(f"100 * least(n, p.n) >= {percent} * greatest(n, p.n) and {same} >= {t}")
    near = staged(near.unionByName(star.select(F.greatest("rep", "p.rep").alias("a"), F.least("rep", "p.rep").alias("b"))).distinct(), "candidates")

    sizes = reps.select("rep", "n", "x", "y")
    wanted = near.select(F.col("a").alias("rep")).union(near.select("b")).distinct().join(sizes, "rep")
    texts = staged(_texts(docs, wanted, words), "texts")

    nearest = near.groupBy("a").agg(F.min("b").alias("b"))
    links = staged(_confirm(nearest, texts, words, percent), "links")
    found = components(links)
    more = _apart(near, found)
    links = links.unionByName(staged(_confirm(more, texts, words, percent), "links"))
    found = staged(components(links), "components")

    member = long.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("tok", "rep", "n", "bits", F.coalesce("component", "rep").alias("comp"))
    apart = member.groupBy("tok").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_m"), F.sum("n").alias("_s")).where("_lo < _hi")
    apart = apart.select("tok", F.greatest(F.ceil(F.col("_m") / BLOCK), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = member.join(apart, "tok").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def met(rows: DataFrame, extra: list[str]) -> DataFrame:
        """Each row once for every two blocks that it is in; few bytes, much work: not for AQE to coalesce."""
        dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return dealt.select("tok", "rep", "n", "bits", "comp", "block", "blocks", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), *extra).repartition(parts, "tok", "i", "j")

    dealt = met(member, [])
    kept = staged(dealt.groupBy("tok", "i", "j").applyInArrow(_block_members(t, percent), dealt.schema), "members").drop("i", "j").distinct()
    kept = staged(kept, "members")
    if not kept.isEmpty():
        wanted = kept.select("rep").distinct().join(sizes, "rep")
        sets = staged(_sets(_texts(docs, wanted, words), words), "sets")
        rest = met(kept.join(sets, "rep"), ["set"]).groupBy("tok", "i", "j").applyInArrow(_block_links(t, percent), "a bigint, b bigint")
        links = links.unionByName(staged(rest.distinct(), "links"))
        found = staged(components(links), "components")

    by_class = reps.select("n", "x", "y", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "x", "y", F.coalesce("component", "rep").alias("component_id"))
    joined = sketch.select("doc_id", "n", "x", "y").where("n > 0 and doc_id is not null").join(by_class, ["n", "x", "y"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sketch.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that no component holds."""
    a, b = found.select(F.col("node").alias("a"), F.col("component").alias("_ca")), found.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(_ca, a) <> coalesce(_cb, b)").select("a", "b")


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, text) of the wanted classes: of the rows with that id, one whose set is the class's."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            n, x = _arrays(batch, "n", "x")
            ok = [len(s) == n[i] and int(T.mix(s).sum(dtype=np.uint64).view(np.int64)) == x[i] for i, s in enumerate(shingles(batch.column(1), words))]
            yield batch.select(["rep", "text"]).filter(pa.array(ok, pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep").select("rep", "text", "n", "x")
    return rows.mapInArrow(run, "rep bigint, text string").dropDuplicates(["rep"])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which each group keeps one: that with the smallest doc_id. Rows of one doc_id with different texts count as different documents."""
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _keep_by_text(docs, words, percent)
    found = classes(docs, words=words, percent=percent)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(gone.alias("gone"), docs["doc_id"].cast("long") == F.col("gone.doc_id"), "left_anti")


def _keep_by_text(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """keep() by the hash of doc_id and text; of rows that are equal in both, one is left."""
    names = docs.columns
    row, key, id_ = free(names, "_row", "_key", "_id")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias(key), F.col("doc_id").alias(id_), F.col("text").alias("text"))
    named = own.where(F.col(key).isNotNull())
    found = classes(named.select(F.col(key).alias("doc_id"), "text"), words=words, percent=percent).select(F.col("doc_id").alias(key), "component_id")
    group = found.join(named.select(key, id_), key).groupBy("component_id").agg(F.min(F.struct(id_, key)).alias("_m"))
    left = named.join(group.select(F.col(f"_m.{key}").alias(key)), key, "left_semi").dropDuplicates([key])
    return left.unionByName(own.where(F.col(key).isNull())).select(*[F.col(f"{row}.`{c}`") for c in names])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs)
