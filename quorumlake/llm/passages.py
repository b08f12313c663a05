"""Substring dedup by collinear chaining: fuzzy passages that documents share.

Words are lower-cased (A-Z). Seeds are hashes of k words in a row, thinned by
winnowing: of every `window` seeds in a row the smallest is kept, so that
an exact passage of window + k - 1 words keeps one at least. The two documents
of smallest id that have a seed are its leaders, and every other holder is
matched with both (the second leader with the first), so that a seed in n
documents makes fewer than 2n matches. Every place of a seed in a document is
matched, with one place of each leader. An Arrow batch packs the places of one
seed in one row before the shuffle; which documents lead doesn't depend on
batches or partitions.

The matches of a document with a leader are chained: the best chain that
ends in a match is that match and the best chain before it in both texts, less
a cost by the words between them; a Fenwick tree over the other text's places
finds the latter. Chains are aligned on the words: equal stretches are
extended at both ends, gaps between seeds are edited at least cost. A passage
of at least `min_words` words, of which `identity` are equal, is a result.

Exact passages don't hang on seeds: every run of `min_words` words that a
smaller document has is covered. Longer grams, winnowed so that each such run
holds one at least, go along with the seeds. Of those that several documents
have, the ones with a run that no chained passage covers are needy; where a
document has a needy gram, all runs of `min_words` words around it are hashed,
and each is matched with its own first holder. Runs on one diagonal are joined.
Of those that a passage of the same two documents holds, or that overlap
others, as many are left out as keep every word covered.

Seeds that three documents or more have leave fuzzy passages of documents that
don't lead unmatched. Their places that no passage covers are matched once
more: hashes of two or three places of MIN_SPAN words apart, which far fewer documents
share, are posted like seeds, and what they chain is aligned like the rest.

Rows: a null or empty text has no passages; a row without doc_id takes no part;
of rows with one doc_id and different texts the least text takes part (the
pipeline's stage treats them as documents of their own). An empty table has no
passages. Columns other than doc_id and text aren't read. Texts are moved to
where stretches of them are asked for, those of other documents aren't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._store import free, staged, table
from ._tokens import release, tidy

K = 5
WINDOW = 12
MIN_WORDS = 50
IDENTITY = 0.8
#: Most words between two seeds of a passage; a seed's worth in words of gap, both texts together.
MAX_GAP = 80
WORTH = 160
#: Words around a chain that are looked at; stretches are asked for in steps of STEP words.
PAD = 48
STEP = 32
#: Places of a key that a packed row holds.
PACK = 256

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _low(g: np.ndarray, window: int) -> np.ndarray:
    """The least of every `window` values in a row."""
    size = 1
    while 2 * size <= window:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - window + size], g[window - size :])


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Places of the values that are the least of some `window` in a row."""
    if len(g) <= window:
        return np.flatnonzero(g == g.min()) if len(g) else np.empty(0, np.int64)
    low = _low(g, window)
    edge = np.zeros(window - 1, np.uint64)
    high = ~_low(~np.concatenate([edge, low, edge]), window)
    return np.flatnonzero(high == g)


def _shape(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _first_holders(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, doc, pos; for each place in it the place of the key's first row)."""
    order = np.lexsort((pos, doc, key))
    k = key[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return order, np.repeat(start, np.diff(np.r_[start, len(k)]))


#: Kinds of packed rows: seeds, of which holders are matched with leaders, and grams, whose places are told if several documents have them.
SEED, GRAM = 0, 1
#: Kind of rows after chaining that list a document's places of seeds which three documents or more have, and how its composite seeds skip places.
COMMON = 2
#: Composites of fewer words than MIN_SPAN are as frequent as the line that they stand in.
MIN_SPAN = 20
STEPS = ((1,), (2,), (3,), (4,), (1, 2), (1, 3), (2, 3), (2, 4))
_PACKED = "kind int, key bigint, doc bigint, pos bigint, more binary"
_POST = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("more", pa.binary())])
_PLACE = np.dtype([("doc", "<i8"), ("pos", "<i4")])


def _packed(kind: int, key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """A row a key and PACK places, in order: the first place, and the others as bytes."""
    order, head = _first_holders(key, doc, pos)
    key, doc, pos = key[order], doc[order], pos[order]
    first = (np.arange(len(head)) - head) % PACK == 0
    rest = np.empty(int((~first).sum()), _PLACE)
    rest["doc"], rest["pos"] = doc[~first], pos[~first]
    lead = np.flatnonzero(first)
    ends = np.cumsum(np.diff(np.r_[lead, len(key)]) - 1) * _PLACE.itemsize
    more = pa.Array.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(rest.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(lead), kind, np.int32)), *(pa.array(x[lead]) for x in (key, doc, pos)), more], schema=_POST)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, doc, pos) of all places of packed rows."""
    more = batch.column(4)
    _, offsets, data = more.buffers()
    off = np.frombuffer(offsets, np.int32)[more.offset : more.offset + len(more) + 1]
    rest = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(_PLACE) if data is not None and data.size else np.empty(0, _PLACE)
    many = np.diff(off) // _PLACE.itemsize + 1
    row = np.repeat(np.arange(len(many)), many)
    first = np.cumsum(many) - many
    doc, pos = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    others = np.ones(len(row), bool)
    others[first] = False
    doc[first], pos[first] = batch.column(2).to_numpy(), batch.column(3).to_numpy()
    doc[others], pos[others] = rest["doc"], rest["pos"]
    return row, doc, pos


def _picked(batch: pa.RecordBatch, hashes: np.ndarray, first: np.ndarray, k: int, least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(key, doc, pos) of the winnowed grams of k words in the documents of `least` words or more."""
    keys, docs, poss = [], [], []
    for i, doc_id in enumerate(batch.column(0).to_pylist()):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= least:
            at = winnow(hashes[a : b - k + 1], window)
            keys.append(hashes[a + at])
            poss.append(at)
            docs.append(np.full(len(at), doc_id, np.int64))
    return (np.concatenate(keys).view(np.int64), np.concatenate(docs), np.concatenate(poss)) if keys else None


def _seeds(k: int, window: int, n: int, wide_k: int):
    """Packed seeds of k words, and packed grams of wide_k words of which every n words in a row hold one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in T.slices(batches, "_text"):
            buf, off = T.buffers(batch.column(1))
            low = T.LOWER[buf]
            starts, ends, first = T.words(low, off)
            h = T.span_hashes(low, starts, ends)
            for kind, got in ((SEED, _picked(batch, T.grams(h, k), first, k, k, window)), (GRAM, _picked(batch, wide(h, wide_k), first, wide_k, n, n - wide_k + 1))):
                if got:
                    yield _packed(kind, *got)

    return run


_LINK = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("pos", pa.int64()), ("ref", pa.int64()), ("at", pa.int64())])
_LINKS = "kind int, doc bigint, pos bigint, ref bigint, at bigint"
_NONE = np.iinfo(np.int64).max


def _match(leaders: int):
    """Packed rows, sorted by kind, key and doc, to links (kind SEED; doc, pos, ref, at) and to places of grams that several documents have (kind GRAM; doc, pos, 0, key).

    Rows of a key come by their smallest document, so the first two of them
    tell the leaders; a key with one row at a batch's end waits for the next.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        known: tuple | None = None  # kind, key, leaders (doc, pos, doc, pos) and places not told yet, of the last key

        def solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal known
            kind, key = (batch.column(c).to_numpy() for c in (0, 1))
            row, doc, pos = _unpacked(batch)
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])
            group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(key)]))[row]
            place = np.searchsorted(group, np.arange(len(start)))
            least = lambda some, value: np.minimum.reduceat(np.where(some, value, _NONE), place)
            d1 = np.minimum.reduceat(doc, place)
            on = known is not None and known[:2] == (kind[0], key[0])
            if on:
                d1[0] = min(d1[0], known[2])
            p1 = least(doc == d1[group], pos)
            d2 = least(doc != d1[group], doc)
            if on:
                p1[0] = min(p1[0], known[3]) if d1[0] == known[2] else p1[0]
                d2[0] = min(d2[0], known[4])
            p2 = least(doc == d2[group], pos)
            if on and d2[0] == known[4]:
                p2[0] = min(p2[0], known[5])
            k, g = kind[start][group], group
            for d, p, some in ((d1, p1, (k == SEED) & (doc != d1[g])), (d2, p2, (k == SEED) & (doc > d2[g])))[:leaders]:
                if some.any():
                    yield _shape(_LINK, [np.zeros(some.sum(), np.int32), doc[some], pos[some], d[g][some], p[g][some]])
            told = (k == GRAM) & (d2[g] < _NONE)
            late = known[6] if on and d2[0] < _NONE else np.empty((2, 0), np.int64)
            if told.any() or late.size:
                both = np.concatenate([late, np.stack([doc[told], pos[told]])], 1)
                of = np.r_[np.full(late.shape[1], key[0]), key[start][g][told]]
                yield _shape(_LINK, [np.full(len(of), GRAM, np.int32), both[0], both[1], np.zeros(len(of), np.int64), of])
            last = g == len(start) - 1
            wait = np.empty((2, 0), np.int64)
            if kind[-1] == GRAM and d2[-1] == _NONE:
                wait = np.stack([doc[last], pos[last]])
                if on and len(start) == 1:
                    wait = np.concatenate([known[6], wait], 1)
            known = (kind[-1], key[-1], d1[-1], p1[-1], d2[-1], p2[-1], wait)

        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            if not batch.num_rows:
                continue
            kind, key = (batch.column(c).to_numpy() for c in (0, 1))
            alone = batch.num_rows == 1 or (kind[-1], key[-1]) != (kind[-2], key[-2])
            if alone and (known is None or batch.num_rows > 1 or known[:2] != (kind[-1], key[-1])):
                held = batch.slice(batch.num_rows - 1)
                batch = batch.slice(0, batch.num_rows - 1)
            if batch.num_rows:
                yield from solve(batch)
        if held is not None:
            yield from solve(held)

    return run


def _matched(packed: DataFrame, leaders: int) -> DataFrame:
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(parts, "key").sortWithinPartitions("kind", "key", "doc").mapInArrow(_match(leaders), _LINKS)


def wide(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n neighbours, from those of half as many."""
    total = len(h) - n + 1
    if total <= 0:
        return np.empty(0, np.uint64)
    out, have, part, size = np.zeros(total, np.uint64), 0, h, 1
    while True:
        if n & size:
            out = T.mix(out * np.uint64(0x9FB21C651E98DF25) + part[have : have + total])
            have += size
        if have == n:
            return out
        part = T.mix(part[:-size] * np.uint64(0xD6E8FEB86659FD93) + part[size:])
        size *= 2


def _needy(n: int, k: int):
    """(key, doc, pos, needy) of places xs with keys ys: needy is one around which not all words are in spans."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("needy", pa.bool_())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, xs, ys, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.array(xs, np.int64)
                reach = np.empty((2, 0), np.int64)
                if spans:
                    reach = np.array(sorted((x["start_word"], _NONE if x["end_word"] == x["doc_words"] else x["end_word"]) for x in spans), np.int64).T
                    top = np.maximum.accumulate(reach[1])
                    new = np.r_[True, reach[0, 1:] > top[:-1]]
                    reach = np.stack([reach[0, new], np.maximum.reduceat(reach[1], np.flatnonzero(new))])
                i = np.searchsorted(reach[0], np.maximum(0, at - (n - k)), "right") - 1
                inside = (reach[1, i] >= at + n) & (i >= 0) if reach.shape[1] else np.zeros(len(at), bool)
                yield _shape(schema, [ys, np.full(len(at), doc, np.int64), at, ~inside])

    return run


def _exact(n: int, k: int):
    """Packed seeds of n words around places whose gram of k words is the least of theirs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "_text"):
            buf, off = T.buffers(batch.column(1))
            low = T.LOWER[buf]
            starts, ends, first = T.words(low, off)
            h = T.span_hashes(low, starts, ends)
            g, short = wide(h, n), wide(h, k)
            if not len(g):
                continue
            places = batch.column(2)
            many, at = np.diff(places.offsets.to_numpy()), places.flatten().to_numpy()
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.repeat(first[:-1], many) + at
            again = np.full(len(short), T._MASK, np.uint64)
            at = at[at < len(short)]
            again[at] = short[at]
            pos = np.flatnonzero(_low(short, n - k + 1) == _low(again, n - k + 1))  # winnowing keeps the least gram of each n words
            pos = pos[pos + n <= first[np.searchsorted(first, pos, "right")]]
            if len(pos):
                doc = np.searchsorted(first, pos, "right") - 1
                yield _packed(SEED, g[pos].view(np.int64), ids[doc], pos - first[doc])

    return run


_ROW = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int64()), ("ref_end", pa.int64()), ("n_words", pa.int64()), ("identity", pa.float64())])
_ROWS = "doc_id bigint, start_word bigint, end_word bigint, ref_doc_id bigint, ref_start bigint, ref_end bigint, n_words bigint, identity double"


def _runs(n: int):
    """Links of n words, by document, other document and diagonal, to the passages that they make."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # doc, ref, diagonal, start, end of the last passage
        out = lambda m: _shape(_ROW, [m[0], m[3], m[4], m[1], m[3] - m[2], m[4] - m[2], m[4] - m[3], np.ones(m.shape[1])])
        for batch in batches:
            if not batch.num_rows:
                continue
            _, doc, pos, ref, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            m = np.stack([doc, ref, pos - at, pos, pos + n])
            if held is not None:
                m = np.concatenate([held, m], 1)
            start = np.flatnonzero(np.r_[True, (m[:3, 1:] != m[:3, :-1]).any(0) | (m[3, 1:] > m[4, :-1])])
            m = np.concatenate([m[:4, start], np.maximum.reduceat(m[4], start)[None]])
            held = m[:, -1:]
            if m.shape[1] > 1:
                yield out(m[:, :-1])
        if held is not None:
            yield out(held)

    return run


def cover(spans: list[tuple[int, int]], beside: list[tuple[int, int]]) -> list[int]:
    """Numbers of spans (by start, longest first) that cover all words of spans, as few as do; those inside one of `beside` aren't needed."""
    out: list[int] = []
    until, best = -1, -1
    reach, k, beside = -1, 0, sorted(beside)
    for i, (s, e) in enumerate(spans):
        while k < len(beside) and beside[k][0] <= s:
            reach = max(reach, beside[k][1])
            k += 1
        if e <= reach:
            continue
        if best >= 0 and s > until:
            out.append(best)
            until, best = spans[best][1], -1
        if e > until and (best < 0 or e > spans[best][1]):
            best = i
    return [*out, best] if best >= 0 else out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages, chained and exact ones, in order of both documents, start and longest first: the chained ones and the needed exact ones."""
    rows: list[tuple] = []

    def needed() -> list[tuple]:
        chained, exact = [r[:-1] for r in rows if not r[-1]], [r[:-1] for r in rows if r[-1]]
        return chained + [exact[i] for i in cover([r[1:3] for r in exact], [r[1:3] for r in chained])]

    for batch in batches:
        out = []
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (rows[0][0], rows[0][3]) != (r[0], r[3]):
                out += needed()
                rows = []
            rows.append(r)
        if out:
            yield _shape(_ROW, list(zip(*out, strict=True)))
    if rows:
        yield _shape(_ROW, list(zip(*needed(), strict=True)))


def chain(x: list[int], y: list[int]) -> list[list[int]]:
    """Collinear chains of matches (x ascending), best first; each match is in one chain at most."""
    n = len(x)
    places = {v: k + 1 for k, v in enumerate(sorted(set(y)))}
    size = len(places)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    done = 0
    for i in range(n):
        while x[done] < x[i]:  # matches at the same place don't follow each other
            value, k = (score[done] + (x[done] + y[done]) / WORTH, done), places[y[done]]
            while k <= size:
                if value > tree[k]:
                    tree[k] = value
                k += k & -k
            done += 1
        best, k = (-1e18, -1), places[y[i]] - 1
        while k:
            if tree[k] > best:
                best = tree[k]
            k -= k & -k
        gain = best[0] - (x[i] + y[i]) / WORTH
        score[i] = 1.0
        if best[1] >= 0 and gain > 0:
            score[i] += gain
            before[i] = best[1]
    used = [False] * n
    out = []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        part = []
        while i >= 0 and not used[i]:
            used[i] = True
            part.append(i)
            i = before[i]
        part.reverse()
        piece = part[:1]
        for a, b in zip(part, part[1:], strict=False):
            if x[b] - x[a] > MAX_GAP + K or y[b] - y[a] > MAX_GAP + K:
                out.append(piece)
                piece = []
            piece.append(b)
        if piece:
            out.append(piece)
    return out


def _chains(min_words: int):
    least = max(1, min_words - 2 * PAD)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("ref", pa.int64()), ("xs", pa.list_(pa.int64())), ("ys", pa.list_(pa.int64()))])
        rest: list[np.ndarray] = []
        open_: list[np.ndarray] = []  # links of the last document

        def shared(m: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Places of whole documents with links to both leaders of their seed; the first leader's place names the seed."""
            doc, ref, pos, at = m[:, np.lexsort((m[3], m[1], m[2], m[0]))]
            two = np.flatnonzero((doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1]) & (ref[1:] != ref[:-1]))
            two = two[np.r_[True, (doc[two[1:]] != doc[two[:-1]]) | (pos[two[1:]] != pos[two[:-1]])]] if len(two) else two
            if len(two):
                name = T.mix(T.mix(ref[two].view(np.uint64)) + at[two].view(np.uint64)).view(np.int64)
                yield listed(COMMON, doc[two], pos[two], name)

        def listed(kind: int, doc: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[start, len(doc)].astype(np.int32)), pa.array(x)) for x in (xs, ys)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(start), kind, np.int32)), pa.array(doc[start]), pa.array(np.zeros(len(start), np.int64)), *lists], schema=schema)

        def solve(m: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.r_[True, (m[0, 1:] != m[0, :-1]) | (m[1, 1:] != m[1, :-1]), True])
            rows = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a < 2:
                    continue
                x, y = m[2, a:b].tolist(), m[3, a:b].tolist()
                for part in chain(x, y):
                    if len(part) > 1 and x[part[-1]] - x[part[0]] >= least:
                        rows.append((SEED, m[0, a], m[1, a], [x[i] for i in part], [y[i] for i in part]))
            if rows:
                yield _shape(schema, list(zip(*rows, strict=True)))

        for batch in batches:
            m = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 3, 2, 4)])
            gram = batch.column(0).to_numpy(zero_copy_only=False) == GRAM
            if gram.any():
                doc, _, pos, key = m[:, gram]
                yield listed(GRAM, doc, pos, key)
            m = m[:, ~gram]
            if not m.shape[1]:
                continue
            own = np.flatnonzero(m[0] != m[0, -1])
            whole = int(own[-1]) + 1 if len(own) else 0
            if whole or (open_ and open_[-1][0, -1] != m[0, 0]):
                yield from shared(np.concatenate([*open_, m[:, :whole]], 1))
                open_ = []
            open_.append(m[:, whole:])
            new = np.flatnonzero((m[0] != m[0, -1]) | (m[1] != m[1, -1]))
            last = int(new[-1]) + 1 if len(new) else 0
            if last or (rest and (rest[-1][:2, -1] != m[:2, 0]).any()):
                yield from solve(np.concatenate([*rest, m[:, :last]], 1))
                rest = []
            rest.append(m[:, last:])
        if rest:
            yield from solve(np.concatenate(rest, 1))
        if open_:
            yield from shared(np.concatenate(open_, 1))

    return run


def _composites(ways: tuple[tuple[int, ...], ...]):
    """Packed composite seeds of (doc, xs, ys, spans): several neighbours, by each of the ways to skip, of the common places that no span covers."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, poss = [], [], []
            for doc, xs, ys, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.array(xs, np.int64), np.array(ys, np.int64).view(np.uint64)
                for s in spans or ():
                    out = (x < s["start_word"]) | (x + K > s["end_word"])
                    x, y = x[out], y[out]
                for steps in ways:
                    n = len(x) - steps[-1]
                    if n <= 0:
                        continue
                    key = y[:n]
                    for step in steps:
                        key = T.mix(key * np.uint64(0x9FB21C651E98DF25) + y[step : n + step])
                    apart = x[steps[-1] :] - x[:n]
                    near = (apart <= MAX_GAP) & (apart >= MIN_SPAN)
                    keys.append(key[near])
                    poss.append(x[:n][near])
                    docs.append(np.full(int(near.sum()), doc, np.int64))
            if keys and sum(map(len, keys)):
                yield _packed(SEED, np.concatenate(keys).view(np.int64), np.concatenate(docs), np.concatenate(poss))

    return run


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words of two short stretches in order, at most: the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for u in a.tolist():
        left = 0
        for k, v in enumerate(b.tolist()):
            above = row[k + 1]
            row[k + 1] = left + 1 if u == v else max(above, row[k])
            left = above
    return row[-1]


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(words of a and of b to extend by, equal ones): the best prefix without gaps, then the best one with gaps.

    Without gaps an equal word counts 1, another -2. With gaps the score of two
    prefixes is three times their longest common subsequence less their lengths,
    over at most PAD words, and only where half of the first 16 stand near each other.
    """
    n, k, equal = min(len(a), len(b)), 0, 0
    if n:
        same = a[:n] == b[:n]
        total = np.cumsum(np.where(same, 1, -2))
        best = int(np.argmax(total))
        if total[best] > 0:
            k = best + 1
            equal = int(same[:k].sum())
    u, v = a[k : k + PAD], b[k : k + PAD]
    near = min(16, len(u), len(v))
    if near < K or 2 * len(set(u[:near].tolist()) & set(v[: near + 8].tolist())) < near:
        return k, k, equal
    lcs = np.zeros((len(u) + 1, len(v) + 1), np.int64)
    for i, word in enumerate(u):
        lcs[i + 1, 1:] = np.maximum.accumulate(np.maximum(lcs[i, 1:], lcs[i, :-1] + (v == word)))
    score = 3 * lcs - np.arange(len(u) + 1)[:, None] - np.arange(len(v) + 1)
    i, j = divmod(int(np.argmax(score)), len(v) + 1)
    return k + i, k + j, equal + int(lcs[i, j])


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int = K) -> tuple[int, int, int, int, int]:
    """(start, end) in a, (start, end) in b and equal words of the passage around a chain's seeds."""
    left, below, same = _reach(a[: xs[0]][::-1], b[: ys[0]][::-1])
    x, y = int(xs[0]), int(ys[0])
    for u, v in zip(xs.tolist(), ys.tolist(), strict=True):
        if u > x and v > y:
            if u - x == v - y:
                same += int((a[x:u] == b[y:v]).sum())
            else:
                same += _edits(a[x:u], b[y:v])
        new = min(u + k - max(x, u), v + k - max(y, v)) if u + k > x and v + k > y else 0
        same += max(0, new)
        x, y = max(x, u + k), max(y, v + k)
    right, above, more = _reach(a[x:], b[y:])
    return int(xs[0]) - left, x + right, int(ys[0]) - below, y + above, same + more


def _hashes(text: bytes) -> np.ndarray:
    buf = T.LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = T.words(buf, np.array([0, len(buf)]))
    return T.span_hashes(buf, starts, ends)


def passages(docs: DataFrame, *, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """doc_id, start_word, end_word, ref_doc_id, ref_start, ref_end, n_words, identity: a row a passage of a document that ref_doc_id, a smaller id, has too. Ends are exclusive."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).where("_id is not null and _text is not null")
    if not plain.groupBy("_id").count().where("count > 1").isEmpty():
        plain = staged(plain.groupBy("_id").agg(F.min("_text").alias("_text")), "passage-texts")
    gram = min_words // 2 + 1
    first = _chained(plain.mapInArrow(_seeds(k, window, min_words, gram), _PACKED), min_words)
    chained = _aligned(plain, first.where(F.col("kind") == SEED), k, min_words, identity)
    # seeds that many documents have were matched with their leaders only: what is left of them is matched again, several together
    common = _beside(first.where(F.col("kind") == COMMON).where("size(xs) > 1"), chained)
    again = _chained(common.mapInArrow(_composites(STEPS), _PACKED), min_words)
    chained = chained.unionByName(_aligned(plain, again.where(F.col("kind") == SEED), k, min_words, identity)).distinct()
    places = _beside(first.where(F.col("kind") == GRAM), chained)
    places = staged(places.mapInArrow(_needy(min_words, gram), "key bigint, doc bigint, pos bigint, needy boolean"), "places")
    runs = exact(plain, places, min_words, gram)
    both = chained.drop("doc_words").withColumn("_exact", F.lit(False)).unionByName(runs.withColumn("_exact", F.lit(True)))
    return both.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "ref_doc_id", "start_word", F.desc("end_word")).mapInArrow(_joined, _ROWS)


def _chained(packed: DataFrame, min_words: int) -> DataFrame:
    """Chains of packed seeds (kind SEED), and lists of places of grams and of common seeds."""
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = _matched(packed, 2).repartition(parts, "doc").sortWithinPartitions("doc", "kind", "ref", "pos", "at")
    return staged(links.mapInArrow(_chains(min_words), "kind int, doc bigint, ref bigint, xs array<bigint>, ys array<bigint>"), "chains")


def _beside(places: DataFrame, chained: DataFrame) -> DataFrame:
    """doc, xs, ys, spans: listed places with the passages of their document."""
    spans = chained.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start_word", "end_word", "doc_words")).alias("spans"))
    return places.select("doc", "xs", "ys").join(spans, "doc", "left").select("doc", "xs", "ys", "spans")


def _aligned(plain: DataFrame, found: DataFrame, k: int, min_words: int, identity: float) -> DataFrame:
    """The passages of chains, with the number of words of their document."""
    lo = lambda c: F.expr(f"greatest(0L, {c}[0] - {PAD}) div {STEP} * {STEP}")
    hi = lambda c: F.expr(f"({c}[size({c}) - 1] + {k + PAD + STEP - 1}) div {STEP} * {STEP}")
    found = found.select("doc", "ref", "xs", "ys", lo("xs").alias("doc_lo"), hi("xs").alias("doc_hi"), lo("ys").alias("ref_lo"), hi("ys").alias("ref_hi"))

    asked = found.select(F.col("doc").alias("id"), F.col("doc_lo").alias("lo"), F.col("doc_hi").alias("hi")).union(found.select("ref", "ref_lo", "ref_hi")).distinct()
    asked = asked.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    @tidy
    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "_text"):
            buf, off = T.buffers(batch.column(1))
            starts, ends, first = T.words(buf, off)
            rows = []
            for i, (doc_id, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                a, b = int(first[i]), int(first[i + 1])
                for s in spans:
                    p, q = a + s["lo"], min(a + s["hi"], b)
                    if q > p:
                        rows.append((doc_id, s["lo"], s["hi"], buf[starts[p] : ends[q - 1]].tobytes(), b - a))
            if rows:
                yield _shape(pa.schema([("id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("words", pa.binary()), ("total", pa.int64())]), list(zip(*rows, strict=True)))

    words = _texts(plain, asked, "spans").mapInArrow(stretch, "id bigint, lo bigint, hi bigint, words binary, total bigint")
    words = staged(words, "stretches")
    side = lambda c: words.select(F.col("id").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi"), F.col("words").alias(f"{c}_words"), F.col("total").alias(f"{c}_total"))
    pairs = found.join(side("doc"), ["doc", "doc_lo", "doc_hi"]).join(side("ref"), ["ref", "ref_lo", "ref_hi"])
    pairs = pairs.select("doc", "ref", "doc_lo", "ref_lo", "xs", "ys", "doc_words", "ref_words", "doc_total")

    @tidy
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, ref, doc_lo, ref_lo, xs, ys, u, v, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q, s, t, same = align(_hashes(u), _hashes(v), np.array(xs) - doc_lo, np.array(ys) - ref_lo, k)
                n = min(q - p, t - s)
                share = same / max(q - p, t - s)
                if n >= min_words and share >= identity:
                    rows.append((doc, doc_lo + p, doc_lo + q, ref, ref_lo + s, ref_lo + t, q - p, share, total))
            if rows:
                yield _shape(_ROW.append(pa.field("doc_words", pa.int64())), list(zip(*rows, strict=True)))

    return staged(pairs.mapInArrow(aligned, f"{_ROWS}, doc_words bigint").distinct(), "chained")


def _texts(plain: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """_id, _text and asked's column, of the asked ids. Ids alone are joined first: where Spark finds them small enough to broadcast, no other text is moved."""
    some = plain.join(asked.select(F.col("id").alias("_id")), "_id", "left_semi")
    return some.join(asked, some["_id"] == asked["id"]).select("_id", "_text", column)


def exact(plain: DataFrame, places: DataFrame, n: int, k: int) -> DataFrame:
    """Passages of n words at least, equal word by word, that cover all runs of n words around places (key, doc, pos, needy) with a needy key that a smaller id has too."""
    parts = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needy = staged(places.where("needy").select("key").distinct(), "needy-grams")  # staged, so that a skewed side of the join can be split
    asked = places.join(needy, "key", "left_semi")
    asked = staged(asked.groupBy(F.col("doc").alias("id")).agg(F.collect_list("pos").alias("at")), "places-asked")
    links = _matched(_texts(plain, asked, "at").mapInArrow(_exact(n, k), _PACKED), 1)
    return links.repartition(parts, "doc").sortWithinPartitions("doc", "ref", F.col("pos") - F.col("at"), "pos").mapInArrow(_runs(n), _ROWS)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans, each cut up to the start of the word that follows."""
    if text is None or not spans:
        return text
    raw = text.encode()
    buf = np.frombuffer(raw, np.uint8)
    starts, _, _ = T.words(buf, np.array([0, len(buf)]))
    begin = np.r_[starts, len(raw)]
    out, at = [], 0
    for s, e in sorted(spans):
        a, b = int(begin[min(s, len(starts))]), int(begin[min(e, len(starts))])
        if a > at:
            out.append(raw[at:a])
        at = max(at, b)
    out.append(raw[at:])
    return b"".join(out).decode().rstrip(" \t\n\x0b\x0c\r")


def cut(docs: DataFrame, found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs without the found passages of id_column, which their first holders keep; n_chars, if it is there, counts what is left."""
    names, place = docs.columns, docs.columns.index("text")
    own, at = free(names, "_id", "_spans")
    spans = found.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(at))
    joined = docs.join(spans, docs[f"`{id_column}`"].cast("long") == spans[own], "left").drop(own)
    joined = joined.toDF(*[f"_{k}" for k in range(len(names) + 1)])  # mapInArrow can't resolve a name with a dot
    schema = joined.drop(f"_{len(names)}").schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(x, [(s["start_word"], s["end_word"]) for s in spans or ()]) for x, spans in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = joined.mapInArrow(run, schema).toDF(*names)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in names])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a smaller id has. Where ids repeat, each text is a document, and the hash of id and text stands for the id."""
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return cut(docs, passages(docs))
    (own,) = free(docs.columns, "_own")
    named = docs.withColumn(own, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    return cut(named, passages(named.select(F.col(own).alias("doc_id"), "text")), own).drop(own)
