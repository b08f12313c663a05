"""Periodic runs of a text's words, found with a suffix automaton.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends, here of max(24, 3 q) words or more. In a text's
suffix automaton a state stands for strings with the same end positions, and
two positions meet first at the state whose longest string is what their
prefixes have in common. The sets of end positions are kept in order and
merged, smaller into larger, from long states to short ones; whenever a merge
makes two positions neighbours whose distance d is at most the state's length,
the text has a square there: period d from the first word of the state's string
up to the second position. The last such pair of a run has in common all but
the run's first d words, so pairs with fewer than 16 words or 2 d in common
can't end a run and aren't kept. Pairs of one period and first word are one
run, which their last position ends; periods that a divisor replaces are
dropped.

An automaton is built only where a run may be. Each word of a run lies in a
window of 16 words that the text has again at a distance of at most a third of
its length; sorted hashes of windows find these stretches, and equal hashes of
different windows cost time only.

Rows: null and empty texts, and those with fewer than 24 words, have no run; ids
may repeat or be null (a null id is hashed as the empty text); rows are judged
one by one, so ties, repeated rows and extra columns change nothing; an empty
table gives no rows. Memory: a few MB of texts a task at once, or one longer
text, and some 300 bytes a word of its longest repetitive stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._store import table

LEAST, TIMES = 24, 3
#: A run has this many words at least that stand again a period later.
WINDOW = LEAST - LEAST // TIMES

Run = tuple[int, int, int]


class Automaton:
    """The suffix automaton of a sequence of small numbers.

    A state's first transition lies in two lists, further ones in a dictionary.
    """

    def __init__(self, word: list[int]) -> None:
        self.length, self.link, self.end = [0], [-1], [-1]
        self.label, self.target, self.more = [-1], [-1], {}
        length, link, end, label, target, more = self.length, self.link, self.end, self.label, self.target, self.more
        last = 0
        for i, c in enumerate(word):
            new = len(length)
            length.append(i + 1)
            link.append(0)
            end.append(i)
            label.append(-1)
            target.append(-1)
            p, q = last, -1
            while p >= 0:
                own = label[p]
                if own == c:
                    q = target[p]
                    break
                if own < 0:
                    label[p], target[p] = c, new
                else:
                    others = more.get(p)
                    if others is None:
                        more[p] = {c: new}
                    elif c in others:
                        q = others[c]
                        break
                    else:
                        others[c] = new
                p = link[p]
            if q >= 0:
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    end.append(-1)
                    label.append(label[q])
                    target.append(target[q])
                    if q in more:
                        more[twin] = dict(more[q])
                    link[q] = link[new] = twin
                    while p >= 0:
                        if label[p] == c:
                            if target[p] != q:
                                break
                            target[p] = twin
                        else:
                            others = more.get(p)
                            if others is None or others.get(c) != q:
                                break
                            others[c] = twin
                        p = link[p]
            last = new

    def squares(self, window: int) -> dict[tuple[int, int], int]:
        """(period, first position) to last position of what neighbours with `window` positions, or two periods, in common span."""
        length, link = self.length, self.link
        order = np.argsort(np.array(length), kind="stable")[::-1].tolist()
        ends: list[list[int] | None] = [None if e < 0 else [-e] for e in self.end]
        found: dict[tuple[int, int], int] = {}
        for v in order:
            up = link[v]
            if up <= 0:
                ends[v] = None
                continue
            small, large = ends[v], ends[up]
            ends[v] = None
            if large is None:
                ends[up] = small
                continue
            if len(small) > len(large):
                small, large = large, small
            ends[up] = large
            common = length[up]
            top = common // 2
            if common < window:
                top = -1
            for x in small:  # negative positions: an earlier one comes later, as most that are put in
                k = bisect_left(large, x) if large[-1] > x else len(large)
                if top > 0:
                    if k and 0 < x - large[k - 1] <= top:
                        d = x - large[k - 1]
                        at = (d, -x - common + 1)
                        if found.get(at, -1) < d - x:
                            found[at] = d - x
                    if k < len(large) and large[k] - x <= top:
                        d = large[k] - x
                        at = (d, -large[k] - common + 1)
                        if found.get(at, -1) < -x:
                            found[at] = -x
                large.insert(k, x)
        return found


def _primes(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return [*out, n] if n > 1 else out


def runs(words: list) -> list[Run]:
    """(start, length, period) of the runs of a sequence, by start and period."""
    known: dict = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    flat = np.array(ids)
    out = []
    for (d, start), last in Automaton(ids).squares(WINDOW).items():
        n = last - start + 1
        if n < max(LEAST, TIMES * d):
            continue
        if any((flat[start : last + 1 - d // f] == flat[start + d // f : last + 1]).all() for f in _primes(d)):
            continue
        out.append((start, n, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each text, [first, last) of the stretches of words that may hold runs; bounds has each text's place in the hashes, with the end."""
    texts = len(bounds) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(texts)]
    g = T.grams(hashes, 1)
    for step in (1, 2, 4, 8):
        if len(g) <= step:
            return out
        g = T.mix(g[:-step] * np.uint64(0x9FB21C651E98DF25) + g[step:])
    size = np.diff(bounds)
    text = np.repeat(np.arange(texts), np.maximum(size, 0))[: len(g)]
    own = np.arange(len(g)) + WINDOW <= bounds[text + 1]
    at = np.flatnonzero(own & (size[text] >= LEAST))
    if not len(at):
        return out
    key = T.mix(g[at] ^ T.mix(text[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    near = np.flatnonzero((key[1:] == key[:-1]) & ((at[1:] - at[:-1]) * TIMES <= size[text[at[1:]]]) & (text[at[1:]] == text[at[:-1]]))
    if not len(near):
        return out
    starts = np.unique(np.concatenate([at[near], at[near + 1]]))
    cut = np.flatnonzero((np.diff(starts) > WINDOW) | (np.diff(text[starts]) != 0)) + 1
    for piece in np.split(starts, cut):
        k = int(text[piece[0]])
        out[k].append((int(piece[0] - bounds[k]), int(piece[-1] - bounds[k]) + WINDOW))
    return out


def edited(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p) of the query's edit of a text of n words: from word a on it repeats p words; None where it stays as it is."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def described(words: list[bytes], found: list[Run]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = words
    if found:
        keep = bytearray(b"\x01") * len(words)
        for s, n, q in found:
            keep[s + q : s + n] = bytes(n - q)
        kept = [w for w, k in zip(words, keep, strict=True) if k]
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *top, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_DDL = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _words(batch: pa.RecordBatch, edit: bool) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Each text's words, the hashes of all words and each text's place in them."""
    buf, off = T.buffers(batch.column(1))
    raw = buf.tobytes()
    split = [raw[a:b].split() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    starts, ends, first = T.words(buf, off)
    hashes = T.span_hashes(buf, starts, ends)
    for k, doc_id in enumerate(batch.column(0).to_pylist() if edit else []):
        n = len(split[k])
        if e := edited(n, doc_id):
            a, p = e
            split[k] = split[k][:a] + [split[k][a + i] for i in range(p)] * (-(-(n - a) // p))
            del split[k][n:]
            at = int(first[k])
            hashes[at + a : at + n] = hashes[at + a + np.arange(n - a) % p]
    return split, hashes, first


def periodic_runs(docs: DataFrame, edit: bool = False) -> DataFrame:
    """Per document (doc_id, text): its runs' number, the best one, and digests of all runs and of the text without repeats.

    edit: of every tenth text, by crc32 of the id, a part is made periodic first.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text", 2 << 20):
            split, hashes, first = _words(batch, edit)
            rows = []
            for words, places in zip(split, stretches(hashes, first), strict=True):
                found = [(s + a, n, q) for a, b in places for s, n, q in runs(words[a:b])]
                rows.append(described(words, sorted(found, key=lambda r: (r[0], r[2]))))
            columns = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(OUT)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, _DDL)


def collapsed(docs: DataFrame) -> DataFrame:
    """All columns of docs; in each text the words of a run after its first period are left out. Texts without a run stay as they are."""
    keep = docs.columns
    at = keep.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text", 2 << 20):
            two = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["doc_id", "text"])
            split, hashes, first = _words(two, False)
            texts = batch.column(at).to_pylist()
            for k, (words, places) in enumerate(zip(split, stretches(hashes, first), strict=True)):
                gone = {i for a, b in places for s, n, q in runs(words[a:b]) for i in range(a + s + q, a + s + n)}
                if gone:
                    texts[k] = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    names = [f"c{i}" for i in range(len(keep))]
    names[at] = "text"
    out = docs.toDF(*names)
    return out.mapInArrow(cut, out.schema).toDF(*keep)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=True)
