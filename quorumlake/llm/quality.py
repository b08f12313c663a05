"""Quality rules: base counts, and logistic regressions over hashed word and character n-grams.

Two heads are trained on labelled rows, one for `quality` and one for `toxic`.
Word n-grams (1 and 2 words, ASCII-lowered) and character n-grams (3 UTF-8
bytes, case kept) are hashed to 32 bits. The features with the largest
chi-square against either label are kept; the quality head reads a feature's
share of the document, the toxic head its presence. Both are calibrated by
Platt scaling on scores of folds that the fit did not see, all rows in turn,
and compared with fixed thresholds.

The fit reads a bounded sample: `fit_rows` labelled documents of at most
`fit_chars` code points, of each combination of labels those with the smallest
hash of their id. A rare combination gives up to an eighth of the sample, and
calibration weighs rows by how many labels they stand for. All else covers
every whole text. Rows: a null text has no words and fails the base rule;
repeated rows get equal results; an empty table gives none; columns of docs go
along under any name; labels of one id count as their mean; a
head without LEAST sampled labels of either kind, or without a telling gram,
is off and keeps all, and a warning says so.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._store import staged, table
from ._tokens import release, tidy

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

FIT_ROWS = 6000
FIT_CHARS = 32768
N_FEATURES = 1024
FOLDS = 4
#: Bytes of text whose grams are in memory at once.
SLICE = 1 << 20
#: Labels of either kind that a head needs.
LEAST = 8
MIN_GOOD = 0.5
MAX_TOXIC = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_REPEAT = np.uint64(0x5EED)  # the gram of a word that follows itself


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of a batch of whole texts."""
    buf, off = T.buffers(texts)
    starts, ends, first = T.words(buf, off)
    n = len(off) - 1
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    marks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(SYMBOLS[buf], out=marks[1:])
    h = T.span_hashes(buf, starts, ends)
    g = T.grams(h, 3)
    inside = doc[2:] == doc[:-2] if len(g) else np.empty(0, bool)
    at = np.flatnonzero(inside)
    covered = np.zeros(len(h), bool)
    if len(at):
        key = T.mix(g[at] + doc[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    dup = np.zeros(n, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text and "\n" in text:
            lines = text.split("\n")
            extra = len(lines) - len(set(lines))
            if extra:
                seen: set[str] = set()
                for line in lines:
                    if line in seen:
                        dup[i] += bool(line.strip(" \t\n\x0b\x0c\r"))
                    seen.add(line)
    return {
        "n_words": n_words,
        "word_chars": np.bincount(doc, weights=heads[ends] - heads[starts], minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64),
        "n_symbols": marks[off[1:]] - marks[off[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(doc[covered], minlength=n) if len(doc) else np.zeros(n, np.int64),
    }


def _features(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, 32-bit gram, documents' totals) for each family of grams."""
    n = len(off) - 1
    low = T.LOWER[buf]
    starts, ends, first = T.words(low, off)
    per = np.diff(first)
    doc = np.repeat(np.arange(n), per)
    h = T.span_hashes(low, starts, ends)
    yield doc, (h >> np.uint64(32)).astype(np.uint32), per
    if len(h) > 1:
        two = T.grams(h, 2)
        two[h[1:] == h[:-1]] = _REPEAT
        inside = doc[1:] == doc[:-1]
        yield doc[1:][inside], (T.mix(two[inside] + np.uint64(2)) >> np.uint64(32)).astype(np.uint32), per
    size = np.diff(off)
    if len(buf) > 2:
        three = (buf[:-2].astype(np.uint32) << 16) | (buf[1:-1].astype(np.uint32) << 8) | buf[2:]
        owner = np.repeat(np.arange(n), size)
        inside = owner[2:] == owner[:-2]
        yield owner[2:][inside], three[inside] * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B), size


def _folds(ids: list[int], y: np.ndarray) -> np.ndarray:
    """A fold of each row; those of either label are dealt in turn, by the hash of their id."""
    out = np.empty(len(ids), np.int64)
    out[np.lexsort((T.mix(np.array([i & T._MASK for i in ids], np.uint64)), y))] = np.arange(len(ids)) % FOLDS
    return out


def _ascend(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps on standardised columns."""
    y = y.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    v, c = w.copy(), b
    rate = np.float32(4 / (1 + np.square(x).sum(1).mean()))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30)))
        gw, gb = (p - y) @ x / np.float32(len(y)) + np.float32(l2) * v, (p - y).mean()
        nw, nb = v - rate * gw, c - gb
        m = np.float32(k / (k + 3))
        v, c, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def _platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * score + b))) over weighted rows, with smoothed targets, by damped Newton steps."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale = max(float(score.std()), 1e-9)
    x = np.stack([score / scale, np.ones(len(score))], 1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (weight * (p - target)) + 1e-3 * t
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        t = t - np.clip(np.linalg.solve(hess, g), -2, 2)
    return float(t[0] / scale), float(t[1])


@dataclass
class Model:
    """Gram ids ascending, the heads' weights on a gram's share and on its presence, and calibration (a, b) or None."""

    grams: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    good: np.ndarray = field(default_factory=lambda: np.empty(0))
    toxic: np.ndarray = field(default_factory=lambda: np.empty(0))
    good_fit: tuple[float, float] | None = None
    toxic_fit: tuple[float, float] | None = None

    def matrix(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, gram index, share, 1) of the known grams, each pair once."""
        buf, off = T.buffers(texts)
        sieve = np.zeros(1 << 20, bool)
        sieve[self.grams >> 12] = True
        docs, cols, share = [], [], []
        for doc, gram, total in _features(buf, off):
            hit = np.flatnonzero(sieve[gram >> 12])
            at = np.searchsorted(self.grams, gram[hit])
            at[at == len(self.grams)] = 0
            true = self.grams[at] == gram[hit]
            key = doc[hit[true]].astype(np.int64) * len(self.grams) + at[true]
            key, n = np.unique(key, return_counts=True)
            d = key // max(1, len(self.grams))
            docs.append(d)
            cols.append(key % max(1, len(self.grams)))
            share.append(np.sqrt(n / np.maximum(total[d], 1)))
        cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
        return cat(docs, np.int64), cat(cols, np.int64), cat(share, float), np.ones(sum(map(len, docs)))

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality and of toxicity."""
        n = len(texts)
        good, toxic = np.ones(n), np.zeros(n)
        if len(self.grams):
            doc, col, share, one = self.matrix(texts)
            if self.good_fit:
                a, b = self.good_fit
                good = 1 / (1 + np.exp(-np.clip(a * np.bincount(doc, weights=share * self.good[col], minlength=n) + b, -30, 30)))
            if self.toxic_fit:
                a, b = self.toxic_fit
                toxic = 1 / (1 + np.exp(-np.clip(a * np.bincount(doc, weights=one * self.toxic[col], minlength=n) + b, -30, 30)))
        return good, toxic


def _tally(sample: DataFrame) -> DataFrame:
    """gram, n, good, toxic: in how many sampled documents a gram is, and in how many of either label. A slice of texts counts its own first."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in T.slices(batches, "_text", SLICE):
            good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for doc, gram, _ in _features(*T.buffers(batch.column(0))):
                if not len(gram):
                    continue
                key = np.unique((gram.astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64))
                of, gram = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int64)
                start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
                sums = (np.diff(np.r_[start, len(gram)]), np.add.reduceat(good[of], start), np.add.reduceat(toxic[of], start))
                yield pa.RecordBatch.from_arrays([pa.array(gram[start]), *(pa.array(x.astype(np.int64)) for x in sums)], names=["gram", "n", "good", "toxic"])

    rows = sample.select("_text", "_good", "_toxic").mapInArrow(run, "gram bigint, n bigint, good bigint, toxic bigint")
    return rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _telling(tally: DataFrame, n: int, pos: dict[str, int], n_features: int) -> np.ndarray:
    """The grams with the largest chi-square against a live label, ascending; n_features at most come to the driver."""
    chosen: set[int] = set()
    for k in sorted(pos):
        share = pos[k] / n
        expect = F.col("n") * F.lit(share)
        chi2 = F.pow(F.col(k) - expect, F.lit(2)) / F.greatest(expect * F.lit(1 - share) * (1 - F.col("n") / F.lit(n)), F.lit(1e-9))
        best = tally.where(F.col("n") >= max(5, n // 1000)).withColumn("_chi2", chi2).where("_chi2 > 10")
        chosen |= {r[0] for r in best.orderBy(F.desc("_chi2"), "gram").limit(n_features // len(pos)).select("gram").collect()}
    return np.array(sorted(chosen), np.uint32)


def _design(sample: DataFrame, model: Model) -> DataFrame:
    """_id, _good, _toxic, cols (int32) and shares (float32) of the known grams of each sampled document."""
    schema = pa.schema([("_id", pa.int64()), ("_good", pa.int32()), ("_toxic", pa.int32()), ("cols", pa.binary()), ("shares", pa.binary())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "_text", SLICE):
            doc, col, share, _ = model.matrix(batch.column(3))
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
            col, share = col[order].astype("<i4"), share[order].astype("<f4")
            parts = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (col, share)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(p, pa.binary()) for p in parts)], schema=schema)

    return sample.select(F.col("_id").cast("long"), "_good", "_toxic", "_text").mapInArrow(run, "_id bigint, _good int, _toxic int, cols binary, shares binary")


def fit(sample: DataFrame, n_features: int = N_FEATURES, weights: dict[tuple[int, int], float] | None = None) -> Model:
    """Trains both heads on all rows of sample (_id, _text, _good, _toxic); calibration reads each row's score by weights fitted without its fold.

    Executors count grams and cut texts to the chosen ones; the driver gets the
    chosen grams and, of each sampled document, their places.
    """
    cells = {(r[0], r[1]): r[2] for r in sample.groupBy("_good", "_toxic").count().collect()}
    n = sum(cells.values())
    pos = {"good": sum(m for (g, _), m in cells.items() if g), "toxic": sum(m for (_, t), m in cells.items() if t)}
    live = {k: m for k, m in pos.items() if LEAST <= m <= n - LEAST}
    if not live:
        return Model()
    model = Model(grams=_telling(staged(_tally(sample), "quality-grams"), n, live, n_features))
    f = len(model.grams)
    model.good, model.toxic = np.zeros(f), np.zeros(f)
    if not f:
        return Model()
    rows = sorted(_design(sample, model).collect(), key=lambda r: r[0])
    ids = [r[0] for r in rows]
    y = {"good": np.array([r[1] for r in rows], float), "toxic": np.array([r[2] for r in rows], float)}
    each = np.array([(weights or {}).get((r[1], r[2]), 1.0) for r in rows])
    each *= n / each.sum()
    for k, l2 in (("good", 1e-4), ("toxic", 1e-3)):
        if k not in live:
            continue
        x = np.zeros((n, f), np.float32)
        for i, r in enumerate(rows):
            x[i, np.frombuffer(r[3], "<i4")] = np.frombuffer(r[4], "<f4") if k == "good" else 1
        fold, score = _folds(ids, y[k]), np.empty(n)
        for i in (*range(FOLDS), None):
            seen = np.ones(n, bool) if i is None else fold != i
            part = x[seen]
            scale = np.maximum(part.std(0), 1e-3) if k == "good" else np.ones(f, np.float32)
            part /= scale
            w, _ = _ascend(part, y[k][seen], l2)
            w = (w / scale).astype(np.float64)
            score[~seen] = x[~seen].astype(np.float64) @ w
        setattr(model, k, w)
        setattr(model, f"{k}_fit", _platt(score, y[k], each))
    return model


def _quotas(cells: dict[tuple[int, int], int], rows: int) -> dict[tuple[int, int], int]:
    """How many of each combination of labels to take: all or an eighth of rows, and of what is left in proportion."""
    if sum(cells.values()) <= rows:
        return cells
    base = {c: min(n, max(1, rows // 8)) for c, n in cells.items()}
    left, rest = max(0, rows - sum(base.values())), sum(cells.values()) - sum(base.values())
    return {c: base[c] + left * (n - base[c]) // max(1, rest) for c, n in cells.items()}


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """Fits on the bounded sample described above. Several label rows of an id count as their means, at least a half is 1."""
    lab = labels.groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_good"), (F.avg("toxic") >= 0.5).cast("int").alias("_toxic"))
    lab = lab.where("_id is not null and _good is not null and _toxic is not null")
    cells = {(r[0], r[1]): r[2] for r in lab.groupBy("_good", "_toxic").count().collect()}
    taken = _quotas(cells, fit_rows)
    some = [lab.where((F.col("_good") == g) & (F.col("_toxic") == t)).orderBy(F.xxhash64("_id"), "_id").limit(m) for (g, t), m in sorted(taken.items())]
    lab = reduce(DataFrame.unionByName, some, lab.limit(0))
    picked = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where((F.length("_text") > 0) & (F.length("_text") <= fit_chars))
    sample = picked.join(F.broadcast(lab), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_good").alias("_good"), F.first("_toxic").alias("_toxic"))
    sample = staged(sample, "quality-sample")
    model = fit(sample, weights={c: cells[c] / m for c, m in taken.items() if m})
    for name, on in (("quality", model.good_fit), ("toxic", model.toxic_fit)):
        if not on:
            warnings.warn(f"the {name} head is off and keeps all: too few sampled labels of a kind ({taken} by good, toxic), or no telling gram", stacklevel=2)
    return model


def score(docs: DataFrame, model: Model, *, min_good: float = MIN_GOOD, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """All columns of docs, with the counts, p_good, p_toxic, base_failed and kept (these names replace columns of docs)."""
    new = [*COUNTS, "p_good", "p_toxic", "base_failed", "kept"]
    keep = [c for c in docs.columns if c.lower() not in new]
    plain = docs.select(*[F.col(f"`{c}`") for c in keep]).toDF(*[f"_{k}" for k in range(len(keep))])  # mapInArrow can't resolve a name with a dot
    place = keep.index("text")
    out = ", ".join([*(f"_{k} {x.dataType.simpleString()}" for k, x in enumerate(plain.schema)), *(f"{c} bigint" for c in COUNTS), "p_good double, p_toxic double, base_failed boolean, kept boolean"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in T.slices(batches, f"_{place}", SLICE):
            texts = batch.column(place)
            c = counts(texts)
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            good, toxic = model.scores(texts)
            cols = [*batch.columns, *(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(good), pa.array(toxic), pa.array(failed), pa.array(~failed & (good >= min_good) & (toxic < max_toxic))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *new])

    return plain.mapInArrow(run, out).toDF(*keep, *new)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text")


def keep(docs: DataFrame, model: Model, *, min_good: float = MIN_GOOD, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """The rows of docs that score() would mark as kept, unchanged."""
    place = docs.columns.index("text")
    plain = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in T.slices(batches, f"_{place}", SLICE):
            texts = batch.column(place)
            c = counts(texts)
            good, toxic = model.scores(texts)
            yield batch.filter(pa.array((c["n_words"] >= 50) & (100 * c["n_repeat_words"] <= 50 * c["n_words"]) & (good >= min_good) & (toxic < max_toxic)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their own columns. The label table only trains."""
    return keep(docs, train(docs, table(spark, sf_dir, "labels")))
