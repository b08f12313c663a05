"""Embedding whitening by a randomised range finder.

Entries are put on a grid of 1/64 (x = floor(64 * c) + 1000000, whole numbers),
and the distinct x-vectors are the fit list. A is that list centred by its
means. The range finder starts from a random orthonormal basis Q with
`OVERSAMPLE` more columns than components and multiplies it by the covariance
V = A'A / n in passes over all rows, orthonormalising in between; Rayleigh-Ritz
on the projected covariance gives components and eigenvalues. Where the
residuals |V q - e q| don't fall below `TOLERANCE` of the largest eigenvalue
after `PASSES` passes, the basis is expanded to all dimensions, and the same
steps give V itself and its eigenvectors to double precision.

Rows are centred before they are multiplied: n * x - S is exact in 64 bits, and
its quotient by n is rounded once. Each pass is one job over the fit list,
which a staged table holds; every task adds up one matrix of dimensions x basis
columns, and matrices are added in rounds of `FAN` until `FAN` of them or fewer
reach the driver, so that what meets in one task or there is bounded by
FAN * d * d doubles and doesn't grow with the rows.

Rows: a null vector, and one with a null, non-finite or huge entry (beyond
2^40) is dropped; repeated vectors count once in the fit list and keep a row
each in the result. Vectors have one dimension: of several ones the most
frequent is kept (of ties the larger), others are dropped like null vectors.
A direction whose eigenvalue is at most d * 1e-14 of V's trace can't be
whitened and isn't a component; where all vectors are equal there is none, and
the result is empty, as it is for an empty table. A deviation beyond 63 bits is
null. Components are oriented so that their largest entry is positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import staged, table

COMPONENTS = 16
OVERSAMPLE = 16
PASSES = 4
TOLERANCE = 1e-12
SEED = 11
FAN = 16
GRID, SHIFT = 64, 1_000_000
#: Rows of a slice that is multiplied at once.
SLICE = 4096


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null, not finite or huge."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > F.lit(float(1 << 40)))
    return vector.isNotNull() & ~F.exists(vector, bad) & (F.size(vector) > 0)


def on_grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * GRID) + SHIFT).cast("long"))


def _rows(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """Slices (rows, d) of an array of lists of d whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for at in range(0, len(column), SLICE):
        yield flat[at * d : (at + SLICE) * d].reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n; the whole number n * x - S is rounded once where it stays within 63 bits."""
    if n * max(float(np.abs(x).max(initial=0)), abs(float(sums[0])) / max(n, 1)) < 2.0**62 and all(abs(int(v)) < 1 << 62 for v in sums):
        return (x * n - sums.astype(np.int64)) / n
    base = np.array([int(v) // n for v in sums], np.int64)
    return (x - base) - np.array([(int(v) % n) / n for v in sums])


def added(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a matrix of every slice of the fit list, added up in rounds."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _rows(batch.column(0), d):
                got = of(x)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                got = np.frombuffer(raw.as_buffer(), "<f8")
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = fit.select("x").rdd.getNumPartitions()
    out = fit.select("x").mapInArrow(part, "m binary")
    while parts > FAN:
        parts = math.ceil(parts / FAN)
        out = out.repartition(parts).mapInArrow(add, "m binary")
    shape = of(np.zeros((0, d), np.int64)).shape
    return sum((np.frombuffer(r.m, "<f8").reshape(shape) for r in out.toLocalIterator()), np.zeros(shape))


@dataclass
class Whitening:
    """n and S of the fit list; components as columns, eigenvalues falling, trace of V; passes over the rows that it took, and whether the basis was expanded."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0
    expanded: bool = False

    @property
    def scale(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz on the basis Q with V Q: values falling, vectors, residual norms."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return values, basis @ turn, np.linalg.norm(image @ turn - basis @ turn * values, axis=0)


def _sums(vectors: DataFrame, d: int) -> np.ndarray:
    """The exact sums of the dimensions; a row a task and dimension is added up."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in batches:
            for x in _rows(batch.column(0), d):
                total += x.sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([str(v) for v in total], pa.string())], names=["pos", "s"])

    rows = vectors.select("x").mapInArrow(part, "pos bigint, s string").groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return np.array([int(r.s) for r in rows.orderBy("pos").collect()], object)


def fit(vectors: DataFrame, components: int = COMPONENTS, *, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE) -> Whitening | None:
    """Components of a table with the column x (distinct arrays of whole numbers of one length); None without rows."""
    head = vectors.select(F.size("x").alias("d")).first()
    if head is None:
        return None
    d = head.d
    n = vectors.count()
    sums = _sums(vectors, d)
    trace = float(added(vectors, d, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]))[0]) / n

    def image(basis: np.ndarray) -> np.ndarray:
        return added(vectors, d, lambda x: (a := centred(x, n, sums)).T @ (a @ basis)) / n

    width, taken, expanded = min(d, components + oversample), 0, False
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    while True:
        seen = image(basis)
        taken += 1
        values, found, residual = _ritz(basis, seen)
        if width == d or (residual[:components] <= tolerance * max(values[0], 0)).all():
            break
        if taken > passes:
            width, basis, expanded = d, np.eye(d), True
        else:
            basis = np.linalg.qr(seen)[0]
    values, found = values[:components], found[:, :components]
    good = values > trace * d * 1e-14
    values, found = values[good], found[:, good]
    found = found * np.where(found[np.abs(found).argmax(0), range(found.shape[1])] < 0, -1.0, 1.0)
    out = Whitening(n, sums, found, values, trace, passes=taken, expanded=expanded)
    if len(values):
        scale = out.scale
        cov = added(vectors, d, lambda x: (w := centred(x, n, sums) @ scale).T @ w) / n
        out.identity_error = float(np.abs(cov - np.eye(len(values))).max())
    return out


def prepared(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(usable rows with a column x in place of the vector, their dimension)."""
    rows = rows.where(usable(F.col(f"`{vector}`")))
    lengths = rows.groupBy(F.size(F.col(f"`{vector}`")).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    return rows.where(F.size(F.col(f"`{vector}`")) == d).withColumn("x", on_grid(F.col(f"`{vector}`"))), d


def whitened(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row a usable row and component: id_, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kind = rows.schema[id_].dataType.simpleString()
    schema = f"`{id_}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    usable_rows, d = prepared(rows.select(F.col(f"`{id_}`"), F.col(f"`{vector}`")), vector)
    model = fit(staged(usable_rows.select("x").distinct(), "whitening-fit"), components) if d else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    n, sums, scale, error = model.n, model.sums, model.scale, model.identity_error
    share, k = model.values / model.trace, len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _rows(batch.column(1), d):
                a = centred(x, n, sums)
                about = ((a * n) ** 2).sum(1)
                exact = ((x * n - sums.astype(np.int64)) ** 2).sum(1) if about.max(initial=0) < 2.0**62 else np.array([min(v, 1 << 63) for v in ((x.astype(object) * n - sums) ** 2).sum(1)], object)
                far = np.array([v >= 1 << 63 for v in exact], bool)
                each = pa.array([None if f else int(v) for v, f in zip(exact, far, strict=True)], pa.int64()) if far.any() else pa.array(exact.astype(np.int64))
                rows = np.repeat(np.arange(len(x)), k)
                full = lambda v, t, m=len(rows): pa.array(np.full(m, v), t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), full(n, pa.int64()), each.take(pa.array(rows)), pa.array((a @ scale).ravel()), pa.array(np.tile(share, len(x))), full(error, pa.float64())],
                    names=[id_, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
                at += len(x)

    return usable_rows.select(F.col(f"`{id_}`"), "x").mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
