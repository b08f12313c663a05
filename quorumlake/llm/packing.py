"""Bounded-space online packing of token sequences.

Each partition keeps at most `windows` open windows. A document's whole
windows are emitted as they are; the rest goes into the open window that it
fills best. When none fits and no more may be opened, the fullest one is
topped up with the head of the rest and emitted, so no emitted window has
padding. Open windows that are left at a partition's end are merged in levels
of `fan_in` partitions by the same rule; the one window that is left at the
very end holds all padding (none, if its length is a power of two).

Memory: the open windows and one batch for a partition, the left windows of
`fan_in` partitions for a merge. Rows: an empty or null text is its end id
alone; repeated rows are packed as often as they are there; a null doc_id stays
null, and other columns aren't read. An empty table has no pieces.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._store import staged, table
from ._tokens import encoder, with_end

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 1
LENGTH = 2048
WINDOWS = 64
FAN_IN = 32

PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, part bigint, open boolean"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("open", pa.bool_())])


def _shape(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


class Packer:
    """Places pieces (doc_id, start, doc_tokens, ids) in windows; `done` gets (pieces of a full window)."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows = length, windows
        self.gaps: list[tuple[int, int]] = []  # (free places, window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.next = 0
        self.done: list[list[tuple]] = []

    def _put(self, k: int, piece: tuple, n: int) -> None:
        gap, w = self.gaps.pop(k)
        self.held[w].append(piece)
        if gap == n:
            self.done.append(self.held.pop(w))
        else:
            bisect.insort(self.gaps, (gap - n, w))

    def add(self, doc_id: int, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        at = 0
        while len(ids) - at >= self.length:
            self.done.append([(doc_id, start + at, doc_tokens, ids[at : at + self.length])])
            at += self.length
        while (n := len(ids) - at) > 0:
            piece = (doc_id, start + at, doc_tokens, ids[at:])
            k = bisect.bisect_left(self.gaps, (n, -1))
            if k < len(self.gaps):
                self._put(k, piece, n)
                return
            if len(self.gaps) < self.windows:
                self.held[self.next] = [piece]
                bisect.insort(self.gaps, (self.length - n, self.next))
                self.next += 1
                return
            cut = self.gaps[0][0]
            self._put(0, (doc_id, start + at, doc_tokens, ids[at : at + cut]), cut)
            at += cut

    def left(self) -> list[list[tuple]]:
        return [self.held[w] for _, w in sorted(self.gaps)]


def _rows(windows: list[list[tuple]], first: int, part: int, opened: bool) -> list[tuple]:
    rows = []
    for k, window in enumerate(windows):
        offset = 0
        for doc_id, start, doc_tokens, ids in window:
            rows.append((doc_id, start, len(ids), doc_tokens, first + k, offset, ids.astype("<u4").tobytes(), part, opened))
            offset += len(ids)
    return rows


def _merge(length: int, windows: int, level: int, last: bool):
    def run(key: tuple, left: pa.Table) -> pa.Table:
        packer = Packer(length, 1 if last else windows)
        left = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for doc_id, start, doc_tokens, ids in zip(*(left[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            packer.add(doc_id, start, doc_tokens, np.frombuffer(ids, "<u4"))
        part = key[0].as_py()
        base = (level << 56) + (part << 32)
        rows = _rows(packer.done, base, part, False)
        rows += _rows(packer.left(), base + len(packer.done), part, not last)
        return pa.Table.from_batches([_shape(rows)])

    return run


def pack(docs: DataFrame, *, tokenizer: str = TOKENIZER, end: int = END, length: int = LENGTH, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (unsigned 32-bit, little-endian) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, first = Packer(length, windows), part << 32
        for batch in T.slices(batches, "_text"):
            doc_ids = batch.column(0).to_pylist()
            ids, off = with_end(*encoder(tokenizer).ids(batch.column(1)), end)
            for i, doc_id in enumerate(doc_ids):
                packer.add(doc_id, 0, int(off[i + 1] - off[i]), ids[off[i] : off[i + 1]])
            for window in packer.held.values():  # open windows keep copies, not the batch
                window[:] = [(d, s, t, x if x.base is None else x.copy()) for d, s, t, x in window]
            if packer.done:
                yield _shape(_rows(packer.done, first, part, False))
                first += len(packer.done)
                packer.done = []
        if packer.held:
            yield _shape(_rows(packer.left(), first, part, True))

    placed = staged(docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).mapInArrow(run, PIECE), "packed")
    out = placed.where(~F.col("open"))
    left, level = placed.where("open"), 0
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        level, last = level + 1, parts <= fan_in
        merged = left.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("part").applyInArrow(_merge(length, windows, level, last), PIECE)
        merged = staged(merged, "packed-left")
        out = out.unionByName(merged.where(~F.col("open")))
        if last:
            return out.drop("part", "open")
        left, parts = merged.where("open"), -(-parts // fan_in)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
