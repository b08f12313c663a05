"""Vectorised text primitives shared by the operators that run in Arrow batches.

A batch of documents is one UTF-8 byte buffer with offsets. Words are runs of
bytes other than space and 0x09-0x0D; UTF-8 keeps these six bytes for
themselves, so byte and code-point segmentation agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are hashed against one table of powers.
_SPAN = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


_POW = _powers(_BASE, _SPAN + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _SPAN + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches at rows so that each holds about `limit` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and the position of the first word of each document (with the end)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[buf]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    final = solid.copy()
    final[:-1] &= ~solid[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    begin[edge] = solid[edge]
    final[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(final) + 1, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends), which ascend without overlap. Memory beside the result is bounded."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + _SPAN, "right"))
        if to <= at:  # one span longer than the table: piece by piece
            h, piece = 0, _SPAN
            for k in range(base, int(ends[at]), piece):
                part = buf[k : min(k + piece, int(ends[at]))]
                h = (h * 0xFF51AFD7ED558CCD + int((_BYTE[part] * _POW[: len(part)]).sum(dtype=np.uint64)) + 1) & _MASK
            out[at] = h
            at += 1
            continue
        top = int(ends[to - 1])
        total = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf[base:top]] * _POW[: top - base], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * _INV[s] + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        at = to
    return mix(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n neighbours; windows over a document's end are there too."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
