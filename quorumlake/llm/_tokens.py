"""Token ids of whole texts by the tokenizers library, through a bounded cache of chunks.

The two pre-tokenizers that the cache knows never join characters across the
places where chunks are cut. The byte-level pattern starts a new piece at the
beginning of white space, at a space or newline before another character, and
after such a newline. The word pattern drops white space.
Bytes that may begin white space beyond ASCII are not cut at. Other
pre-tokenizers encode texts whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import _text as T

#: Lead bytes of characters that may be white space.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Characters that are no white space, by their first byte.
_SOLID = np.arange(256) > 0x20
_SOLID[0x7F] = False
_SOLID &= ~_DOUBTFUL
_BLANK = " \t\n\x0b\x0c\r"


def _cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places at which the byte-level pattern starts a new piece, documents' starts among them."""
    cut = np.zeros(len(buf), bool)
    if len(buf) > 1:
        solid = _SOLID[buf[1:]]
        line = (buf[:-1] == 0x0A) & solid
        cut[:-1] = ((buf[:-1] == 0x20) & solid) | line
        cut[1:] |= line
        cut[1:] |= (buf[1:] == 0x0A) & (buf[:-1] > 0x20) & (buf[:-1] < 0x7F)
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


#: Letters that stay one piece under either pre-tokenizer, and marks that make a piece of their own after them.
_SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%&$#*|]*)").fullmatch


class _Codes(dict):
    """Numbers new keys in the order of their first look-up; `new` holds those since it was last cleared."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class Encoder:
    """ids(texts) gives the ids of all texts in a row, and how many each text has, as the library encodes each text by default.

    A text in which a special token is spelled out goes to the library whole.
    A chunk is two pieces at most: letters with the marks that follow, or one
    piece of any kind. New pieces of letters are encoded together in one call;
    which of the ids ends (or begins) a word tells them apart.
    """

    def __init__(self, path: str, chunks: int = 900_000, pieces: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._of, self._whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._of.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spelled = [re.escape(t["content"].encode()) for t in spec.get("added_tokens") or [] if t["special"]]
        self._spelled = re.compile(b"|".join(spelled)) if spelled else None
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self._kind = "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and norm is None:
            self._kind = "spaces"
        elif before.get("type") == "Sequence" and [p["type"] for p in before["pretokenizers"]] == ["Split", "ByteLevel"] and before["pretokenizers"][0]["behavior"] == "Removed" and "[^\\s\\p{L}\\p{N}]+" in before["pretokenizers"][0]["pattern"].get("Regex", "") and spec["model"].get("end_of_word_suffix") == "</w>":
            self._kind = "words"
        vocab = self._of.get_vocab()
        self._edge = np.zeros(max(vocab.values()) + 1, bool)
        for token, k in vocab.items():
            self._edge[k] = token.endswith("</w>") if self._kind == "words" else token.startswith("\u0120")
        self._chunk_limit, self._piece_limit = chunks, pieces
        self._pieces, self._chunks = _Codes(), _Codes()
        self._ids, self._start, self._size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self._parts = np.empty((0, 2), np.int64)

    def _forget(self) -> None:
        """Drops the newest entries beyond the limits; the frequent ones came first."""
        n = self._piece_limit
        if len(self._pieces) > n:
            for key in list(itertools.islice(reversed(self._pieces), len(self._pieces) - n)):
                del self._pieces[key]
            self._ids, self._start, self._size = self._ids[: self._start[n]], self._start[:n], self._size[:n]
        keep = min(self._chunk_limit, int(np.argmax(gone)) if (gone := (self._parts >= n).any(1)).any() else len(self._parts))
        if len(self._chunks) > keep:
            for key in list(itertools.islice(reversed(self._chunks), len(self._chunks) - keep)):
                del self._chunks[key]
            self._parts = self._parts[:keep]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of words of letters by one call, and how many each word has."""
        ids = np.array(self._of.encode_batch_fast([(" " if self._kind == "words" else "").join(words)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self._edge[ids])
        size = np.diff(np.r_[-1, at]) if self._kind == "words" else np.diff(np.r_[at, len(ids)])
        return (ids, size) if len(size) == len(words) and size.sum() == len(ids) else None

    def _learn_pieces(self) -> None:
        """Encodes the pieces that have a number but no ids yet."""
        new, self._pieces.new = self._pieces.new, []
        if not new:
            return
        size = np.full(len(new), -1, np.int64)
        order, flat = [], []
        plain = [k for k, x in enumerate(new) if (x.isalpha() if self._kind == "words" else x[:1] == " " and x[1:].isalpha()) and _SIMPLE(x)]
        for a in range(0, len(plain), 4096):
            some = plain[a : a + 4096]
            got = self._together([new[k] for k in some])
            if got:
                order += some
                flat.append(got[0])
                size[some] = got[1]
        rest = np.flatnonzero(size < 0).tolist()
        for k, e in zip(rest, self._of.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
            flat.append(np.array(e.ids, np.uint32))
            size[k] = len(e.ids)
        order = np.array(order + rest, np.int64)
        start = np.empty(len(new), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        flat = [np.concatenate(flat)[T.ragged(start, size)]]  # in the order of the numbers
        start = len(self._ids) + np.cumsum(size) - size
        self._start = np.concatenate([self._start, start])
        self._size = np.concatenate([self._size, size])
        self._ids = np.concatenate([self._ids, *flat])

    def _learn_chunks(self) -> None:
        new, self._chunks.new = self._chunks.new, []
        parts = np.empty((len(new), 2), np.int64)
        pieces, fold = self._pieces, self._kind == "words"
        none = pieces[""]
        for k, raw in enumerate(new):
            x = raw.decode()
            if fold:
                x = x.rstrip(_BLANK)
            m = _SIMPLE(x)
            if m:
                word, marks = m.groups()
                parts[k] = pieces[word.lower() if fold else word], pieces[marks] if marks else none
            else:
                parts[k] = pieces[x], none
        self._learn_pieces()
        self._parts = np.concatenate([self._parts, parts])

    def _chunked(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks between starts (the last one goes to the end), and how many each has."""
        edges = np.r_[starts, len(buf)].astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(buf)]).dictionary_encode()
        codes = np.array(list(map(self._chunks.__getitem__, chunks.dictionary.to_pylist())), np.int64)
        if self._chunks.new:
            self._learn_chunks()
        at = self._parts[codes[chunks.indices.to_numpy()]].ravel()
        out = self._ids[T.ragged(self._start[at], self._size[at])], self._size[at].reshape(-1, 2).sum(1)
        if len(self._chunks) > self._chunk_limit or len(self._pieces) > self._piece_limit:
            self._forget()
        return out

    def ids(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        buf, off = T.buffers(texts)
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        hits = [m.start() for m in self._spelled.finditer(buf.tobytes())] if self._spelled else []
        if not hits:
            return self._ids_of(texts)
        whole = np.unique(np.searchsorted(off, hits, "right") - 1)
        found = [np.array(self._whole.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) for k in whole.tolist()]
        rest = np.ones(len(texts), bool)
        rest[whole] = False
        ids, n = self._ids_of(texts.filter(pa.array(rest)))
        sizes = np.empty(len(texts), np.int64)
        sizes[rest], sizes[whole] = n, [len(x) for x in found]
        out = np.empty(int(sizes.sum()), np.uint32)
        mine = np.repeat(rest, sizes)
        out[mine], out[~mine] = ids, np.concatenate(found)
        return out, sizes

    def _ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, off = T.buffers(texts)
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if self._kind == "whole":
            found = [np.array(e.ids, np.uint32) for e in self._of.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        buf = np.ascontiguousarray(buf)
        starts = T.words(buf, off)[0] if self._kind == "words" else _cuts(buf, off)
        parts, sizes = [], []
        for at in range(0, len(starts), 2_000_000):  # of a very long text, some at a time
            some = starts[at : at + 2_000_000]
            to = int(starts[at + len(some)]) if at + len(some) < len(starts) else len(buf)
            got = self._chunked(buf[:to], some)
            parts.append(got[0])
            sizes.append(got[1])
        if not parts:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        total = np.r_[0, np.cumsum(np.concatenate(sizes))]
        return np.concatenate(parts), np.diff(total[np.searchsorted(starts, off)])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by the Python worker for its next task."""
    return Encoder(path)


def release() -> None:
    """Frees the encoders that an earlier stage has left in this Python worker."""
    encoder.cache_clear()


def tidy(run):
    """A task's function over batches that gives freed memory back at its end: workers are kept for later tasks, and what they hold counts."""

    @functools.wraps(run)
    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not in every C library
                ctypes.CDLL(None).malloc_trim(0)

    return swept


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each document, and the documents' offsets."""
    off = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(off[-1], end, np.uint32)
    mask = np.ones(off[-1], bool)
    mask[off[1:] - 1] = False
    out[mask] = ids
    return out, off
