"""Fixed-window limiter whose window starts at a key's first accepted event."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allowed(events: DataFrame, limit: int, window_us: int) -> DataFrame:
    """key, at, event_id, ok for every event (key, at in microseconds, event_id), in order of time and id.

    Sequential within a key by nature: a partition's events come sorted by key and
    time, and the window's start and count, of fixed size, are all that is held
    between batches. Work is linear in the events, whatever a key's share. The
    event that opens a window is always allowed; null keys are one key.
    """
    schema = events.select("key", "at", "event_id", F.lit(True).alias("ok")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            code, at = codes.indices.to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
            ok = np.zeros(batch.num_rows, bool)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                key = (codes.dictionary[int(code[a])].as_py(),)
                if key != known:
                    known, start, n = key, None, 0
                while a < b:
                    if start is None or at[a] - start >= window_us:
                        start, n = int(at[a]), 1
                        ok[a] = True
                        a += 1
                    end = a + int(np.searchsorted(at[a:b], start + window_us))
                    more = min(max(limit - n, 0), end - a)
                    ok[a : a + more] = True
                    n, a = n + more, end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok)], names=["key", "at", "event_id", "ok"])

    return events.select("key", "at", "event_id").repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, schema)
