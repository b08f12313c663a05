"""The fixed-window limiter as a stream: a key's state is its window's start and count, whatever the number of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def allowed(events: DataFrame, limit: int, window_us: int) -> DataFrame:
    """key, at, event_id, ok for every event of a stream (key string, at in microseconds, event_id).

    Within a batch events count in order of time and id, batches as they come.
    The batch twin is operators.limiter.allowed().
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"])
        ok = []
        for at in rows["at"].tolist():
            if start is None or at - start >= window_us:
                start, n = at, 0
            ok.append(n < limit)
            n += ok[-1]
        state.update((start, n))
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "ok": ok})

    return events.groupBy("key").applyInPandasWithState(run, "key string, at long, event_id long, ok boolean", "start long, n int", "append", GroupStateTimeout.NoTimeout)
