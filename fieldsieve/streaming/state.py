"""Structured Streaming form of the per-source high-water mark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id long, last_ts timestamp, n long, n_total long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, total = state.get if state.exists else (None, 0)
    n = 0
    for b in batches:
        n += len(b)
        top = b["ts"].max()
        last = top if last is None or top > last else last
    state.update((last, total + n))
    yield pd.DataFrame({"user_id": [key[0]], "last_ts": [last], "n": [n], "n_total": [total + n]})


def high_water_marks(events: DataFrame) -> DataFrame:
    """A row per source and trigger: the latest time seen so far, the rows of the trigger, and all rows so far.

    Late and undated rows are not dropped by a watermark; the sink's anti-join makes re-reading harmless.
    """
    return events.groupBy("user_id").applyInPandasWithState(_advance, OUT, "last_ts timestamp, n long", "update", GroupStateTimeout.NoTimeout)
