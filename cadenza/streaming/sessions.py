"""Event streams: sessions per key with late data, tumbling windows, and a running trend kept as state.

Beyond batch parity: the same columns as the batch operators, for data that is still arriving. State is one small row a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Per key and session: start, end and number of events; a session ends after ``gap`` without one."""
    window = F.session_window(ts, gap)
    found = events.withWatermark(ts, late).groupBy(key, window.alias("w")).agg(F.count("*").alias("n_events"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def tumbling(events: DataFrame, key: str, ts: str, x: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Per key and window: count, mean and extremes of ``x``."""
    found = events.withWatermark(ts, late).groupBy(key, F.window(ts, size).alias("w")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return found.select(key, F.col("w.start").alias("window_start"), "n", "mean", "min", "max")


def running_trend(events: DataFrame, key: str, x: str) -> DataFrame:
    """Per key and batch: number of values so far, their slope over 0, 1, ... and change relative to the first.

    The state is the sums of the line's normal equations, so it doesn't grow. Rows of a batch must come in order for a
    key; ``seq`` orders them.
    """

    def step(who: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, sx, sy, sxx, sxy, first, last = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        for y in pd.concat(list(frames)).sort_values("seq")[x]:
            first, last = (y if n == 0 else first), y
            sx, sy, sxx, sxy, n = sx + n, sy + y, sxx + n * n, sxy + n * y, n + 1
        state.update((n, sx, sy, sxx, sxy, first, last))
        spread = n * sxx - sx * sx
        yield pd.DataFrame({key: [who[0]], "n": [n], "slope": [(n * sxy - sx * sy) / spread if n > 1 else None], "total_change": [last / first - 1 if n > 1 and abs(first) > 1e-12 else None]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, slope double, total_change double", "n long, sx double, sy double, sxx double, sxy double, first double, last double", "update", "NoTimeout")
