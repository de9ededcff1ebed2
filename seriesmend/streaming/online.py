"""The sliding-buffer repair and issue rates on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesmend.runtime import prepare


def _timed(rows: DataFrame, time: str, lateness: str) -> DataFrame:
    """Streams get a watermark, for which event time must have a time zone."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness) if rows.isStreaming else rows


def screen_stream(rows: DataFrame, low: float, high: float, window: float, sample: str = "sample_id", time: str = "ts", value: str = "value", lateness: str = "10 minutes") -> DataFrame:
    """Speed-constrained repair of a stream (sample, ts, value): each value is the middle of itself and what rows up to `window` seconds later allow, clipped by the speed (per second) from the repaired value before.

    A row is given out once the watermark is `window` seconds past it, so that what it may depend on is there; later rows are dropped by the watermark. State: the rows that wait, and the last repaired one.
    """
    prepare(rows.sparkSession)
    out = T.StructType([rows.schema[sample], T.StructField("time", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("repaired", T.DoubleType())])
    kept = T.StructType([T.StructField("times", T.ArrayType(T.DoubleType())), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("last_time", T.DoubleType()), T.StructField("last", T.DoubleType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, last_time, last = state.get if state.exists else ([], [], None, None)
        times, values = list(times), list(values)
        for b in batches:
            times += b["__time"].tolist()
            values += b[value].tolist()
        order = np.argsort(times, kind="stable")
        t, y = np.array(times, float)[order], np.array(values, float)[order]
        mark = state.getCurrentWatermarkMs() / 1000
        ready = int(np.searchsorted(t, mark - window, "right"))
        done = []
        for i in range(ready):
            later = np.arange(i + 1, np.searchsorted(t, t[i] + window, "right"))
            gap = t[later] - t[i]
            mid = float(y[i])  # the first value stays
            if last_time is not None:
                d = t[i] - last_time
                mid = float(np.median(np.r_[y[later] - high * gap, y[later] - low * gap, y[i]]))
                mid = min(max(mid, last + low * d), last + high * d)
            last_time, last = float(t[i]), mid
            done.append((key[0], float(t[i]), float(y[i]), mid))
        if ready < len(t):
            state.update((t[ready:].tolist(), y[ready:].tolist(), last_time, last))
            state.setTimeoutTimestamp(max(int((t[ready] + window) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif last_time is not None:
            state.update(([], [], last_time, last))
        yield pd.DataFrame(done, columns=[f.name for f in out.fields])

    timed = _timed(rows, time, lateness).withColumn("__time", F.col(time).cast("double"))
    return timed.groupBy(sample).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_rates(rows: DataFrame, size: str = "1 hour", slide: str | None = None, by: str = "event_type", time: str = "ts", value: str = "value", lateness: str = "1 day") -> DataFrame:
    """(start, end, by, n, missing, mean) by tumbling or sliding windows of event time, with a watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return _timed(rows, time, lateness).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "missing", "mean")


def sessions(rows: DataFrame, gap: str = "30 minutes", by: str = "user_id", time: str = "ts", lateness: str = "1 day") -> DataFrame:
    """(by, start, end, n): runs of events with gaps below `gap`."""
    return _timed(rows, time, lateness).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
