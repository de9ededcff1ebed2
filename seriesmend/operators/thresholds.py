"""Thresholds from the tail of a series' scores: peaks over a high quantile follow a generalised Pareto law, whose two parameters give the value that is exceeded with a chosen probability (Siffer et al., "Anomaly Detection in Streams with Extreme Value Theory", KDD 2017).

The law is fitted by moments, so that everything is counts, sums and ranks: groupings that combine where the rows are, a sort of the peaks alone, and for streams a state of four numbers a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesmend.runtime import prepare
from seriesmend.spec import SeriesSpec

#: Shapes of the law that count as 0: its limit there is the exponential law.
FLAT = 1e-9


def _limit(start: Column, shape: Column, scale: Column, share: Column) -> Column:
    """The value that a share of all rows exceeds, from the law beyond start; share is relative to that of the peaks."""
    return F.when(F.abs(shape) > FLAT, start + scale / F.when(F.abs(shape) > FLAT, shape) * (F.pow(share, -shape) - 1)).otherwise(start - scale * F.log(share))


def tail_limits(df: DataFrame, spec: SeriesSpec, score: str = "score", risk: float = 1e-3, level: float = 0.98, fit: str = "weighted", least: int = 10) -> DataFrame:
    """(sample, n, start, peaks, shape, scale, limit) of each series: the value that scores exceed with probability `risk` (below 1 - level).

    start is the `level` quantile between order statistics, peaks the rows above it. fit: "weighted" by probability-weighted moments (Hosking and Wallis, 1987), or "moments" by mean and variance. With fewer than `least` peaks, or peaks without spread, the limit is the greatest score. Null and NaN
    scores don't count; a series without scores has no row.
    """
    rows = df.select(F.col(spec.sample).alias("s"), F.col(score).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    base = rows.groupBy("s").agg(F.count("*").alias("n"), F.percentile("x", F.lit(level)).alias("start"), F.max("x").alias("top"))
    own = base.withColumnRenamed("s", "b")
    peaks = rows.join(own, F.col("s").eqNullSafe(F.col("b"))).where("x > start").select("s", (F.col("x") - F.col("start")).alias("y"))
    w = Window.partitionBy("s")
    if fit == "weighted":
        at = (F.row_number().over(w.orderBy("y")) - 0.35) / F.count("*").over(w)
        sums = peaks.withColumn("z", (1 - at) * F.col("y")).groupBy("s").agg(F.count("*").alias("peaks"), F.avg("y").alias("a"), F.avg("z").alias("z"))
        gap = F.col("a") - 2 * F.col("z")
        shape, scale = 2 - F.col("a") / F.when(gap != 0, gap), 2 * F.col("a") * F.col("z") / F.when(gap != 0, gap)
    elif fit == "moments":
        sums = peaks.groupBy("s").agg(F.count("*").alias("peaks"), F.avg("y").alias("a"), F.var_pop("y").alias("z"))
        part = F.col("a") * F.col("a") / F.when(F.col("z") > 0, F.col("z"))
        shape, scale = (1 - part) / 2, F.col("a") * (part + 1) / 2
    else:
        raise ValueError(f"no such fit: {fit}")
    sums = sums.select("s", "peaks", shape.alias("shape"), scale.alias("scale")).withColumnRenamed("s", "p")
    out = base.join(sums, F.col("s").eqNullSafe(F.col("p")), "left").withColumn("peaks", F.coalesce("peaks", F.lit(0)))
    good = (F.col("peaks") >= least) & F.col("shape").isNotNull() & (F.col("scale") > 0)
    limit = _limit(F.col("start"), F.col("shape"), F.col("scale"), risk * F.col("n") / F.col("peaks"))
    return out.select(F.col("s").alias(spec.sample), "n", "start", "peaks", F.when(good, F.col("shape")).alias("shape"), F.when(good, F.col("scale")).alias("scale"), F.when(good, limit).otherwise(F.col("top")).alias("limit"))


def flag_tail(df: DataFrame, spec: SeriesSpec, score: str = "score", **how) -> DataFrame:
    """The table with is_outlier: the score is above its series' limit (false where there is none)."""
    limits = tail_limits(df, spec, score, **how).select(F.col(spec.sample).alias("__s"), F.col("limit").alias("__limit"))
    joined = df.join(limits, F.col(spec.sample).eqNullSafe(F.col("__s")), "left")
    above = F.col(score).cast("double") > F.col("__limit")
    return joined.withColumn("is_outlier", F.coalesce(above & ~F.isnan(F.col(score).cast("double")), F.lit(False))).drop("__s", "__limit")


def law_limit(start: float, n: int, peaks: int, total: float, squares: float, risk: float) -> float:
    """The limit from the moments of peaks over start: their number, sum and sum of squares among n rows; infinite where they have no spread."""
    if peaks < 2:
        return math.inf
    mean = total / peaks
    var = squares / peaks - mean * mean
    if var <= 1e-12 * mean * mean:
        return math.inf
    shape, scale, share = (1 - mean * mean / var) / 2, mean * (mean * mean / var + 1) / 2, risk * n / peaks
    return start + scale / shape * (share**-shape - 1) if abs(shape) > FLAT else start - scale * math.log(share)


def tail_stream(rows: DataFrame, sample: str = "sample_id", time: str = "ts", score: str = "score", risk: float = 1e-3, level: float = 0.98, first: int = 1000, lateness: str = "10 minutes") -> DataFrame:
    """(sample, time, score, limit, is_outlier) of a stream of scores. A series' first rows (`first`, in order of time as its batches bring them) set the start of the tail and are given out when that is known, held against the limit that they give; each later row is held against the limit so far. What is
    above it is an outlier and teaches nothing; what is above the start is a peak and moves the limit. State: the waiting first rows, then the start, counts and two sums. Rows of a batch are taken in order of time."""
    prepare(rows.sparkSession)
    if rows.isStreaming:
        rows = rows.withWatermark(time, lateness)
    out = T.StructType([rows.schema[sample], T.StructField("time", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("limit", T.DoubleType()), T.StructField("is_outlier", T.BooleanType())])
    number = T.ArrayType(T.DoubleType())
    kept = T.StructType([T.StructField("times", number), T.StructField("scores", number), T.StructField("start", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("peaks", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("squares", T.DoubleType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, scores, start, n, peaks, total, squares = state.get if state.exists else ([], [], None, 0, 0, 0.0, 0.0)
        times, scores = list(times), list(scores)
        for b in batches:
            times += b["__time"].tolist()
            scores += b[score].astype(float).tolist()
        order = np.argsort(times, kind="stable")
        times, scores = (np.array(v, float)[order] for v in (times, scores))
        good = np.isfinite(scores)
        times, scores, done = times[good], scores[good], []
        if start is None and len(scores) >= first:
            head = scores[:first]
            start = float(np.quantile(head, level))
            high = head[head > start] - start
            n, peaks, total, squares = first, len(high), float(high.sum()), float((high**2).sum())
            limit = law_limit(start, n, peaks, total, squares, risk)
            done += [(key[0], t, v, limit, bool(v > limit)) for t, v in zip(times[:first].tolist(), head.tolist(), strict=True)]
            times, scores = times[first:], scores[first:]
        if start is not None:
            limit = law_limit(start, n, peaks, total, squares, risk)
            for t, v in zip(times.tolist(), scores.tolist(), strict=True):
                done.append((key[0], t, v, limit, v > limit))
                if v <= limit:
                    n += 1
                    if v > start:
                        peaks, total, squares = peaks + 1, total + v - start, squares + (v - start) ** 2
                    limit = law_limit(start, n, peaks, total, squares, risk)
            times, scores = times[:0], scores[:0]
        state.update((times.tolist(), scores.tolist(), start, n, peaks, total, squares))
        yield pd.DataFrame(done, columns=[f.name for f in out.fields])

    timed = rows.withColumn("__time", F.col(time).cast("double"))
    return timed.groupBy(sample).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)
