"""Exact percentiles of whole columns, of which no task holds more than a narrow band."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the rows on either side of a level that are looked through, at first.
BAND = 2e-4


def quantiles(df: DataFrame, values: dict[str, Column], levels: Sequence[float]) -> dict[str, list[float | None]]:
    """{name: percentiles at levels}: what F.percentile says of each value (None without any, NaN is greatest).

    F.percentile has all distinct values of a column in one task. Here a pass finds, approximately, between which values the rows of a level's ranks lie; a second one counts rows below these; a third counts the distinct values between them. A band that misses its ranks is widened,
    at last to the whole column, so that the result is exact whatever the approximation is worth. df is read three times: have it written, if it is costly."""
    rows = df.select(*[v.cast("double").alias(f"v{k}") for k, v in enumerate(values.values())])
    good = lambda k: F.when(~F.isnan(f"v{k}"), F.col(f"v{k}"))
    places = range(len(values))
    told = rows.agg(*[e for k in places for e in (F.count(f"v{k}").alias(f"n{k}"), F.count(good(k)).alias(f"m{k}"), F.min(good(k)).alias(f"a{k}"), F.max(good(k)).alias(f"z{k}"))]).first()
    ranks: dict[tuple[int, int], float] = {}
    for k in places:
        last, least, greatest = told[f"m{k}"] - 1, told[f"a{k}"], told[f"z{k}"]
        for p in levels if told[f"n{k}"] else ():
            at = (told[f"n{k}"] - 1) * float(p)
            for r in (math.floor(at), math.ceil(at)):
                ranks[k, r] = math.nan if r > last else least if r == 0 else greatest if r == last else None
    band = BAND
    while open_ := [key for key, v in ranks.items() if v is None]:
        ranks |= _within(rows, good, open_, told, band)
        band *= 8

    def percentile(k: int, p: float) -> float | None:
        if not told[f"n{k}"]:
            return None
        at = (told[f"n{k}"] - 1) * float(p)
        low, high = ranks[k, math.floor(at)], ranks[k, math.ceil(at)]
        return low if low == high or math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * low + (at - math.floor(at)) * high

    return {name: [percentile(k, p) for p in levels] for k, name in enumerate(values)}


def _within(rows: DataFrame, good, open_: list[tuple[int, int]], told, band: float) -> dict[tuple[int, int], float]:
    """The values at those ranks that lie in their bands."""
    of = sorted({k for k, _ in open_})
    shares = {k: sorted({min(max((r + d) / told[f"m{k}"], 0.0), 1.0) for j, r in open_ if j == k for d in (-band * told[f"m{k}"] - 1, band * told[f"m{k}"] + 1)}) for k in of}
    near = rows.agg(*[F.percentile_approx(good(k), shares[k], 10_000).alias(f"q{k}") for k in of]).first()
    bands: dict[tuple[int, float, float], list[int]] = {}
    for k, r in open_:
        edges = []
        for d, end in ((-1, "a"), (1, "z")):
            share = (r + d * (band * told[f"m{k}"] + 1)) / told[f"m{k}"]
            edges.append(near[f"q{k}"][shares[k].index(share)] if 0 < share < 1 else told[f"{end}{k}"])
        bands.setdefault((k, *edges), []).append(r)
    below = rows.agg(*[F.count_if(good(k) < lo).alias(f"b{j}") for j, (k, lo, _) in enumerate(bands)]).first()
    inside = [F.when(good(k).between(lo, hi), F.struct(F.lit(j).alias("j"), good(k).alias("v"))) for j, (k, lo, hi) in enumerate(bands)]
    counted = rows.select(F.inline(F.array_compact(F.array(*inside)))).groupBy("j", "v").count()
    ends = counted.select("j", "v", "count", F.sum("count").over(Window.partitionBy("j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    wanted = [(F.col("j") == j) & (F.col("end") > r - below[f"b{j}"]) & (F.col("end") - F.col("count") <= r - below[f"b{j}"]) for j, every in enumerate(bands.values()) for r in every]
    out = {}
    met = wanted[0]
    for w in wanted[1:]:
        met = met | w
    for row in ends.where(met).collect():  # a row or two for each band
        (k, *_), every = list(bands.items())[row["j"]]
        first = below[f"b{row['j']}"] + row["end"] - row["count"]
        out |= {(k, r): row["v"] for r in every if first <= r < first + row["count"]}
    return out
