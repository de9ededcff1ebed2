"""Shapes of series as shares of positive values of convolutions with fixed kernels (Dempster, Schmidt and Webb, "MiniRocket", KDD 2021), and the choice of a number of clusters by them.

A kernel has nine weights, three of 2 and six of -1, a row apart or 2, 4, ... (dilation). Beyond a series' ends there are zeros. A feature is the share of rows at which the convolution is above a bias. A row's surroundings for all dilations come from one window (one sort of each series);
tasks count, batch by batch of rows, the comparisons of a series that hold, and Spark adds the counts up.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.runtime import arrow_map, written
from seriesmend.spec import SeriesSpec, long_form

#: Places of the three greater weights among nine: 84 kernels.
KERNELS = list(combinations(range(9), 3))
#: Levels of the quantiles that biases are taken from.
LEVELS = [round(0.05 * k, 2) for k in range(21)]


def surroundings(df: DataFrame, spec: SeriesSpec, dilations: list[int]) -> tuple[DataFrame, list[int]]:
    """((sample, col, t, v: the values of the cell's surroundings), how far each lies ahead), for kernels of all dilations. Missing cells and those beyond the ends are 0."""
    cells = long_form(df, spec).select(F.col(spec.sample).alias("sample"), "col", F.col(spec.t).alias("t"), F.coalesce("value", F.lit(0.0)).alias("v"))
    w = Window.partitionBy("sample", "col").orderBy("t")
    places = sorted({(k - 4) * d for d in dilations for k in range(9)})
    return cells.select("sample", "col", "t", F.array(*[F.coalesce(F.lead("v", p).over(w), F.lit(0.0)) for p in places]).alias("v")), places


def convolved(taps: list[np.ndarray]):
    """The convolutions of nine columns with each of KERNELS."""
    whole = taps[0] + 0.0
    for x in taps[1:]:
        whole = whole + x
    for a, b, c in KERNELS:
        yield 3 * (taps[a] + taps[b] + taps[c]) - whole


def _taps(values, places: list[int], dilation: int) -> list[np.ndarray]:
    x = np.ascontiguousarray(values.flatten().to_numpy().reshape(-1, len(places)).T)
    return [x[places.index((k - 4) * dilation)] for k in range(9)]


def convolutions(df: DataFrame, spec: SeriesSpec, dilation: int) -> DataFrame:
    """(sample, col, t, c): c are the convolutions of a row's surroundings with each of KERNELS. Missing cells are 0."""
    rows, places = surroundings(df, spec, [dilation])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield {**{c: b.column(k) for k, c in enumerate(("sample", "col", "t"))}, "c": list(np.stack(list(convolved(_taps(b.column(3), places, dilation))), axis=1))}

    return arrow_map(rows, run, T.StructType([*rows.schema.fields[:3], T.StructField("c", T.ArrayType(T.DoubleType()))]))


def fit_biases(df: DataFrame, spec: SeriesSpec, dilations: list[int], seed: int = 42) -> dict[tuple[str, int], list[float]]:
    """{(feature, dilation): a bias for each kernel}: a quantile of its convolutions with the series of least hash, of another level for each kernel (steps of the golden ratio). Quantiles are approximate (within a ten-thousandth of the rows) and 84 x LEVELS numbers come to the driver for each."""
    one = df.select(spec.sample).distinct().orderBy(F.xxhash64(spec.sample, F.lit(seed)), spec.sample).limit(1).collect()
    out = {}
    mine = df.where(F.col(spec.sample).eqNullSafe(F.lit(one[0][0]))) if one else df
    for n, dilation in enumerate(dilations):
        rows = convolutions(mine, spec, dilation).select("col", F.posexplode("c").alias("k", "v")).groupBy("col", "k").agg(F.percentile_approx("v", LEVELS, 10_000).alias("q"))
        found = {(r["col"], r["k"]): r["q"] for r in rows.collect()}
        for f in spec.features:
            out[f, dilation] = [float(found[f, k][round(20 * ((n * len(KERNELS) + k + 1) * (math.sqrt(5) + 1) / 2 % 1))]) if (f, k) in found else 0.0 for k in range(len(KERNELS))]
    return out


def shares(df: DataFrame, spec: SeriesSpec, dilations: list[int], biases: dict[tuple[str, int], list[float]] | None = None) -> DataFrame:
    """(sample, col, dilation, shares): for each kernel the share of rows with a convolution above its bias (0 without biases)."""
    rows, places = surroundings(df, spec, dilations)
    bound = {(f, d): (biases or {}).get((f, d), [0.0] * len(KERNELS)) for f in spec.features for d in dilations}
    wide = len(KERNELS) * len(dilations)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.select([0, 1]).to_pandas().groupby(["sample", "col"], dropna=False, sort=False).ngroup().to_numpy()
            first = np.unique(codes, return_index=True)[1]
            names = b.column(1).take(first).to_pylist()
            limits = {d: np.array([bound[f, d] for f in names]) for d in dilations}
            counts = np.zeros((len(first), wide + 1), np.int64)
            counts[:, wide] = np.bincount(codes, minlength=len(first))
            for n, d in enumerate(dilations):
                for k, c in enumerate(convolved(_taps(b.column(3), places, d))):
                    counts[:, n * len(KERNELS) + k] = np.bincount(codes[c > limits[d][codes, k]], minlength=len(first))
            yield {"sample": b.column(0).take(first), "col": b.column(1).take(first), "counts": list(counts.astype(float))}

    parts = arrow_map(rows.select("sample", "col", "t", "v"), run, T.StructType([*rows.schema.fields[:2], T.StructField("counts", T.ArrayType(T.DoubleType()))]))
    added = parts.groupBy("sample", "col").agg(Summarizer.sum(array_to_vector("counts")).alias("m")).select("sample", "col", vector_to_array("m").alias("m"))
    each = F.array(*[F.struct(F.lit(d).alias("dilation"), F.slice("m", n * len(KERNELS) + 1, len(KERNELS)).alias("c")) for n, d in enumerate(dilations)])
    out = added.select("sample", "col", F.get("m", F.lit(wide)).alias("n"), F.explode(each).alias("e"))
    return out.select("sample", "col", F.col("e.dilation").alias("dilation"), F.transform("e.c", lambda c: c / F.col("n")).alias("shares"))


def rocket_points(df: DataFrame, spec: SeriesSpec, dilations: list[int] | None = None, components: int = 100, seed: int = 42) -> DataFrame:
    """(sample, features): the shares of all features and dilations (1, 2, 4, ... as far as eight steps fit into the longest series), by principal components: as many as there are samples, `components` at most."""
    if dilations is None:
        n = df.groupBy(spec.sample).count().agg(F.max("count")).first()[0] or 0
        dilations = [2**k for k in range(max(1, int(math.log2(max(n - 1, 8) / 8)) + 1))]
    found = shares(df, spec, dilations, fit_biases(df, spec, dilations, seed))
    order = F.sort_array(F.collect_list(F.struct("col", "dilation", "shares")))  # features x dilations arrays
    raw = found.groupBy("sample").agg(F.flatten(F.transform(order, lambda r: r["shares"])).alias("raw"))
    raw = written(raw, "rocket-shares").select("sample", array_to_vector("raw").alias("raw"))  # counted, fitted to and transformed
    most = min(components, raw.count(), len(KERNELS) * len(dilations) * len(spec.features))
    if most < 2:
        return raw.withColumnRenamed("raw", "features").withColumnRenamed("sample", spec.sample)
    return PCA(k=most, inputCol="raw", outputCol="features").fit(raw).transform(raw).select(F.col("sample").alias(spec.sample), "features")


def auto_select_k(df: DataFrame, spec: SeriesSpec, low: int = 2, high: int = 10, seed: int = 42) -> tuple[int, float]:
    """(k, score) of the number of clusters with the greatest 0.6 silhouette + 0.4 x the Calinski-Harabasz index over itself plus 1e-8, of k-means over rocket_points; (low, -100) with fewer than ten samples."""
    from seriesmend.plans.policy import cluster_scores

    points = rocket_points(df, spec, seed=seed)
    if points.count() < 10:
        return low, -100.0
    found = [(0.6 * silhouette + 0.4 * calinski / (calinski + 1e-8), -k) for k, calinski, silhouette, _ in cluster_scores(points, high, seed) if k >= low]
    return (-max(found)[1], max(found)[0]) if found else (low, -100.0)
