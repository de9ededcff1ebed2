"""A weighted graph of subsequence shapes, and outliers as rare paths through it (after Boniol and Palpanas, "Series2Graph", VLDB 2020).

Every subsequence is a point in a plane that shows its shape and not its level. The line through the points of successive subsequences crosses rays from the origin; where crossings of a ray crowd there is a node, and each step from crossing
to crossing is an edge between the nearest nodes. Edges are counted by one grouping, and a row is normal as far as the paths around it go over heavy edges between well-connected nodes.

All of it is relational: points are window expressions, crossings an explode of integer ranges, density, nodes and edges are groupings whose keys are (sample, feature, ray, bin), so that their size is bounded by rays and bins and not by the length of the series. Only
the projection of `projection="pca"` is numpy: one small matrix for each series, from sums that are added up where the rows are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.operators.missing import impute_linear
from seriesmend.runtime import arrow_map, written
from seriesmend.spec import SeriesSpec, long_form

#: Weights that smooth the density along a ray, by distance in bins.
SMOOTHING = {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}
S = ("sample", "col")


def fourier_weights(length: int, smooth: int) -> tuple[list[float], list[float]]:
    """Weights of the values of a subsequence in the two coordinates: the first Fourier coefficient of its running sums over `smooth` values. A constant has (0, 0)."""
    d = length - smooth + 1
    return tuple([math.fsum(f(2 * math.pi * j / d) for j in range(d) if 0 <= m - j < smooth) for m in range(length)] for f in (math.cos, math.sin))


def plane(gram: np.ndarray, total: np.ndarray, n: float, length: int, smooth: int) -> tuple[np.ndarray, np.ndarray]:
    """(length x 2 weights, 2 offsets) of the plane across the direction of constants in the space of the three principal components of running sums."""
    d = length - smooth + 1
    mean = total / n
    _, axes = np.linalg.eigh(gram / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :3]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(3)] < 0, -1, 1)
    up = axes.sum(0)
    kept = np.argsort(np.abs(up), kind="stable")[:2]
    basis = np.eye(3)[:, np.sort(kept)]
    if np.linalg.norm(up) > 1e-9:
        q, r = np.linalg.qr(np.column_stack([up, basis]))
        basis = (q * np.where(np.diag(r) < 0, -1, 1))[:, 1:]
    sums = np.array([[1.0 if 0 <= m - j < smooth else 0.0 for j in range(d)] for m in range(length)])
    return sums @ axes @ basis, mean @ axes @ basis


def principal_weights(windows: DataFrame, length: int, smooth: int) -> DataFrame:
    """(sample, col, wx, wy, bx, by) for each series, from windows (sample, col, w): tasks send sums of running sums and of their products, which Spark adds up by series and place."""
    d = length - smooth + 1
    kinds = {c: windows.schema[c] for c in S}
    parts = T.StructType([*kinds.values(), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def sums(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy().reshape(b.num_rows, length)
            c = np.lib.stride_tricks.sliding_window_view(x, smooth, axis=1).sum(2)
            codes = b.select([0, 1]).to_pandas().groupby(list(S), dropna=False, sort=False).ngroup().to_numpy()
            first = np.unique(codes, return_index=True)[1]
            made = [np.r_[m.sum(), (y := c[m]).sum(0), (y.T @ y).ravel()] for m in (codes == k for k in range(len(first)))]
            yield {"sample": b.column(0).take(first), "col": b.column(1).take(first), "sums": [m.tolist() for m in made]}

    every = arrow_map(windows.select(*S, "w"), sums, parts).select(*S, F.posexplode("sums").alias("pos", "value"))
    added = every.groupBy(*S, "pos").agg(F.sum("value").alias("value")).groupBy(*S).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("g"))
    number = T.ArrayType(T.DoubleType())
    out = T.StructType([*kinds.values(), T.StructField("wx", number), T.StructField("wy", number), T.StructField("bx", T.DoubleType()), T.StructField("by", T.DoubleType())])

    def planes(batches):
        for b in batches:
            found = []
            for g in b.column(2).to_pylist():
                n, total, gram = g[0], np.array(g[1 : d + 1]), np.array(g[d + 1 :]).reshape(d, d)
                found.append(plane(gram, total, n, length, smooth))
            yield {"sample": b.column(0), "col": b.column(1), "wx": [w[:, 0].tolist() for w, _ in found], "wy": [w[:, 1].tolist() for w, _ in found], "bx": [float(o[0]) for _, o in found], "by": [float(o[1]) for _, o in found]}

    return arrow_map(added.select(*S, F.transform("g", lambda r: r["value"]).alias("g")), planes, out)


def _dot(w: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def shape_points(df: DataFrame, spec: SeriesSpec, length: int, smooth: int, projection: str = "pca") -> DataFrame:
    """(sample, col, t, x, y): the subsequence of `length` values from row t on. Missing values are filled linearly; a series shorter than that has no points."""
    if not 1 <= smooth <= length - 2:
        raise ValueError("running sums are over 1 to length - 2 values")
    cells = long_form(impute_linear(df, spec), spec).select(F.col(spec.sample).alias("sample"), "col", F.col(spec.t).alias("t"), "value")
    w = Window.partitionBy(*S).orderBy("t")
    windows = cells.select(*S, "t", *[F.lead("value", m).over(w).alias(f"v{m}") for m in range(length)]).where(F.col(f"v{length - 1}").isNotNull())
    if projection == "fourier":
        x, y = (sum((F.lit(a) * F.col(f"v{m}") for m, a in enumerate(weights)), F.lit(0.0)) for weights in fourier_weights(length, smooth))
        return windows.select(*S, "t", x.alias("x"), y.alias("y"))
    arrays = windows.select(*S, "t", F.array(*[f"v{m}" for m in range(length)]).alias("w"))
    planes = principal_weights(arrays, length, smooth).withColumnRenamed("sample", "s")
    joined = arrays.join(planes.withColumnRenamed("col", "c"), F.col("sample").eqNullSafe(F.col("s")) & (F.col("col") == F.col("c")))
    return joined.select(*S, "t", (_dot(F.col("wx"), F.col("w")) - F.col("bx")).alias("x"), (_dot(F.col("wy"), F.col("w")) - F.col("by")).alias("y"))


def ray_crossings(points: DataFrame, rays: int, bins: int) -> DataFrame:
    """(sample, col, t, k, ray, bin): the k-th ray that the way from point t to the next one crosses, and the bin of its distance from the origin. Distances are binned as d / (d + s), s being the
    root mean square of the series' distances, so that bins are bounded. The way turns by less than half a circle; half a circle counts as forward."""
    w = Window.partitionBy(*S).orderBy("t")
    angle = F.atan2("y", "x")
    # No remainder: the whole turn of an angle just below 0 stays one, so that its distances to angles beside it keep their places.
    turn = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle) * (rays / (2 * math.pi))
    p = points.select(*S, "t", "x", "y", turn.alias("a"), F.sqrt(F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")).over(Window.partitionBy(*S))).alias("scale"))
    p = p.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "d": F.lead("a").over(w) - F.col("a")}).where("x2 IS NOT NULL")
    p = p.withColumn("d", F.when(F.col("d") > rays / 2, F.col("d") - rays).when(F.col("d") <= -rays / 2, F.col("d") + rays).otherwise(F.col("d")))
    ahead = F.col("d") > 0
    first = F.when(ahead, F.floor("a") + 1).otherwise(F.ceil("a") - 1)
    last = F.when(ahead, F.floor(F.col("a") + F.col("d"))).otherwise(F.ceil(F.col("a") + F.col("d")))
    p = p.withColumns({"first": first, "last": last}).where(F.when(ahead, F.col("last") >= F.col("first")).otherwise((F.col("d") < 0) & (F.col("last") <= F.col("first"))))
    p = p.select("*", F.posexplode(F.sequence("first", "last")).alias("k", "at")).withColumn("ray", F.pmod("at", F.lit(rays)))
    angle = F.col("ray") * (2 * math.pi / rays)
    across = F.cos(angle) * (F.col("y2") - F.col("y")) - F.sin(angle) * (F.col("x2") - F.col("x"))
    distance = F.greatest(F.when(across != 0, (F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / across).otherwise(0.0), F.lit(0.0))
    p = p.withColumn("distance", distance)
    return p.select(*S, "t", "k", "ray", F.least(F.floor(bins * F.col("distance") / (F.col("distance") + F.col("scale"))), F.lit(bins - 1)).alias("bin"))


def nodes(crossings: DataFrame, bins: int) -> DataFrame:
    """(sample, col, ray, bin, node): for each bin with crossings or beside one, the bin of the nearest node of its ray (the lower of two): bins whose smoothed count is above that of the bin before and not below the next one's."""
    spread = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in SMOOTHING.items()])
    dense = crossings.groupBy(*S, "ray", "bin").count().select(*S, "ray", "bin", "count", F.explode(spread).alias("e"))
    smoothed = dense.select(*S, "ray", (F.col("bin") + F.col("e.o")).alias("bin"), (F.col("count") * F.col("e.w")).alias("n")).where(F.col("bin").between(0, bins - 1)).groupBy(*S, "ray", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*S, "ray").orderBy("bin")
    before = F.when(F.lag("bin").over(w) == F.col("bin") - 1, F.lag("n").over(w)).otherwise(0)
    after = F.when(F.lead("bin").over(w) == F.col("bin") + 1, F.lead("n").over(w)).otherwise(0)
    tops = smoothed.withColumn("top", F.when((F.col("n") > before) & (F.col("n") >= after), F.col("bin")))
    low = F.last("top", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.first("top", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = F.when(low.isNull() | (high - F.col("bin") < F.col("bin") - low), high).otherwise(low)
    return tops.select(*S, "ray", "bin", near.alias("node"))


def shape_path(df: DataFrame, spec: SeriesSpec, length: int, smooth: int, rays: int, bins: int, projection: str) -> DataFrame:
    """(sample, col, t, from_ray, from_bin, to_ray, to_bin): each step of each series' way through its nodes."""
    crossings = written(ray_crossings(shape_points(df, spec, length, smooth, projection), rays, bins), "graph-crossings")
    named = {c: f"n_{c}" for c in (*S, "ray", "bin")}
    found = nodes(crossings, bins).withColumnsRenamed(named)
    on = F.col("sample").eqNullSafe(F.col("n_sample")) & (F.col("col") == F.col("n_col")) & (F.col("ray") == F.col("n_ray")) & (F.col("bin") == F.col("n_bin"))
    w = Window.partitionBy(*S).orderBy("t", "k")
    steps = crossings.join(found, on).select(*S, "t", "k", F.col("ray").alias("from_ray"), F.col("node").alias("from_bin"))
    return steps.withColumns({"to_ray": F.lead("from_ray").over(w), "to_bin": F.lead("from_bin").over(w)}).where("to_ray IS NOT NULL").drop("k")


def shape_edges(path: DataFrame) -> DataFrame:
    """(sample, col, from_ray, from_bin, to_ray, to_bin, weight): how often each edge is gone."""
    return path.groupBy(*S, "from_ray", "from_bin", "to_ray", "to_bin").agg(F.count("*").alias("weight"))


def series2graph(df: DataFrame, spec: SeriesSpec, length: int = 10, smooth: int | None = None, query: int | None = None, rays: int = 24, bins: int = 64, projection: str = "pca") -> DataFrame:
    """The table with `score`: 1 - normality / greatest normality of the series, the greatest over features. Normality is the mean, over the `query` (2 x length) subsequences up to a row, of weight x (degree - 1) of the edges they go: how often the edge is gone in
    its series, and how many edges its first node has. projection: "pca" of each series, or "fourier", which is the same for all. Missing values are filled linearly; series with at most `length` rows have score 0; samples without a key are one sample."""
    smooth, query = smooth or max(1, length // 3), query or 2 * length
    path = written(shape_path(df, spec, length, smooth, rays, bins, projection), "graph-path")
    edges = shape_edges(path)
    ends = edges.select(*S, F.explode(F.array(F.struct(F.col("from_ray").alias("ray"), F.col("from_bin").alias("bin")), F.struct(F.col("to_ray").alias("ray"), F.col("to_bin").alias("bin")))).alias("e"))
    degrees = ends.groupBy(*S, F.col("e.ray").alias("d_ray"), F.col("e.bin").alias("d_bin")).agg(F.count("*").alias("degree")).withColumnsRenamed({"sample": "d_sample", "col": "d_col"})
    worth = edges.join(degrees, F.col("sample").eqNullSafe(F.col("d_sample")) & (F.col("col") == F.col("d_col")) & (F.col("from_ray") == F.col("d_ray")) & (F.col("from_bin") == F.col("d_bin")))
    names = (*S, "from_ray", "from_bin", "to_ray", "to_bin")
    worth = worth.select(*[F.col(c).alias(f"e_{c}") for c in names], (F.col("weight") * (F.col("degree") - 1)).alias("worth"))
    on = F.col("sample").eqNullSafe(F.col("e_sample"))
    for c in names[1:]:
        on = on & (F.col(c) == F.col(f"e_{c}"))
    gone = path.join(worth, on).groupBy(*S, "t").agg(F.sum("worth").alias("v")).withColumnsRenamed({"sample": "g_sample", "col": "g_col", "t": "g_t"})
    cells = df.select(F.col(spec.sample).alias("sample"), F.explode(F.array(*[F.lit(f) for f in spec.features])).alias("col"), F.col(spec.t).alias("t"))
    rows = cells.join(gone, F.col("sample").eqNullSafe(F.col("g_sample")) & (F.col("col") == F.col("g_col")) & (F.col("t") == F.col("g_t")), "left")
    whole = Window.partitionBy(*S)
    v = F.when(F.col("t") < F.count("*").over(whole) - length, F.coalesce(F.col("v"), F.lit(0)))
    rows = rows.select(*S, "t", v.alias("v")).withColumn("normal", F.avg("v").over(whole.orderBy("t").rowsBetween(1 - query, 0)))
    most = F.max("normal").over(whole)
    rows = rows.withColumn("score", F.when(most > 0, F.coalesce(1 - F.col("normal") / most, F.lit(0.0))).otherwise(0.0))
    scores = rows.groupBy("sample", "t").agg(F.max("score").alias("score")).withColumnsRenamed({"sample": "s_sample", "t": "s_t"})
    kept = df.drop("score")
    return kept.join(scores, F.col(spec.sample).eqNullSafe(F.col("s_sample")) & (F.col(spec.t) == F.col("s_t"))).drop("s_sample", "s_t")
