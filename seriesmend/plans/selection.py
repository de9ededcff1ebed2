"""Choice of detectors from statistics of a series, by a factorization machine over meta-features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmend.operators.detect import DETECTORS
from seriesmend.spec import SeriesSpec, long_form

#: What is chosen without a fitted model.
DEFAULT = ["ZScore", "MAD", "Mahalanobis"]
SIZE = 200


def list_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, min, max, mean, std, skew, kurtosis) of a column, the last three as populations."""
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, gini): Gini coefficient of the values, moved up so that the least is not below 0."""
    w = Window.partitionBy(*by)
    x = df.withColumn("__x", F.col(value) - F.least(F.min(value).over(w), F.lit(0.0)) + 1e-7).withColumn("__r", F.row_number().over(w.orderBy(value))).withColumn("__n", F.count("*").over(w))
    return x.groupBy(*by).agg((F.sum((2 * F.col("__r") - F.col("__n") - 1) * F.col("__x")) / (F.first("__n") * F.sum("__x"))).alias("gini"))


def meta_features(df: DataFrame, spec: SeriesSpec) -> np.ndarray:
    """A vector of SIZE statistics of a whole set: sizes, statistics over columns of statistics of columns, correlations; the rest is 0."""
    cells = long_form(df, spec).where("value is not null")
    per = list_statistics(cells, ["col"], "value").join(gini(cells, ["col"], "value"), "col")
    q = cells.groupBy("col").agg(F.percentile("value", F.array(*[F.lit(p) for p in (0.01, 0.25, 0.5, 0.75, 0.99)])).alias("q"))
    rows = per.join(q, "col").collect()  # a row for each feature
    n = df.count()
    pairs = [(a, b) for i, a in enumerate(spec.features) for b in spec.features[i + 1 :]]
    corr = list(df.agg(*[F.corr(a, b) for a, b in pairs]).first()) if pairs else []
    stats = lambda v: [float(np.min(v)), float(np.max(v)), float(np.mean(v)), float(np.std(v))] if len(v) else [0.0] * 4
    out = [float(n), float(len(spec.features)), float(np.log(max(n, 1)))]
    for name in ("min", "max", "mean", "std", "skew", "kurtosis", "gini"):
        out += stats([r[name] or 0.0 for r in rows])
    for k in range(5):
        out += stats([r["q"][k] for r in rows])
    out += stats([c or 0.0 for c in corr])
    v = np.nan_to_num(np.array(out[:SIZE]))
    return np.r_[v, np.zeros(SIZE - len(v))]


class FactorizationMachine:
    """score_m = w_m x + 1/2 sum_k ((x V_mk)^2 - x^2 V_mk^2), fitted to a table of performances by gradient descent."""

    def __init__(self, models: list[str], size: int = SIZE, width: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.models, self.bias, self.linear, self.factors = models, np.zeros(len(models)), np.zeros((len(models), size)), rng.normal(0, 0.01, (len(models), size, width))
        self.mean, self.scale = np.zeros(size), np.ones(size)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (np.atleast_2d(x) - self.mean) / self.scale
        a = np.einsum("nf,mfk->nmk", z, self.factors)
        b = np.einsum("nf,mfk->nmk", z**2, self.factors**2)
        return self.bias + z @ self.linear.T + 0.5 * (a**2 - b).sum(-1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 200, rate: float = 0.01) -> FactorizationMachine:
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        z = (x - self.mean) / self.scale
        for _ in range(epochs):
            e = (self.scores(x) - y) / len(x)
            a = np.einsum("nf,mfk->nmk", z, self.factors)
            self.bias -= rate * e.sum(0)
            self.linear -= rate * e.T @ z
            self.factors -= rate * (np.einsum("nm,nmk,nf->mfk", e, a, z) - np.einsum("nm,nf,mfk->mfk", e, z**2, self.factors))
        return self

    def select(self, x: np.ndarray, n: int = 3) -> list[str]:
        return [self.models[i] for i in np.argsort(-self.scores(x)[0], kind="stable")[:n]]


def select_detectors(df: DataFrame, spec: SeriesSpec, model: FactorizationMachine | None = None, n: int = 3) -> list[str]:
    return [m for m in (model.select(meta_features(df, spec), n) if model else DEFAULT) if m in DETECTORS][:n]


def top_k_hits(pred: np.ndarray, real: np.ndarray, n: int, k: int) -> int:
    """In how many rows one of the k best predictions is among the n really best."""
    a, b = np.argsort(-pred, axis=1, kind="stable")[:, :k], np.argsort(-real, axis=1, kind="stable")[:, :n]
    return int(sum(bool(set(p) & set(r)) for p, r in zip(a, b, strict=True)))


def mean_rank(pred: np.ndarray, real: np.ndarray) -> float:
    """Mean rank of the predicted best among the really best, from 0 to 1."""
    pick = pred.argmax(1)
    rank = (real > real[np.arange(len(real)), pick][:, None]).sum(1)
    return float((rank / max(real.shape[1] - 1, 1)).mean())
