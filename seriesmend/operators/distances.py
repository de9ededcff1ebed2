"""Dissimilarity of a series from a model of it: norms, quadratic forms, piecewise lines, spectra and warped alignments.

Each takes two arrays of one length (the series and its estimate, or two windows); a greater value is less alike, empty ones give 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seriesmend.operators import kernels as K
from seriesmend.runtime import arrow_map


def euclidean(x: np.ndarray, y: np.ndarray, power: float = 1, spread: float | None = None) -> float:
    """The p-norm of the difference by the length; with spread (greatest less least value of the rows around), by that and the length to the power instead."""
    if not len(x):
        return 0.0
    norm = float(np.linalg.norm(x - y, power))
    return norm / len(x) if spread is None else norm / max(spread, K.EPS) / len(x) ** power


def mahalanobis(x: np.ndarray, y: np.ndarray, matrix: np.ndarray | None = None, density: bool = False) -> float:
    """The quadratic form of the difference with a matrix (default: 1) by the length; density: 1 less the Gaussian density of the difference with that covariance, 0 at least."""
    if not len(x):
        return 0.0
    d = x - y
    m = np.eye(len(d)) if matrix is None else matrix
    if not density:
        return float(d @ m @ d / len(d))
    sign, size = np.linalg.slogdet(m)
    if sign <= 0:
        raise ValueError("the covariance must be positive")
    return max(0.0, 1 - float(np.exp(-0.5 * (d @ np.linalg.solve(m, d) + size + len(d) * np.log(2 * np.pi)))))


def line_knots(y: np.ndarray, reach: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(knots, slopes): a line starts at a knot through the next row and holds until a row is `reach` or more off it; that row is the next knot. The last line's slope is 0 if no row follows its knot."""
    knots, slopes, at, n = [], [], 0, len(y)
    while at < n:
        slope = y[at + 1] - y[at] if at + 1 < n else 0.0
        knots.append(at)
        slopes.append(slope)
        if at + 1 >= n:
            break
        off = np.abs(y[at + 2 :] - (y[at] + slope * np.arange(2, n - at))) >= reach
        at = at + 2 + int(off.argmax()) if off.any() else n
    return np.array(knots, int), np.array(slopes, float)


def ssa(x: np.ndarray, y: np.ndarray, reach: float = 1.0) -> float:
    """Mean gap between two piecewise lines at the knots of either."""
    if not len(x):
        return 0.0

    def at(series: np.ndarray, knots: np.ndarray, slopes: np.ndarray, place: np.ndarray) -> np.ndarray:
        k = np.searchsorted(knots, place, side="right") - 1
        return series[knots[k]] + slopes[k] * (place - knots[k])

    a, b = line_knots(x, reach), line_knots(y, reach)
    places = np.union1d(a[0], b[0])
    return float(np.abs(at(x, *a, places) - at(y, *b, places)).mean())


def fourier(x: np.ndarray, y: np.ndarray, power: float = 2) -> float:
    """The norm of the spectra's difference by the length."""
    return float(np.linalg.norm(np.fft.fft(x) - np.fft.fft(y), power) / len(x)) if len(x) else 0.0


def _aligned(n: int, m: int, edge: Callable[[int, int], float], best: Callable) -> float:
    """A dynamic program over all pairs (i, j), one anti-diagonal at a time, so that each step is a vector. best(i, j, upper left, left, above) gives a diagonal's costs from those of its neighbours;
    edge(i, j) the costs at i = 0 or j = 0."""
    size = max(n, m) + 1
    before, last = np.full(size, np.inf), np.full(size, np.inf)  # by i
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n - 1, s) + 1)
        j = s - i
        now = np.full(size, np.inf)
        inner = (i > 0) & (j > 0)
        if inner.any():
            a, b = i[inner], j[inner]
            now[a] = best(a, b, before[a - 1], last[a], last[a - 1])
        for k in i[~inner]:
            now[k] = edge(int(k), int(s - k))
        before, last = last, now
    return float(last[n - 1])


def dtw(x: np.ndarray, y: np.ndarray, power: int = 2) -> float:
    """Dynamic time warping by the length; an alignment may start at any pair of an edge."""
    if not len(x):
        return 0.0
    gap = lambda i, j: np.abs(x[i] - y[j]) ** power
    return _aligned(len(x), len(y), gap, lambda i, j, corner, left, above: gap(i, j) + np.minimum(np.minimum(corner, left), above)) / len(x)


def edr(x: np.ndarray, y: np.ndarray, reach: float) -> float:
    """Edits by the length: values nearer than reach match, anything else costs 1."""
    if not len(x):
        return 0.0

    def best(i, j, corner, left, above):
        return np.where(np.abs(x[i] - y[j]) < reach, corner, 1 + np.minimum(np.minimum(corner, left), above))

    return _aligned(len(x), len(y), lambda i, j: float(i + j), best) / len(x)


def twed(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, stiffness: float = 0.1) -> float:
    """Time-warp edit distance: deleting a row costs its step, stiffness and penalty; matching two costs their gaps, now and one before, and stiffness for the time between them."""
    if not len(x):
        return 0.0
    a, b = np.r_[0.0, x], np.r_[0.0, y]

    def best(i, j, corner, left, above):
        drop_a = above + np.abs(a[i] - a[i - 1]) + stiffness + penalty
        drop_b = left + np.abs(b[j] - b[j - 1]) + stiffness + penalty
        match = corner + np.abs(a[i] - b[j]) + np.abs(a[i - 1] - b[j - 1]) + 2 * stiffness * np.abs(i - j)
        return np.minimum(np.minimum(drop_a, drop_b), match)

    return _aligned(len(a), len(b), lambda i, j: 0.0 if i == j == 0 else np.inf, best)


def between(pairs: DataFrame, x: str, y: str, measures: dict[str, Callable[[np.ndarray, np.ndarray], float]]) -> DataFrame:
    """pairs with a column for each measure of its array columns x and y; null arrays give null."""
    schema = T.StructType([*pairs.schema.fields, *[T.StructField(name, T.DoubleType()) for name in measures]])
    at = [pairs.columns.index(c) for c in (x, y)]

    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in at), strict=True))
            arrays = [None if p is None or q is None else (np.array(p, float), np.array(q, float)) for p, q in rows]
            yield {**dict(zip(b.schema.names, b.columns, strict=True)), **{name: [None if v is None else fn(*v) for v in arrays] for name, fn in measures.items()}}

    return arrow_map(pairs, run, schema)
