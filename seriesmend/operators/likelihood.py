"""Models of one series by maximum likelihood: ARMA by the innovations of a Kalman filter, GARCH by its recursion of variances.

The optimiser is a search in a box that shrinks around the best of many candidates; the filters run over time once for all candidates of a round and for many series side by side, so that a series costs little beside its arithmetic. What is searched are partial autocorrelations, so that every candidate is stationary and
invertible. Series are solved side by side; a recursion over one series is one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from seriesmend.operators import kernels as K
from seriesmend.spec import SeriesSpec, per_series

#: Rounds of the search, candidates in each, and what a box shrinks by.
ROUNDS, CANDIDATES, SHRINK = 10, 96, 0.6
#: Series that are filtered side by side.
AT_ONCE = 64
EDGE = 0.995


def searches(value: Callable[[np.ndarray], np.ndarray], starts: list[np.ndarray], low: np.ndarray, high: np.ndarray, seed: int = 5) -> np.ndarray:
    """The best point found in low..high for each of several series: first its starts and points all over the box, then points around the best, nearer in each round. Never worse than a start. value: (series x candidates x places) -> series x candidates.
    All series draw the same numbers."""
    rng = np.random.default_rng(seed)
    most = max(len(s) for s in starts)
    starts = np.clip(np.stack([np.concatenate([s, *[s[:1]] * (most - len(s))]) for s in starts]), low, high)
    drawn = low + (high - low) * rng.random((CANDIDATES, len(low)))
    points = np.concatenate([starts, np.broadcast_to(drawn, (len(starts), *drawn.shape))], axis=1)
    best, top, width, each = starts[:, 0], np.full(len(starts), -np.inf), (high - low) / 2, np.arange(len(starts))
    for _ in range(ROUNDS):
        got = np.where(np.isfinite(found := value(points)), found, -np.inf)
        at = got.argmax(axis=1)
        better = got[each, at] > top
        best, top = np.where(better[:, None], points[each, at], best), np.where(better, got[each, at], top)
        width = width * SHRINK
        points = np.clip(best[:, None] + width * rng.uniform(-1, 1, (CANDIDATES, len(low))), low, high)
    return best


def from_partial(r: np.ndarray) -> np.ndarray:
    """Coefficients of stationary autoregressions from partial autocorrelations (rows of candidates), by Durbin's recursion."""
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - r[:, k : k + 1] * before[:, ::-1]
        out[:, k] = r[:, k]
    return out


def to_partial(c: np.ndarray) -> np.ndarray | None:
    """The partial autocorrelations of an autoregression's coefficients; None if it isn't stationary."""
    c, out = c.astype(float).copy(), np.zeros(len(c))
    for k in range(len(c) - 1, -1, -1):
        r = c[k]
        if abs(r) >= 1:
            return None
        out[k] = r
        if k:
            c[:k] = (c[:k] + r * c[:k][::-1]) / (1 - r * r)
    return out


def _side_by_side(ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x series, 0 beyond a series' end; how many series have each row). ys: longest first."""
    sizes = np.array([len(y) for y in ys])
    out = np.zeros((sizes[0], len(ys)))
    for k, y in enumerate(ys):
        out[: len(y), k] = y
    return out, (sizes[None] > np.arange(sizes[0])[:, None]).sum(axis=1)


def filtered(y: np.ndarray, live: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row by row (row, forecasts from the rows before it, their variances relative to the noise's) for the first live[row] series of y and their candidates (series x candidates x coefficients)."""
    (n, c, p), m = ar.shape, max(ar.shape[2], ma.shape[2] + 1)
    t, r = np.zeros((n * c, m, m)), np.zeros((n * c, m))
    t[:, :p, 0] = ar.reshape(n * c, p)
    t[:, np.arange(m - 1), np.arange(1, m)] = 1
    r[:, 0], r[:, 1 : 1 + ma.shape[2]] = 1, ma.reshape(n * c, ma.shape[2])
    noise = r[:, :, None] * r[:, None, :]
    both = np.einsum("cij,ckl->cikjl", t, t).reshape(n * c, m * m, m * m)  # P = T P T' + R R'
    start = np.linalg.solve(np.eye(m * m) - both, noise.reshape(n * c, m * m, 1)).reshape(n, c, m, m)
    w = [np.ascontiguousarray(t[:, k, 0]).reshape(n, c) for k in range(m)]
    q = [[np.ascontiguousarray(noise[:, i, j]).reshape(n, c) for j in range(m)] for i in range(m)]
    v = [[np.ascontiguousarray(start[:, :, i, j]) for j in range(m)] for i in range(m)]
    a, k = [np.zeros((n, c)) for _ in range(m)], n
    for i in range(len(y)):
        if live[i] < k:
            k = live[i]
            w, a = [x[:k] for x in w], [x[:k] for x in a]
            q, v = [[x[:k] for x in row] for row in q], [[x[:k] for x in row] for row in v]
        f = np.maximum(v[0][0], 1e-12)
        yield i, a[0], f
        gain, off = [v[j][0] / f for j in range(m)], y[i, :k, None] - a[0]
        a = [x + g * off for x, g in zip(a, gain, strict=True)]
        a = [w[j] * a[0] + (a[j + 1] if j + 1 < m else 0) for j in range(m)]  # T shifts, and adds its first column
        v = [[v[j][l] - gain[j] * v[0][l] for l in range(m)] for j in range(m)]
        v = [[w[j] * v[0][l] + (v[j + 1][l] if j + 1 < m else 0) for l in range(m)] for j in range(m)]
        v = [[w[l] * v[j][0] + (v[j][l + 1] if l + 1 < m else 0) + q[j][l] for l in range(m)] for j in range(m)]


def innovations(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forecasts of each row of y from those before it, their variances relative to the noise's) for rows of candidates: n x candidates each."""
    found = [(m[0], v[0]) for _, m, v in filtered(*_side_by_side([y]), ar[None], ma[None])]
    return tuple(np.array([f[k] for f in found]).reshape(len(y), len(ar)) for k in range(2))


def forecasts(ys: list[np.ndarray], ar: np.ndarray, ma: np.ndarray) -> list[np.ndarray]:
    """In-sample forecasts of series (longest first), each with its own coefficients."""
    y, live = _side_by_side(ys)
    out = np.zeros_like(y)
    for i, mean, _ in filtered(y, live, ar[:, None], ma[:, None]):
        out[i, : live[i]] = mean[:, 0]
    return [out[: len(x), k] for k, x in enumerate(ys)]


def arma_likelihoods(ys: list[np.ndarray], ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """The log likelihoods, up to a constant, of series' (longest first) candidates at their best noise variance."""
    y, live = _side_by_side(ys)
    squares, logs, n = np.zeros(ar.shape[:2]), np.zeros(ar.shape[:2]), np.array([len(x) for x in ys])[:, None]
    for i, mean, var in filtered(y, live, ar, ma):
        squares[: live[i]] += (y[i, : live[i], None] - mean) ** 2 / var
        logs[: live[i]] += np.log(var)
    return -0.5 * (n * np.log(np.maximum(squares / n, 1e-300)) + logs)


def arma_likelihood(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """The log likelihood, up to a constant, of candidates at their best noise variance."""
    return arma_likelihoods([y], ar[None], ma[None])[0]


def two_regressions(y: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(autoregressive, moving average) coefficients by a long autoregression's residuals (Hannan and Rissanen); None where rows are too few."""
    long = p + q + 3
    if len(y) < 3 * long:
        return None
    x, t = K.ar_design(y, long)
    e = np.r_[np.zeros(long), t - x @ K.ols(x, t)]
    at = np.arange(long + q, len(y))
    x = np.stack([y[at - k] for k in range(1, p + 1)] + [e[at - k] for k in range(1, q + 1)], axis=1)
    b = np.linalg.lstsq(x, y[at], rcond=None)[0]
    return b[:p], b[p:]


def fit_armas(ys: list[np.ndarray], p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(autoregressive, moving average) coefficients of greatest exact likelihood of each series (longest first), which have mean 0. Not below what two regressions find, where that is stationary and invertible."""
    starts = []
    for y in ys:
        mine, found = [np.zeros(p + q)], two_regressions(y, p, q)
        if found is not None:
            parts = to_partial(found[0]), to_partial(-found[1])
            if all(x is not None for x in parts):
                mine.append(np.concatenate(parts))
        starts.append(np.array(mine))

    def of(z):
        flat = z.reshape(-1, p + q)
        return from_partial(flat[:, :p]).reshape(*z.shape[:-1], p), -from_partial(flat[:, p:]).reshape(*z.shape[:-1], q)

    return of(searches(lambda z: arma_likelihoods(ys, *of(z)), starts, np.full(p + q, -EDGE), np.full(p + q, EDGE)))


def fit_arma(y: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """fit_armas of one series."""
    ar, ma = fit_armas([y], p, q)
    return ar[0], ma[0]


def _longest_first(ys: list[np.ndarray], fn: Callable[[list[np.ndarray]], list[np.ndarray]]) -> list[np.ndarray]:
    """fn of series in the order of their lengths, in theirs; AT_ONCE at a time."""
    order, out = sorted(range(len(ys)), key=lambda k: -len(ys[k])), [np.zeros(0)] * len(ys)
    for b in range(0, len(order), AT_ONCE):
        some = order[b : b + AT_ONCE]
        for k, x in zip(some, fn([ys[k] for k in some]), strict=True):
            out[k] = x
    return out


def arma_ml(df: DataFrame, spec: SeriesSpec, p: int = 2, q: int = 1) -> DataFrame:
    """In-sample forecasts of an ARMA(p, q) model of greatest likelihood of the median-3 series; missing cells are filled linearly. Series of at most 2 (p + q) rows, and constant ones, stay as the median leaves them."""

    def fn(xs, _):
        columns = [[K.median3(c) for c in K.fill_columns(x).T] for x in xs]
        told = [(c, c.mean(), c.std()) for x in columns for c in x]
        fit = [len(c) > 2 * (p + q) and spread >= 1e-12 * max(1.0, abs(middle)) for c, middle, spread in told]
        found = iter(_longest_first([(c - middle) / spread for (c, middle, spread), f in zip(told, fit, strict=True) if f], lambda z: forecasts(z, *fit_armas(z, p, q))))
        new = iter([middle + spread * next(found) if f else c for (c, middle, spread), f in zip(told, fit, strict=True)])
        return [np.stack([next(new) for _ in x], axis=1) for x in columns]

    return per_series(df, spec, fn, many=True)


def garch_variances(r: np.ndarray, arch: np.ndarray, garch: np.ndarray, level: np.ndarray) -> np.ndarray:
    """n x candidates: variances level (1 - arch - garch) + arch r'^2 + garch v' of residuals, from what came before (primes); the first is the mean square."""
    out = np.empty((len(r), len(arch)))
    v = np.full(len(arch), (r * r).mean())
    base = level * (1 - arch - garch)
    for i, x in enumerate(r):
        out[i] = v
        v = base + arch * x * x + garch * v
    return out


def garch_likelihoods(rs: list[np.ndarray], arch: np.ndarray, garch: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Log likelihoods, up to a constant, of series' (longest first) candidates: series x candidates."""
    r, live = _side_by_side(rs)
    out = np.zeros(arch.shape)
    v = np.repeat(np.array([[(x * x).mean()] for x in rs]), arch.shape[1], axis=1)
    base = level * (1 - arch - garch)
    for i, k in enumerate(live):
        square, v = r[i, :k, None] * r[i, :k, None], v[:k]
        kept = np.maximum(v, 1e-300)
        out[:k] += np.log(kept) + square / kept
        v = base[:k] + arch[:k] * square + garch[:k] * v
    return -0.5 * out


def garch_likelihood(r: np.ndarray, arch: np.ndarray, garch: np.ndarray, level: np.ndarray) -> np.ndarray:
    return garch_likelihoods([r], arch[None], garch[None], level[None])[0]


def fit_garches(rs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(arch, garch, level) of greatest likelihood of each series' residuals (longest first), arch and garch at least 0 and together below 1. Not below that of a constant variance."""
    square = np.array([(r * r).mean() for r in rs])

    def of(z):
        both = z[..., 0]
        return both * z[..., 1], both * (1 - z[..., 1]), square.reshape(-1, *[1] * (z.ndim - 2)) * np.exp(z[..., 2])

    starts = [np.array([[0.0, 0.5, 0.0], [0.9, 0.1, 0.0]])] * len(rs)
    return of(searches(lambda z: garch_likelihoods(rs, *of(z)), starts, np.array([0.0, 0.0, -2.0]), np.array([EDGE, 1.0, 2.0])))


def fit_garch(r: np.ndarray) -> tuple[float, float, float]:
    """fit_garches of one series."""
    return tuple(float(v[0]) for v in fit_garches([r]))


def garch_score(df: DataFrame, spec: SeriesSpec, p: int = 2, q: int = 1) -> DataFrame:
    """The table with `score`: the greatest, over features, of |x - forecast| over the deviation that a GARCH(1, 1) model of these residuals expects there; forecasts by ARMA(p, q) of greatest likelihood. Missing cells are filled linearly. Series of at most 2 (p + q) rows, and
    constant ones, have 0."""

    def scores(zs):
        rs = [z - f for z, f in zip(zs, forecasts(zs, *fit_armas(zs, p, q)), strict=True)]
        return [np.abs(r) / np.sqrt(garch_variances(r, *(v[k : k + 1] for v in found))[:, 0] + 1e-12) for found in [fit_garches(rs)] for k, r in enumerate(rs)]

    def fn(xs, _):
        told = [(c, c.mean(), c.std()) for x in xs for c in K.fill_columns(x).T]
        fit = [len(c) > 2 * (p + q) and spread >= 1e-12 * max(1.0, abs(middle)) for c, middle, spread in told]
        found = iter(_longest_first([(c - middle) / spread for (c, middle, spread), f in zip(told, fit, strict=True) if f], scores))
        new = iter([next(found) if f else np.zeros(len(c)) for (c, _, _), f in zip(told, fit, strict=True)])
        return [np.max([next(new) for _ in range(x.shape[1])], axis=0) for x in xs]

    return per_series(df, spec, fn, ["score"], many=True)
