"""Repairs of outliers and missing cells. Each takes (df, spec) and returns the same rows with repaired features; time never changes.

`labels`: name of a 0/1 column; then only rows with 1 are repaired, from a fit on the others, and the operator's own detection is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmend.operators import kernels as K
from seriesmend.operators.missing import _around
from seriesmend.spec import SeriesSpec, per_series

# ---- missing cells -------------------------------------------------------------------------------------------------


def impute_interpolation(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Linear between valid cells; beyond them the line through the two nearest valid ones, kept within the column's range. One valid cell is constant, none takes the mean over all samples."""
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in spec.features])
    rows = df.crossJoin(F.broadcast(means))  # one row
    out = {}
    for c in spec.features:
        a, ta, b, tb = _around(c, spec)
        valid = F.when(F.col(c).isNotNull(), F.struct(F.col(spec.t).alias("t"), F.col(c).alias("x")))
        rank = lambda n: F.nth_value(valid, n, True).over(spec.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        back = Window.partitionBy(spec.sample).orderBy(F.desc(spec.t)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        tail = lambda n: F.nth_value(valid, n, True).over(back)
        line = lambda p, q: p["x"] + (q["x"] - p["x"]) * (F.col(spec.t) - p["t"]) / (q["t"] - p["t"])
        lo, hi = F.min(c).over(spec.whole), F.max(c).over(spec.whole)
        within = lambda v: F.greatest(lo, F.least(hi, v))
        inside = a + (b - a) * (F.col(spec.t) - ta) / (tb - ta)
        head = F.when(a.isNull() & rank(2).isNotNull(), within(line(rank(1), rank(2))))
        end = F.when(b.isNull() & tail(2).isNotNull(), within(line(tail(1), tail(2))))
        out[c] = F.coalesce(F.col(c), inside, head, end, a, b, F.col(f"__m_{c}"), F.lit(0.0))
    return rows.withColumns(out).drop(*[f"__m_{c}" for c in spec.features])


def _gaps(fill: Callable[[np.ndarray, np.ndarray], np.ndarray], clip: bool = True):
    """Kernel: fill(column with its gaps filled in line, gap mask) where cells are missing, within the column's range."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        out = x.copy()
        for j in range(x.shape[1]):
            gap = ~np.isfinite(x[:, j])
            if not gap.any():
                continue
            line = K.fill_linear(np.where(gap, np.nan, x[:, j]))
            if gap.all():
                out[:, j] = line
                continue
            v = fill(line, gap)
            v = np.where(np.isfinite(v), v, line)
            out[gap, j] = (np.clip(v, x[~gap, j].min(), x[~gap, j].max()) if clip else v)[gap]
        return out

    return kernel


def impute_moving_average(df: DataFrame, spec: SeriesSpec, window: int = 5) -> DataFrame:
    """The centred mean (nearest values beyond the ends) of the series filled in line, at missing cells."""

    def fill(y: np.ndarray, _) -> np.ndarray:
        h = window // 2
        return np.convolve(np.r_[np.full(h, y[0]), y, np.full(window - 1 - h, y[-1])], np.ones(window) / window, "valid")

    return per_series(df, spec, _gaps(fill))


def impute_ar(df: DataFrame, spec: SeriesSpec, lags: int = 1) -> DataFrame:
    """In-sample predictions of AR(lags) with a constant, fitted on the line fill; the line where a prediction has no lags."""

    def fill(y: np.ndarray, _) -> np.ndarray:
        if len(y) <= 2 * lags + 1:
            return y
        x, t = K.ar_design(y, lags)
        return np.r_[np.full(lags, np.nan), x @ K.ols(x, t)]

    return per_series(df, spec, _gaps(fill))


def impute_kalman_filter(df: DataFrame, spec: SeriesSpec, steps: int = 5) -> DataFrame:
    """The smoothed level of a local-level model of the line fill, at missing cells."""
    return per_series(df, spec, _gaps(lambda y, _: K.local_level(y, steps)))


def impute_gmm(df: DataFrame, spec: SeriesSpec, components: int = 5, rounds: int = 5) -> DataFrame:
    """Missing cells take the mixture's means by responsibility, again and again."""

    def kernel(xs: list[np.ndarray], _) -> list[np.ndarray]:
        gaps = [~np.isfinite(x) for x in xs]
        out = [K.fill_columns(np.where(gap, np.nan, x)) for x, gap in zip(xs, gaps, strict=True)]
        some = [i for i, (x, gap) in enumerate(zip(xs, gaps, strict=True)) if gap.any() and len(x) > components]
        for _ in range(rounds if some else 0):
            for i, [(means, resp, _)] in zip(some, K.gmm_many([out[i] for i in some], components), strict=True):
                out[i] = np.where(gaps[i], resp @ means, out[i])
        return out

    return per_series(df, spec, kernel, many=True)


def hidden_states(y: np.ndarray, k: int, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, variances, likeliest path) of a Gaussian hidden Markov model of one column, by Baum-Welch in logs and Viterbi."""
    return hidden_states_many([y], k, rounds, seed)[0]


def hidden_states_many(ys: list[np.ndarray], k: int, rounds: int = 20, seed: int = 0, at_once: int = 128) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """hidden_states of each column; columns with as many states go side by side, longest first."""
    found = [K.kmeans(y[:, None], k, seed) for y in ys]
    out: list = [None] * len(ys)
    order = sorted(range(len(ys)), key=lambda i: (-len(found[i][0]), -len(ys[i])))
    while order:
        states = len(found[order[0]][0])
        some = [i for i in order[:at_once] if len(found[i][0]) == states]
        order = order[len(some) :]
        for i, got in zip(some, _baum_welch([ys[i] for i in some], [found[i] for i in some], rounds), strict=True):
            out[i] = got
    return out


def _baum_welch(ys: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Columns longest first, with centres and labels to start from, all of as many states."""
    sizes, k = np.array([len(y) for y in ys]), len(found[0][0])
    n, each = sizes[0], np.arange(len(ys))
    least = np.array([1e-3 * max(y.var(), K.EPS) for y in ys])[:, None]
    mean = np.stack([centres[:, 0] for centres, _ in found])
    var = np.maximum([[y[label == j].var() if (label == j).any() else 0 for j in range(k)] for y, (_, label) in zip(ys, found, strict=True)], least)
    y, there = np.zeros((n, len(ys), 1)), (np.arange(n)[:, None] < sizes)[:, :, None]
    for i, v in enumerate(ys):
        y[: len(v), i, 0] = v
    live = there.sum(axis=(1, 2))
    trans, start = np.full((len(ys), k, k), 0.1 / max(k - 1, 1)), np.full((len(ys), k), 1 / k)
    trans[:, range(k), range(k)] = 0.9 if k > 1 else 1.0
    for _ in range(rounds):
        e = np.where(there, np.exp(-0.5 * (y - mean) ** 2 / var) / np.sqrt(var) + 1e-300, 0.0)
        a, b, c = np.zeros((n, len(ys), k)), np.ones((n, len(ys), k)), np.ones((n, len(ys), 1))
        for i, m in enumerate(live):
            a[i, :m] = (start if i == 0 else (a[i - 1, :m, None] @ trans[:m])[:, 0]) * e[i, :m]
            c[i, :m] = a[i, :m].sum(axis=1, keepdims=True)
            a[i, :m] /= c[i, :m]
        for i in range(n - 2, -1, -1):
            m = live[i + 1]
            b[i, :m] = (trans[:m] @ (e[i + 1, :m] * b[i + 1, :m])[:, :, None])[:, :, 0] / c[i + 1, :m]
        g = a * b
        g /= np.where(there, g.sum(axis=2, keepdims=True), 1)
        xi = trans * np.einsum("tsi,tsj->sij", a[:-1], e[1:] * b[1:] / c[1:]) + 1e-6
        trans = xi / xi.sum(axis=2, keepdims=True)
        start, w = g[0], g.sum(axis=0) + 1e-10
        mean = (g * y).sum(axis=0) / w
        var = np.maximum((g * (y - mean) ** 2).sum(axis=0) / w, least)
    logs, steps = -0.5 * (y - mean) ** 2 / var - 0.5 * np.log(var), np.log(trans)
    score, back = np.log(start + 1e-300) + logs[0], np.zeros((n, len(ys), k), int)
    for i in range(1, n):
        step = score[: live[i], :, None] + steps[: live[i]]
        back[i, : live[i]] = step.argmax(axis=1)
        score[: live[i]] = step.max(axis=1) + logs[i, : live[i]]
    path = np.zeros((n, len(ys)), int)
    path[sizes - 1, each] = score.argmax(axis=1)
    for i in range(n - 1, 0, -1):
        m = each[: live[i]]
        path[i - 1, m] = back[i, m, path[i, m]]
    return [(mean[i], var[i], path[: sizes[i], i]) for i in each]


def impute_hmm(df: DataFrame, spec: SeriesSpec, states: int = 5) -> DataFrame:
    """Missing cells take the mean of their likeliest state."""

    def kernel(xs, _):
        lines: list[np.ndarray] = []
        for x in xs:  # what is to be filled, in the order in which it is
            _gaps(lambda y, _: lines.append(y) or y)(x, None)
        told = iter([mean[path] for mean, _, path in hidden_states_many(lines, states)])
        return [_gaps(lambda y, _: next(told))(x, None) for x in xs]

    return per_series(df, spec, kernel, many=True)


class KernelRidge:
    """Regression with Gaussian kernels over standardised inputs, in place of support vectors. All rows count, however many: the coefficients come by conjugate gradients, whose products
    with the kernel matrix are made in blocks, so that memory grows with the rows and not with their square."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, most: int = 500, block: int = 1024):
        self.middle, self.unit, self.gamma, self.block = x.mean(0), x.std(0) + K.EPS, 1 / max(x.shape[1], 1), block
        self.rows, self.mean = (x - self.middle) / self.unit, y.mean()
        goal = y - self.mean
        self.weights, rest = np.zeros(len(y)), goal.copy()
        way, size = rest.copy(), rest @ rest
        for _ in range(most):
            if size <= 1e-16 * max(goal @ goal, K.EPS):
                break
            bent = self._times(self.rows, way) + ridge * way
            step = size / (way @ bent)
            self.weights, rest = self.weights + step * way, rest - step * bent
            size, before = rest @ rest, size
            way = rest + size / before * way

    def _times(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        own = (self.rows**2).sum(axis=1)
        for lo in range(0, len(at), self.block):
            part = at[lo : lo + self.block]
            far = np.maximum((part**2).sum(axis=1)[:, None] + own[None] - 2 * part @ self.rows.T, 0)
            out[lo : lo + self.block] = np.exp(-self.gamma * far) @ weights
        return out

    def __call__(self, new: np.ndarray) -> np.ndarray:
        return self.mean + self._times((new - self.middle) / self.unit, self.weights)


def impute_svr(df: DataFrame, spec: SeriesSpec, look_back: int = 5) -> DataFrame:
    """Missing cells one after another from the last look_back values, by kernel regression on all windows without gaps. Not kept within the range."""

    def fill(y: np.ndarray, gap: np.ndarray) -> np.ndarray:
        out = y.copy()
        if len(y) <= look_back + 2 or not gap.any():
            return out
        w = np.lib.stride_tricks.sliding_window_view(y, look_back + 1)
        train = w[~np.lib.stride_tricks.sliding_window_view(gap, look_back + 1).any(1)]
        if len(train) < 3:
            return out
        model = KernelRidge(train[:, :-1], train[:, -1])
        for i in np.flatnonzero(gap):
            if i >= look_back:
                out[i] = model(out[None, i - look_back : i])[0]
        return out

    return per_series(df, spec, _gaps(fill, clip=False))


# ---- outliers ------------------------------------------------------------------------------------------------------


def _columns(fn: Callable[[np.ndarray], np.ndarray]):
    """Kernel: fn on each column filled in line."""
    return lambda x, _: np.stack([fn(c) for c in K.fill_columns(x).T], axis=1)


def moving_average(df: DataFrame, spec: SeriesSpec, window: int = 5) -> DataFrame:
    """The centred mean of `window` rows; the first and last rows take the mean of the first or last window."""
    h = window // 2
    w, n = spec.rows(h, h), F.count("*").over(spec.whole)
    t = F.col(spec.t)
    out = {}
    for c in spec.features:
        head = F.avg(F.when(t < window, F.col(c))).over(spec.whole)
        end = F.avg(F.when(t >= n - window, F.col(c))).over(spec.whole)
        out[c] = F.when(t < h, head).when(t >= n - h, end).otherwise(F.avg(c).over(w))
    return df.withColumns(out)


def autoregressive(df: DataFrame, spec: SeriesSpec, lags: int = 3) -> DataFrame:
    """In-sample AR(lags) fit of the median-3 series; the first rows stay as the median leaves them."""

    def fn(y: np.ndarray) -> np.ndarray:
        y = K.median3(y)
        if len(y) <= 2 * lags + 1:
            return y
        x, t = K.ar_design(y, lags)
        return np.r_[y[:lags], x @ K.ols(x, t)]

    return per_series(df, spec, _columns(fn))


def arma(df: DataFrame, spec: SeriesSpec, p: int = 2, q: int = 1) -> DataFrame:
    """In-sample ARMA(p, q) predictions of the median-3 series by two regressions (a long AR gives the innovations), in place of maximum likelihood."""

    def fn(y: np.ndarray) -> np.ndarray:
        y = K.median3(y)
        long = max(p, q) + 3
        if len(y) <= 3 * long:
            return y
        x, t = K.ar_design(y, long)
        e = np.r_[np.zeros(long), t - x @ K.ols(x, t)]
        m = max(p, q)
        cols = [y[m - k - 1 : len(y) - k - 1] for k in range(p)] + [e[m - k - 1 : len(y) - k - 1] for k in range(q)]
        z = np.stack([*cols, np.ones(len(y) - m)], axis=1)
        return np.r_[y[:m], z @ K.ols(z, y[m:])]

    return per_series(df, spec, _columns(fn))


def _masked_level(bad: Callable[[np.ndarray], np.ndarray]):
    def kernel(x: np.ndarray, _) -> np.ndarray:
        out = x.copy()
        for j in range(x.shape[1]):
            y = x[:, j].copy()
            good = np.isfinite(y)
            if good.any():
                y[good & bad(y)] = np.nan
            out[:, j] = K.local_level(y)
        return out

    return kernel


def kalman_filter(df: DataFrame, spec: SeriesSpec, k: float = 5.0) -> DataFrame:
    """Values outside of Q1 - k IQR .. Q3 + k IQR are masked; the smoothed level replaces the series."""

    def bad(y: np.ndarray) -> np.ndarray:
        q1, q3 = np.nanquantile(y, [0.25, 0.75])
        return (y < q1 - k * (q3 - q1)) | (y > q3 + k * (q3 - q1))

    return per_series(df, spec, _masked_level(bad))


def state_space(df: DataFrame, spec: SeriesSpec, k: float = 4.0) -> DataFrame:
    """Values over k deviations from the median are masked; the smoothed level replaces the series."""
    return per_series(df, spec, _masked_level(lambda y: np.abs(y - np.nanmedian(y)) > k * np.nanstd(y)))


def interpolation(df: DataFrame, spec: SeriesSpec, step: int = 3) -> DataFrame:
    """Every step-th row and the last are kept, the others lie on the lines between them."""
    last = F.max(spec.t).over(spec.whole)
    knots = df.withColumns({c: F.when((F.col(spec.t) % step == 0) | (F.col(spec.t) == last), F.col(c)) for c in spec.features})
    from seriesmend.operators.missing import impute_linear

    return impute_linear(knots, spec)


def trajectory_simplification(df: DataFrame, spec: SeriesSpec, tolerance: float = 0.01) -> DataFrame:
    """Douglas-Peucker knots within tolerance, joined by monotone cubic (PCHIP) pieces."""

    def fn(y: np.ndarray) -> np.ndarray:
        n = len(y)
        keep = np.zeros(n, bool)
        keep[[0, n - 1]] = True
        open_ = [(0, n - 1)]
        while open_:
            a, b = open_.pop()
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            d = np.abs((y[b] - y[a]) * (at - a) - (b - a) * (y[at] - y[a])) / np.hypot(b - a, y[b] - y[a])
            i = int(d.argmax())
            if d[i] > tolerance:
                keep[at[i]] = True
                open_ += [(a, at[i]), (at[i], b)]
        return pchip(np.flatnonzero(keep).astype(float), y[keep], np.arange(n, dtype=float))

    return per_series(df, spec, _columns(fn))


def pchip(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Monotone piecewise cubic interpolation with weighted harmonic slopes."""
    if len(x) < 3:
        return np.interp(new, x, y)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = d[1:] * d[:-1] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)
    for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        m[end] = 0 if np.sign(s) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s
    i = np.clip(np.searchsorted(x, new, "right") - 1, 0, len(h) - 1)
    u = (new - x[i]) / h[i]
    return (1 + 2 * u) * (1 - u) ** 2 * y[i] + u * (1 - u) ** 2 * h[i] * m[i] + u**2 * (3 - 2 * u) * y[i + 1] + u**2 * (u - 1) * h[i] * m[i + 1]


def exponential_smoothing(df: DataFrame, spec: SeriesSpec, alpha: float = 0.5) -> DataFrame:
    """One-step predictions s of the median-3 series: s' = alpha x + (1 - alpha) s, from s = x[0]."""

    def fn(y: np.ndarray) -> np.ndarray:
        y = K.median3(y)
        out = np.empty_like(y)
        s = y[0]
        for i, v in enumerate(y):
            out[i] = s
            s = alpha * v + (1 - alpha) * s
        return out

    return per_series(df, spec, _columns(fn))


def svr(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Kernel regression of value on time, over all rows."""

    def fn(y: np.ndarray) -> np.ndarray:
        at = np.arange(len(y), dtype=float)[:, None]
        return KernelRidge(at, y, 0.1)(at) if len(y) > 3 else y

    return per_series(df, spec, _columns(fn))


def _robust_gaussian(x: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    rows, d = x, x.shape[1]
    for _ in range(rounds + 1):
        mean, cov = rows.mean(0), np.atleast_2d(np.cov(rows, rowvar=False)) + 1e-6 * np.eye(d)
        q = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
        rows = x[q < 3 * d] if (q < 3 * d).sum() > d + 1 else rows
    return mean, cov


def _conditional(x: np.ndarray, bad: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """The bad dimensions of a row given the others."""
    out = x.copy()
    if bad.all():
        return mean.copy()
    if bad.any():
        out[bad] = mean[bad] + cov[np.ix_(bad, ~bad)] @ np.linalg.pinv(cov[np.ix_(~bad, ~bad)]) @ (x[~bad] - mean[~bad])
    return out


def maximum_likelihood(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Dimensions beyond 2 deviations of a robust Gaussian take their conditional mean in rows of squared distance over 3 D."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        if len(x) < x.shape[1] + 3:
            return x
        mean, cov = _robust_gaussian(x)
        q = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
        bad = (np.abs(x - mean) > 2 * np.sqrt(np.diag(cov))) & (q >= 3 * x.shape[1])[:, None]
        return np.stack([_conditional(r, b, mean, cov) for r, b in zip(x, bad, strict=True)])

    return per_series(df, spec, kernel)


def bayesian_model(df: DataFrame, spec: SeriesSpec, k: float = 3.0) -> DataFrame:
    """Each column regressed on the others with an evidence-tuned ridge; values over k residual deviations off take the prediction. One column alone is left as it is."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        out = x.copy()
        n, d = x.shape
        if d < 2 or n < d + 2:
            return out
        for j in range(d):
            z = np.delete(x, j, axis=1)
            m, y = z - z.mean(0), x[:, j] - x[:, j].mean()
            values, vectors = np.linalg.eigh(m.T @ m)
            beta, lam = 1 / max(y.var(), K.EPS), 1.0
            for _ in range(30):
                w = vectors @ ((vectors.T @ (m.T @ y)) / (values + lam / beta))
                g = (values / (values + lam / beta)).sum()
                lam, beta = (g + 1e-6) / (w @ w + 1e-6), (n - g + 1e-6) / (((y - m @ w) ** 2).sum() + 1e-6)
            r = y - m @ w
            bad = np.abs(r) > k * r.std()
            out[bad, j] = (m @ w + x[:, j].mean())[bad]
        return out

    return per_series(df, spec, kernel)


def markov_model(df: DataFrame, spec: SeriesSpec, k: float = 3.0) -> DataFrame:
    """Blocks whose steps deviate by over k robust deviations lie on a blend of the drifts from before and back from after."""

    def fn(y: np.ndarray) -> np.ndarray:
        out, d = y.copy(), np.diff(y)
        if not len(d):
            return out
        med = np.median(d)
        mad = 1.4826 * np.median(np.abs(d - med)) + K.EPS
        bad = np.r_[False, np.abs(d - med) / mad > k]
        i = 0
        while i < len(y):
            if not bad[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(y) and bad[j + 1]:
                j += 1
            m = j - i + 1
            left = out[i - 1] + med * np.arange(1, m + 1) if i else None
            right = y[j + 1] - med * np.arange(m, 0, -1) if j + 1 < len(y) else None
            w = np.arange(1, m + 1) / (m + 1)
            out[i : j + 1] = right if left is None else left if right is None else (1 - w) * left + w * right
            i = j + 1
        return out

    return per_series(df, spec, _columns(fn))


def hmm(df: DataFrame, spec: SeriesSpec, states: int = 3) -> DataFrame:
    """Points in a state of a variance over 4 times the least, or 3 deviations off, take the nearest mean of the other states."""

    def fn(y: np.ndarray) -> np.ndarray:
        if len(y) < 10 or y.std() < K.EPS:
            return y
        mean, var, path = hidden_states(y, states)
        calm = var <= 4 * var.min()
        bad = ~calm[path] | (np.abs(y - y.mean()) > 3 * y.std())
        out = y.copy()
        out[bad] = mean[calm][np.abs(y[bad, None] - mean[calm]).argmin(1)]
        return out

    return per_series(df, spec, _columns(fn))


def smurf(df: DataFrame, spec: SeriesSpec, half: int = 5) -> DataFrame:
    """Values over 3 deviations of their centred window plus a tenth of the sample's take the window's mean."""
    w = spec.rows(half, half)
    out = {}
    for c in spec.features:
        far = F.abs(F.col(c) - F.avg(c).over(w)) > 3 * F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)) + 0.1 * F.stddev_pop(c).over(spec.whole)
        out[c] = F.when(far, F.avg(c).over(w)).otherwise(F.col(c))
    return df.withColumns(out)


def spatio_temporal(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows of Mahalanobis distance over 3 D or a jump over 5 medians take 0.7 of their conditional mean and 0.3 of the mean of the neighbours."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        n, d = x.shape
        if n < d + 3:
            return x
        mean, cov = _robust_gaussian(x)
        q = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
        jump = np.r_[0, np.abs(np.diff(x, axis=0)).sum(1)]
        out = x.copy()
        for i in np.flatnonzero((q > 3 * d) | (jump > 5 * max(np.median(jump), K.EPS))):
            near = np.r_[x[max(0, i - 2) : i], x[i + 1 : i + 3]]
            bad = np.abs(x[i] - mean) > 2 * np.sqrt(np.diag(cov))
            out[i] = 0.7 * _conditional(x[i], bad, mean, cov) + 0.3 * near.mean(0)
        return out

    return per_series(df, spec, kernel)


def _mixture_repair(components: int, kind: str, share: float, own: float, half: int):
    """Kernel: the least likely share of rows take own x the mixture's expectation + (1 - own) x the median of the rows around."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        if len(x) < 3 * components:
            return x
        m, s = x.mean(0), x.std(0) + K.EPS
        _, means, _, resp, ll = K.gmm((x - m) / s, components, kind)
        bad = ll < np.quantile(ll, share)
        expect = resp @ means * s + m
        out = x.copy()
        for i in np.flatnonzero(bad):
            near = np.median(x[max(0, i - half) : i + half + 1], axis=0)
            out[i] = own * expect[i] + (1 - own) * near
        return out

    return kernel


def em(df: DataFrame, spec: SeriesSpec, components: int = 2) -> DataFrame:
    """The least likely 5 % of rows take the expectation of a full mixture."""
    return per_series(df, spec, _mixture_repair(components, "full", 0.05, 1.0, 3))


def gaussian_mixture(df: DataFrame, spec: SeriesSpec, components: int = 5) -> DataFrame:
    """The least likely 5 % of rows take 0.4 of a diagonal mixture's expectation and 0.6 of the median around."""
    return per_series(df, spec, _mixture_repair(components, "diag", 0.05, 0.4, 3))


def relationship_network(df: DataFrame, spec: SeriesSpec, clusters: int = 3) -> DataFrame:
    """Rows further from their centre than the cluster's mean + 3 deviations take 0.6 of the centre and 0.4 of the mean around."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        centres, label = K.kmeans(x, clusters)
        d = np.sqrt(((x - centres[label]) ** 2).sum(1))
        limit = np.array([d[label == j].mean() + 3 * d[label == j].std() if (label == j).any() else 0 for j in range(len(centres))])
        out = x.copy()
        for i in np.flatnonzero(d > limit[label]):
            out[i] = 0.6 * centres[label[i]] + 0.4 * x[max(0, i - 2) : i + 3].mean(0)
        return out

    return per_series(df, spec, kernel)


def imr(df: DataFrame, spec: SeriesSpec, p: int = 3, delta: float = 1e-5, most: int = 15) -> DataFrame:
    """AR(p) on windows without outliers, again and again; residuals over 3 x 1.4826 MAD take the prediction."""

    def fn(y: np.ndarray) -> np.ndarray:
        out = y.copy()
        if len(y) <= 3 * p + 2:
            return out
        bad = np.zeros(len(y), bool)
        for _ in range(most):
            x, t = K.ar_design(out, p)
            ok = ~np.lib.stride_tricks.sliding_window_view(bad, p + 1).any(1)
            if ok.sum() <= p + 1:
                break
            pred = x @ K.ols(x[ok], t[ok])
            r = t - pred
            hit = np.abs(r) > 3 * 1.4826 * np.median(np.abs(r - np.median(r))) + K.EPS
            moved = np.abs(out[p:][hit] - pred[hit]).max() if hit.any() else 0.0
            bad[p:] |= hit
            out[p:][hit] = pred[hit]
            if moved < delta:
                break
        return out

    return per_series(df, spec, _columns(fn))


def akane(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows with a missing value lie on the line, others stay. (All that the pattern miner it is named after does in effect.)"""
    from seriesmend.operators.missing import impute_linear

    return impute_linear(df, spec)


def ols_residual(df: DataFrame, spec: SeriesSpec, p: int = 10, most: int = 50, tol: float = 1e-6, sigma: float = 3.0) -> DataFrame:
    """AR(p) without a constant, again and again; residuals over sigma deviations take the prediction."""

    def fn(y: np.ndarray) -> np.ndarray:
        out = y.copy()
        if len(y) <= 2 * p + 2:
            return out
        for _ in range(most):
            x, t = K.ar_design(out, p, constant=False)
            pred = x @ K.ols(x, t)
            r = t - pred
            hit = np.abs(r) > sigma * r.std()
            moved = np.abs(r[hit]).max() if hit.any() else 0.0
            out[p:][hit] = pred[hit]
            if moved < tol:
                break
        return out

    return per_series(df, spec, _columns(fn))


def least_changed(ys: list[np.ndarray], p: int = 3, delta: float = 1e-5, most: int = 100, window: int = 11) -> list[np.ndarray]:
    """least_change of each column; all columns take their changes side by side. Coefficients come from sums of products, and by least squares of the rows where these don't tell them well."""
    out = list(ys)
    some = [i for i in range(len(ys)) if len(ys[i]) > p]
    if not some:
        return out
    sizes = np.array([len(ys[i]) for i in some])
    base, rest = [], np.zeros((len(some), sizes.max()))
    for row, i in zip(rest, some, strict=True):
        y = ys[i]
        size = min(len(y), window)
        wide = np.pad(y, (size // 2, size - 1 - size // 2), mode="symmetric")
        base.append(np.median(np.lib.stride_tricks.sliding_window_view(wide, size), axis=1))
        row[: len(y)] = y - base[-1]
    each, live = sizes - p, np.arange(len(some))

    def middle(values: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Medians of the first n of each row, which the rest is not below."""
        held, at = np.sort(values, axis=1), np.arange(len(n))
        return (held[at, (n - 1) // 2] + held[at, n // 2]) / 2

    for _ in range(most):
        n = each[live]
        now = rest[live, : n.max() + p]
        there = np.arange(n.max()) < n[:, None]
        lags = np.stack([np.where(there, now[:, p - k - 1 : now.shape[1] - k - 1], 0.0) for k in range(p)], axis=1)
        goal = np.where(there, now[:, p:], 0.0)
        gram, told = lags @ lags.swapaxes(1, 2), (lags @ goal[:, :, None])[:, :, 0]
        spread = np.linalg.eigvalsh(gram)
        good = spread[:, 0] > 1e-6 * np.maximum(spread[:, -1], 1e-300)
        coef = np.zeros((len(live), p))
        coef[good] = np.linalg.solve(gram[good], told[good][:, :, None])[:, :, 0]
        for i in np.flatnonzero(~good):
            coef[i] = K.ols(lags[i, :, : n[i]].T, goal[i, : n[i]])
        pred = (coef[:, None] @ lags)[:, 0]
        off = np.where(there, np.abs(goal - pred), -np.inf)
        i, at = off.argmax(axis=1), np.arange(len(live))
        far = off[at, i]
        off = np.where(there, off, np.inf)
        apart = np.where(there, np.abs(off - middle(off, n)[:, None]), np.inf)
        moves = ~((far < np.maximum(3 * middle(apart, n), 1e-6)) | (far < delta))
        rest[live[moves], p + i[moves]] = pred[at, i][moves]
        live = live[moves]
        if not len(live):
            break
    for k, i in enumerate(some):
        out[i] = base[k] + rest[k, : sizes[k]]
    return out


def least_change(df: DataFrame, spec: SeriesSpec, p: int = 3, delta: float = 1e-5, most: int = 100, window: int = 11) -> DataFrame:
    """What an AR(p) without a constant expects, in place of one value at a time: of what a running median leaves, the value that is furthest from its expectation, as long as that is over three median deviations; the model is fitted anew after each. The first p rows stay, and so do series without more."""

    def kernel(xs: list[np.ndarray], _) -> list[np.ndarray]:
        filled = [K.fill_columns(x) for x in xs]
        columns = iter(least_changed([c for x in filled for c in x.T], p, delta, most, window))
        return [np.stack([next(columns) for _ in range(x.shape[1])], axis=1) for x in filled]

    return per_series(df, spec, kernel, many=True)


def dbscan(df: DataFrame, spec: SeriesSpec, eps: float = 0.5, least: int = 5) -> DataFrame:
    """Noise of DBSCAN over standardised rows takes the median of the nearest cluster."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        z, n = K.zcols(x), len(x)
        near = [np.flatnonzero(((z - z[i]) ** 2).sum(1) <= eps**2) for i in range(n)]
        core = np.array([len(v) >= least for v in near])
        label = np.full(n, -1)
        c = 0
        for i in range(n):
            if core[i] and label[i] < 0:
                stack = [i]
                while stack:
                    k = stack.pop()
                    if label[k] < 0:
                        label[k] = c
                        stack += near[k].tolist() if core[k] else []
                c += 1
        if not c or (label >= 0).all():
            return x
        mid = np.stack([np.median(x[label == j], axis=0) for j in range(c)])
        zmid = (mid - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        out = x.copy()
        for i in np.flatnonzero(label < 0):
            out[i] = mid[((zmid - z[i]) ** 2).sum(1).argmin()]
        return out

    return per_series(df, spec, kernel)


def lof_neighbor_mean(df: DataFrame, spec: SeriesSpec, k: int = 5, share: float = 0.2) -> DataFrame:
    """The most isolated share of rows takes the mean of the k nearest others."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        if len(x) < k + 2:
            return x
        s = K.isolation_scores(x, seed=0)
        bad = s > np.quantile(s, 1 - share)
        good = np.flatnonzero(~bad)
        out = x.copy()
        for i in np.flatnonzero(bad):
            d = ((x[good] - x[i]) ** 2).sum(1)
            out[i] = x[good[np.argsort(d, kind="stable")[:k]]].mean(0)
        return out

    return per_series(df, spec, kernel)


def clustering_kmeans(df: DataFrame, spec: SeriesSpec, clusters: int = 5, share: float = 0.05) -> DataFrame:
    """The most isolated share of rows takes the nearest centre of the others."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        if len(x) < clusters + 2:
            return x
        s = K.isolation_scores(x, seed=0)
        bad = s > np.quantile(s, 1 - share)
        centres, _ = K.kmeans(x[~bad], clusters)
        out = x.copy()
        out[bad] = centres[((x[bad, None] - centres[None]) ** 2).sum(-1).argmin(1)]
        return out

    return per_series(df, spec, kernel)


def abnormal_sequence(df: DataFrame, spec: SeriesSpec, half: int = 10, k: float = 3.0) -> DataFrame:
    """Hampel filter: values over k median deviations of their window are masked and lie on the line."""
    from seriesmend.operators.missing import impute_linear

    w = spec.rows(half, half)
    rows = df.withColumns({f"__w_{c}": F.collect_list(c).over(w) for c in spec.features})
    for c in spec.features:
        rows = rows.withColumn(f"__m_{c}", _median(F.col(f"__w_{c}")))
        far = F.abs(F.col(c) - F.col(f"__m_{c}")) > k * _median(F.transform(f"__w_{c}", _distance(f"__m_{c}")))
        rows = rows.withColumn(c, F.when(~far, F.col(c)))
    return impute_linear(rows.drop(*[f"__{p}_{c}" for c in spec.features for p in "wm"]), spec)


def _distance(to: str) -> Callable[[Column], Column]:
    return lambda x: F.abs(x - F.col(to))


def _median(array: Column) -> Column:
    s, n = F.array_sort(array), F.size(array)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def window_regression(df: DataFrame, spec: SeriesSpec, half: int = 10, k: float = 3.0) -> DataFrame:
    """A line through the rows around, the own one included; where any column is over k residual deviations off, all columns take their prediction."""
    w = spec.rows(half, half)
    need, hit = {}, None
    for c in spec.features:
        slope, cut = F.regr_slope(c, spec.t).over(w), F.regr_intercept(c, spec.t).over(w)
        sse = F.regr_syy(c, spec.t).over(w) - F.coalesce(F.regr_sxy(c, spec.t).over(w) ** 2 / F.nullif(F.regr_sxx(c, spec.t).over(w), F.lit(0.0)), F.lit(0.0))
        need[f"__p_{c}"] = cut + slope * F.col(spec.t)
        need[f"__s_{c}"] = F.sqrt(F.greatest(sse, F.lit(0.0)) / F.regr_count(c, spec.t).over(w))
    rows = df.withColumns(need)
    for c in spec.features:
        far = F.abs(F.col(c) - F.col(f"__p_{c}")) > k * F.col(f"__s_{c}") + 1e-12
        hit = far if hit is None else hit | far
    return rows.withColumn("__h", F.coalesce(hit, F.lit(False))).withColumns({c: F.when(F.col("__h"), F.col(f"__p_{c}")).otherwise(F.col(c)) for c in spec.features}).drop("__h", *need)


# The Daubechies 4 scaling filter.
DB4 = np.array([0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278])


def wavelet_denoise(df: DataFrame, spec: SeriesSpec, levels: int = 3, factor: float = 1.5) -> DataFrame:
    """db4 transform (periodic), soft universal threshold; values further than factor x threshold from the result take it."""
    low = DB4
    high = low[::-1] * (-1.0) ** np.arange(len(low))

    def fn(y: np.ndarray) -> np.ndarray:
        n = len(y)
        if n < 16:
            return y
        size = -(-n // 8) * 8
        a = np.r_[y, y[::-1][: size - n]]
        taps = np.arange(len(low))
        details, depth = [], 0
        while depth < levels and len(a) >= 16 and len(a) % 2 == 0:
            at = (2 * np.arange(len(a) // 2)[:, None] + taps) % len(a)
            details.append(a[at] @ high)
            a = a[at] @ low
            depth += 1
        sigma = np.median(np.abs(details[0])) / 0.6745
        limit = sigma * np.sqrt(2 * np.log(n))
        for d in reversed(details):
            d = np.sign(d) * np.maximum(np.abs(d) - limit, 0)
            out = np.zeros(2 * len(a))
            at = (2 * np.arange(len(a))[:, None] + taps) % len(out)
            np.add.at(out, at, a[:, None] * low + d[:, None] * high)
            a = out
        smooth = a[:n]
        return np.where(np.abs(y - smooth) > factor * limit, smooth, y)

    return per_series(df, spec, _columns(fn))


MISSING_REPAIRS: dict[str, Callable[..., DataFrame]] = {"interpolation": impute_interpolation, "moving_average": impute_moving_average, "ar": impute_ar, "kalman_filter": impute_kalman_filter, "gmm_em": impute_gmm, "hmm": impute_hmm, "svr_univariate": impute_svr}

OUTLIER_REPAIRS: dict[str, Callable[..., DataFrame]] = {
    "moving_average": moving_average, "autoregressive": autoregressive, "arma": arma, "kalman_filter": kalman_filter, "interpolation": interpolation, "state_space": state_space, "trajectory_simplification": trajectory_simplification,
    "exponential_smoothing": exponential_smoothing, "svr": svr, "maximum_likelihood": maximum_likelihood, "bayesian_model": bayesian_model, "markov_model": markov_model, "hmm": hmm, "smurf": smurf, "spatio_temporal_prob_model": spatio_temporal,
    "em": em, "relationship_network": relationship_network, "gaussian_mixture": gaussian_mixture, "imr": imr, "akane": akane, "ols": least_change, "ols_residual": ols_residual, "dbscan": dbscan, "lof_neighbor_mean": lof_neighbor_mean,
    "abnormal_sequence_interpolation": abnormal_sequence, "window_regression": window_regression, "clustering_kmeans": clustering_kmeans, "wavelet_denoise": wavelet_denoise,
}


def repair_labelled(df: DataFrame, spec: SeriesSpec, label: str, method: str) -> DataFrame:
    """The repair by labels: rows with label 1 are masked, the repair fits what is left (gaps in line), and only those rows take its values."""
    masked = df.withColumns({c: F.when(F.coalesce(F.col(label), F.lit(0)) != 1, F.col(c)) for c in spec.features})
    from seriesmend.operators.missing import impute_linear

    fixed = OUTLIER_REPAIRS[method](impute_linear(masked, spec), spec).select(*spec.keys, *[F.col(c).alias(f"__f_{c}") for c in spec.features])
    rows = df.join(fixed, spec.keys)
    return rows.withColumns({c: F.when(F.col(label) == 1, F.col(f"__f_{c}")).otherwise(F.col(c)) for c in spec.features}).select(*df.columns)


def repair_where(df: DataFrame, spec: SeriesSpec, rates: DataFrame, rate: str, method: str, threshold: float = 0.3) -> DataFrame:
    """Repair of the samples whose rate is threshold or more; the others stay."""
    chosen = rates.where(F.col(rate) >= threshold).select(spec.sample)
    return OUTLIER_REPAIRS[method](df.join(chosen, spec.sample, "left_semi"), spec).select(*df.columns).unionByName(df.join(chosen, spec.sample, "left_anti"))
