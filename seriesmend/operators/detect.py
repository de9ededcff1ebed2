"""Outlier detectors. Each returns the table with a column `score` (greater: more of an outlier); a point's score is that of its row, over all features.

Those of order statistics and frames are window expressions of the sample; recursive, matrix and neighbour ones are kernels over a sample.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmend.functions.scaling import sanitise_scores
from seriesmend.operators import kernels as K
from seriesmend.spec import SeriesSpec, per_series


def _most(parts: list[Column]) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def zscore(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Greatest |x - mean| / (population deviation + 1e-8)."""
    w = spec.whole
    return df.withColumn("score", _most([F.abs((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + K.EPS)) for c in spec.features]))


def mad(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Greatest |x - median| / (median absolute deviation + 1e-8)."""
    w = spec.whole
    rows = df.withColumns({f"__d_{c}": F.abs(F.col(c) - F.percentile(c, F.lit(0.5)).over(w)) for c in spec.features})
    score = _most([F.col(f"__d_{c}") / (F.percentile(f"__d_{c}", F.lit(0.5)).over(w) + K.EPS) for c in spec.features])
    return rows.withColumn("score", score).drop(*[f"__d_{c}" for c in spec.features])


def _quantile(c: str, spec: SeriesSpec, q: float) -> Column:
    """The sample's quantile between the two order statistics around it, from `__r_<c>`, the place of a row by c. Each half of the way is taken from the form that rounds least there, as SQL engines do:
    a value on a fence depends on the last place."""
    x = F.col(c).cast("double")
    n = F.count(c).over(spec.whole)
    at = q * (n - 1)
    k = F.floor(at)
    d = at - k
    lo, hi = (F.max(F.when(F.col(f"__r_{c}") == place, x)).over(spec.whole) for place in (k + 1, F.least(k + 2, n)))
    return F.when(d < 0.5, lo + d * (hi - lo)).otherwise(lo * (1 - d) + hi * d)


def iqr(df: DataFrame, spec: SeriesSpec, k: float = 1.5) -> DataFrame:
    """1 if any feature is outside of Q1 - k IQR .. Q3 + k IQR."""
    rows = df.withColumns({f"__r_{c}": F.row_number().over(Window.partitionBy(spec.sample).orderBy(F.asc_nulls_last(c))) for c in spec.features})
    rows = rows.withColumns({f"__{p}_{c}": _quantile(c, spec, q) for c in spec.features for p, q in (("q1", 0.25), ("q3", 0.75))})
    out = []
    for c in spec.features:
        q1, q3 = F.col(f"__q1_{c}"), F.col(f"__q3_{c}")
        out.append(((F.col(c) < q1 - k * (q3 - q1)) | (F.col(c) > q3 + k * (q3 - q1))).cast("double"))
    return rows.withColumn("score", _most(out)).drop(*[f"__{p}_{c}" for c in spec.features for p in ("r", "q1", "q3")])


def moving_average(df: DataFrame, spec: SeriesSpec, window: int = 5) -> DataFrame:
    """Greatest distance to the centred mean, whose frame is cut at the ends."""
    frame = spec.rows(window // 2, window // 2)
    return df.withColumn("score", _most([F.abs(F.col(c) - F.avg(c).over(frame)) for c in spec.features]))


def rolling_median(df: DataFrame, spec: SeriesSpec, window: int = 5) -> DataFrame:
    frame = spec.rows(window // 2, window // 2)
    return df.withColumn("score", _most([F.abs(F.col(c) - F.percentile(c, F.lit(0.5)).over(frame)) for c in spec.features]))


def _filtered(step: Callable[[float, tuple], tuple], start: Callable[[float], tuple]):
    """Kernel: greatest |x - s| over columns for a recursive filter; the state's first element is s."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        out = np.zeros(x.shape)
        for j in range(x.shape[1]):
            state = start(x[0, j])
            for i, v in enumerate(x[:, j]):
                state = step(v, state) if i else state
                out[i, j] = abs(v - state[0])
        return out.max(1)

    return kernel


def ewma(df: DataFrame, spec: SeriesSpec, alpha: float = 0.3) -> DataFrame:
    """Greatest residual to the running average s = a x + (1 - a) s from s = x[0]."""
    return per_series(df, spec, _filtered(lambda v, s: (alpha * v + (1 - alpha) * s[0],), lambda v: (v,)), ["score"])


def kalman_gain(df: DataFrame, spec: SeriesSpec, gain: float = 0.5) -> DataFrame:
    """A filter of constant gain."""
    return ewma(df, spec, gain)


def holt_winters(df: DataFrame, spec: SeriesSpec, alpha: float = 0.3, beta: float = 0.1) -> DataFrame:
    """Residual to level + trend once the row is taken in, from level x[0] and trend 0."""

    def step(v: float, s: tuple) -> tuple:
        level = alpha * v + (1 - alpha) * s[0]
        trend = beta * (level - s[1]) + (1 - beta) * s[2]
        return level + trend, level, trend

    return per_series(df, spec, _filtered(step, lambda v: (v, v, 0.0)), ["score"])


def _residual(smooth: Callable[[np.ndarray], np.ndarray]):
    return lambda x, _: np.max([np.abs(c - smooth(c)) for c in K.fill_columns(x).T], axis=0)


def savgol(df: DataFrame, spec: SeriesSpec, window: int = 7, poly: int = 2) -> DataFrame:
    return per_series(df, spec, _residual(lambda y: K.savgol(y, window, poly)), ["score"])


def loess(df: DataFrame, spec: SeriesSpec, frac: float = 0.3) -> DataFrame:
    return per_series(df, spec, _residual(lambda y: K.lowess(y, frac)), ["score"])


def fft(df: DataFrame, spec: SeriesSpec, keep: float = 0.1) -> DataFrame:
    """Residual after all but the first and last `keep` of the frequency bins are zero."""

    def smooth(y: np.ndarray) -> np.ndarray:
        f = np.fft.fft(y)
        k = int(len(y) * keep)
        f[k : len(y) - k] = 0
        return np.fft.ifft(f).real

    return per_series(df, spec, _residual(smooth), ["score"])


def mahalanobis(df: DataFrame, spec: SeriesSpec, squared: bool = False) -> DataFrame:
    """Distance from the mean in terms of the pseudo-inverse of the sample covariance; squared: Hotelling's T2."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        d = x - x.mean(0)
        inverse = np.linalg.pinv(np.atleast_2d(np.cov(x, rowvar=False))) if len(x) > 1 else np.eye(x.shape[1])
        q = np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0)
        return q if squared else np.sqrt(q)

    return per_series(df, spec, kernel, ["score"])


def hotelling(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return mahalanobis(df, spec, True)


def pca_residual(df: DataFrame, spec: SeriesSpec, components: int = 2) -> DataFrame:
    """Greatest residual of a row after projection on the first principal components."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        d = x - x.mean(0)
        v = np.linalg.svd(d, full_matrices=False)[2][:components]
        return np.abs(d - d @ v.T @ v).max(1)

    return per_series(df, spec, kernel, ["score"])


def _windowed(score: Callable[[np.ndarray], np.ndarray], window: int | None):
    """Kernel over flattened windows (None: of the series' period), padded to its rows."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        w = K.windows(x, K.period(x) if window is None else window)
        return K.pad_scores(np.nan_to_num(score(w)), len(x))

    return kernel


def pca(df: DataFrame, spec: SeriesSpec, window: int | None = 1) -> DataFrame:
    """Sum over principal components of the distance of a standardised window to the component by its share of variance."""

    def score(w: np.ndarray) -> np.ndarray:
        z = K.zcols(w)
        _, s, v = np.linalg.svd(z - z.mean(0), full_matrices=False)
        share = s**2 / max((s**2).sum(), K.EPS)
        good = share > 1e-10
        return sum(np.sqrt(((z - c) ** 2).sum(1)) / r for c, r in zip(v[good], share[good], strict=True)) if good.any() else np.zeros(len(w))

    return per_series(df, spec, _windowed(score, window), ["score"])


def kde(df: DataFrame, spec: SeriesSpec, bandwidth: float = 1.0, block: int = 512) -> DataFrame:
    """Minus the log density of Gaussian kernels at all rows of the sample."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        n, d = x.shape
        out = np.zeros(n)
        for lo in range(0, n, block):
            e = -0.5 * ((x[lo : lo + block, None] - x[None]) ** 2).sum(-1) / bandwidth**2
            top = e.max(1, keepdims=True)
            out[lo : lo + block] = -(top[:, 0] + np.log(np.exp(e - top).sum(1)) - np.log(n) - d * np.log(bandwidth) - 0.5 * d * np.log(2 * np.pi))
        return out

    return per_series(df, spec, kernel, ["score"])


def gaussian_mixture(df: DataFrame, spec: SeriesSpec, components: int = 2) -> DataFrame:
    """Minus the log likelihood under the likeliest of mixtures of three kinds of covariance and four ridges."""

    every = tuple((kind, reg) for kind in ("full", "diag", "spherical") for reg in (1e-4, 1e-3, 1e-2, 1e-1))

    def kernel(xs: list[np.ndarray], _) -> list[np.ndarray]:
        found = K.gmm_many([K.zcols(K.fill_columns(x)) for x in xs], components, every)
        return [-max((ll for _, _, ll in fits), key=lambda ll: ll.mean()) for fits in found]

    return per_series(df, spec, kernel, ["score"], many=True)


def hbos(df: DataFrame, spec: SeriesSpec, window: int | None = 1, bins: int = 10, alpha: float = 0.1, tol: float = 0.5) -> DataFrame:
    """Minus the sum of log2(histogram density + alpha) over the dimensions of row-wise standardised windows; just outside the range (tol of a bin) counts as the edge bin."""

    def score(w: np.ndarray) -> np.ndarray:
        z = K.zrows(w)
        out = np.zeros(len(z))
        for j in range(z.shape[1]):
            h, e = np.histogram(z[:, j], bins, density=True)
            k = np.digitize(z[:, j], e, right=True)
            logs = np.log2(h + alpha)
            width = e[1] - e[0]
            low = np.where(z[:, j] >= e[0] - tol * width, logs[0], logs.min())
            out -= np.where(k == 0, low, logs[np.clip(k - 1, 0, bins - 1)])
        return out

    return per_series(df, spec, _windowed(score, window), ["score"])


def copod(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Copula tails: sum over columns of -log of the left, right or (by skewness) chosen tail, the greatest of the mean of both and the chosen one."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        z = K.zrows(K.fill_columns(x))
        n = len(z)
        tail = lambda y: -np.log(np.searchsorted(np.sort(y), y, side="right") / n)
        left, right = np.stack([tail(c) for c in z.T], 1), np.stack([tail(-c) for c in z.T], 1)
        third = ((z - z.mean(0)) ** 3).mean(0)  # its sign is that of the skewness: the long tail counts, both where there is none
        chosen = np.where(third < 0, left, np.where(third > 0, right, left + right))
        return np.maximum(chosen, (left + right) / 2).sum(1)

    return per_series(df, spec, kernel, ["score"])


def knn(df: DataFrame, spec: SeriesSpec, window: int | None = 1, k: int = 10, method: str = "largest") -> DataFrame:
    """Distance to the k-th nearest window (largest), or the mean or median of the k."""

    def score(w: np.ndarray) -> np.ndarray:
        if len(w) < 2:
            return np.zeros(len(w))
        d = K.nearest(K.zrows(w) if w.shape[1] > 1 else w, k)[0]
        return d[:, -1] if method == "largest" else d.mean(1) if method == "mean" else np.median(d, axis=1)

    return per_series(df, spec, _windowed(score, window), ["score"])


def lof_scores(w: np.ndarray, k: int) -> np.ndarray:
    if len(w) < 2:
        return np.zeros(len(w))
    d, at = K.nearest(w, k)
    reach = np.maximum(d, d[at, -1])
    density = 1 / (reach.mean(1) + 1e-10)
    return density[at].mean(1) / density


def lof(df: DataFrame, spec: SeriesSpec, window: int | None = 1, k: int = 20) -> DataFrame:
    """Local outlier factor of windows."""
    return per_series(df, spec, _windowed(lambda w: lof_scores(K.zrows(w) if w.shape[1] > 1 else w, k), window), ["score"])


def cof(df: DataFrame, spec: SeriesSpec, k: int = 20) -> DataFrame:
    """Connectivity-based factor: a row's average chaining distance by the mean of its neighbours'."""

    def score(w: np.ndarray) -> np.ndarray:
        if len(w) < 3:
            return np.zeros(len(w))
        _, at = K.nearest(w, k)
        kk = at.shape[1]
        chain = np.zeros(len(w))
        for i in range(len(w)):
            group = w[np.r_[i, at[i]]]
            link = np.sqrt(((group[:, None] - group[None]) ** 2).sum(-1))
            near = link[0].copy()
            open_ = np.ones(kk + 1, bool)
            open_[0] = False
            for step in range(1, kk + 1):
                j = np.where(open_, near, np.inf).argmin()
                chain[i] += 2 * (kk + 1 - step) / (kk * (kk + 1)) * near[j]
                open_[j] = False
                near = np.minimum(near, link[j])
        return chain / np.maximum(chain[at].mean(1), 1e-10)

    return per_series(df, spec, lambda x, _: score(K.fill_columns(x)), ["score"])


def cblof(df: DataFrame, spec: SeriesSpec, clusters: int = 8, alpha: float = 0.9, beta: float = 5, seed: int = 0) -> DataFrame:
    """Distance to the own centre in a large cluster, else to the nearest centre of a large one. Large: the first clusters by size that hold alpha of the rows, or up to a fall by beta."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        z = K.zcols(K.fill_columns(x))
        centres, label = K.kmeans(z, clusters, seed)
        size = np.bincount(label, minlength=len(centres))
        order = np.argsort(-size, kind="stable")
        held = np.cumsum(size[order])
        cut = next((i + 1 for i in range(len(order) - 1) if held[i] >= alpha * len(z) or size[order[i]] >= beta * max(size[order[i + 1]], 1)), len(order))
        large = order[:cut]
        own = np.sqrt(((z - centres[label]) ** 2).sum(1))
        other = np.sqrt(((z[:, None] - centres[large][None]) ** 2).sum(-1)).min(1)
        return np.where(np.isin(label, large), own, other)

    return per_series(df, spec, kernel, ["score"])


def kmeans_ad(df: DataFrame, spec: SeriesSpec, k: int = 10, window: int | None = 20, seed: int = 0) -> DataFrame:
    """Distance of a standardised window to its centre; a row has the mean of the windows that cover it."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        w = K.windows(x, K.period(x) if window is None else window)
        z = K.zrows(w) if w.shape[1] > 1 else w
        centres, label = K.kmeans(z, k, seed)
        d = np.sqrt(((z - centres[label]) ** 2).sum(1))
        size = len(x) - len(w) + 1
        total, n = np.convolve(d, np.ones(size)), np.convolve(np.ones(len(d)), np.ones(size))
        return total / n

    return per_series(df, spec, kernel, ["score"])


def iforest(df: DataFrame, spec: SeriesSpec, window: int | None = 1, trees: int = 100, seed: int = 0) -> DataFrame:
    """Isolation forest over windows."""
    return per_series(df, spec, _windowed(lambda w: K.isolation_scores(K.zrows(w) if w.shape[1] > 1 else w, trees, seed=seed), window), ["score"])


def eif(df: DataFrame, spec: SeriesSpec, trees: int = 100, seed: int = 0) -> DataFrame:
    """Isolation forest with random hyperplanes."""
    return per_series(df, spec, lambda x, _: K.isolation_scores(K.zrows(K.fill_columns(x)) if x.shape[1] > 1 else K.fill_columns(x), trees, seed=seed, extended=True), ["score"])


def robust_pca(df: DataFrame, spec: SeriesSpec, rounds: int = 200) -> DataFrame:
    """Low rank plus sparse by alternating directions; the score is how far the low-rank part is from its own principal projection, plus the sparse part's size as tie-break."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        n, d = x.shape
        mu = n * d / (4 * max(np.abs(x).sum(), K.EPS))
        lam = 1 / np.sqrt(max(n, d))
        sparse, dual = np.zeros_like(x), np.zeros_like(x)
        shrink = lambda m, t: np.sign(m) * np.maximum(np.abs(m) - t, 0)
        for _ in range(rounds):
            u, s, v = np.linalg.svd(x - sparse + dual / mu, full_matrices=False)
            low = (u * shrink(s, 1 / mu)) @ v
            sparse = shrink(x - low + dual / mu, lam / mu)
            rest = x - low - sparse
            dual += mu * rest
            if np.linalg.norm(rest) <= 1e-7 * max(np.linalg.norm(x), K.EPS):
                break
        return np.abs(x - low).sum(1)

    return per_series(df, spec, kernel, ["score"])


def norma(df: DataFrame, spec: SeriesSpec, gamma: float = 0.1, eta: float = 0.01, lam: float = 1e-4, block: int = 256) -> DataFrame:
    """Online sum of Gaussian kernels over all rows before: the score is |prediction| before the row is taken in; coefficients fade by 1 - eta lam. Blocks of rows are scored at once."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        out, place = np.zeros(len(x)), np.arange(len(x))
        for lo in range(0, len(x), block):
            now = slice(lo, min(len(x), lo + block))
            # of the differences: squares of great values have no places left for near rows
            far = sum((c[now, None] - c[None, : now.stop]) ** 2 for c in x.T)
            # what row k adds at first is eta; it has faded i - 1 - k times when row i comes
            age = place[now, None] - 1 - place[None, : now.stop]
            weight = np.where(age >= 0, eta * (1 - eta * lam) ** np.maximum(age, 0), 0.0)
            out[now] = np.abs((weight * np.exp(-gamma * far)).sum(axis=1))
        return out

    return per_series(df, spec, kernel, ["score"])


def correlation_reconstruction(df: DataFrame, spec: SeriesSpec, window: int = 64, components: int = 4) -> DataFrame:
    """Reconstruction error of each window's cosine matrix of columns by principal components. It stands in for an auto-encoder over the same matrices, for which there is no library here;
    like that, a window's score goes to its last row and the rows before the first stay 0."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        x = K.fill_columns(x)
        w = min(window, len(x))
        v = np.lib.stride_tricks.sliding_window_view(x, w, axis=0)
        v = v / np.maximum(np.linalg.norm(v, axis=2, keepdims=True), K.EPS)
        m = np.einsum("nct,ndt->ncd", v, v).reshape(len(v), -1)
        d = m - m.mean(0)
        p = np.linalg.svd(d, full_matrices=False)[2][:components]
        return np.r_[np.zeros(w - 1), ((d - d @ p.T @ p) ** 2).mean(1)]

    return per_series(df, spec, kernel, ["score"])


def polynomial(df: DataFrame, spec: SeriesSpec, power: int = 1, window: int = 20) -> DataFrame:
    """One feature: the spectral distance between a window and the polynomial through the rows around it."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        y = K.fill_linear(x[:, 0])
        n = len(y)
        out = np.zeros(n)
        for lo in range(0, n, window):
            part = np.arange(lo, min(n, lo + window))
            near = np.setdiff1d(np.arange(max(0, lo - window), min(n, lo + 2 * window)), part)
            if len(near) > power + 1:
                centre = near.mean()
                fit = np.polyval(np.polyfit(near - centre, y[near], power), part - centre)
                out[part] = np.linalg.norm(np.fft.fft(y[part] - fit)) / len(part)
        return out

    return per_series(df, spec, kernel, ["score"])


def spectral_residual(df: DataFrame, spec: SeriesSpec, window: int = 3) -> DataFrame:
    """Saliency: what the smoothed log spectrum doesn't explain."""

    def one(y: np.ndarray) -> np.ndarray:
        f = np.fft.fft(y)
        log = np.log(np.abs(f) + K.EPS)
        rest = np.exp(log - np.convolve(log, np.ones(window) / window, "same"))
        return np.abs(np.fft.ifft(rest * np.exp(1j * np.angle(f))))

    return per_series(df, spec, lambda x, _: np.max([one(c) for c in K.fill_columns(x).T], axis=0), ["score"])


def matrix_profile(df: DataFrame, spec: SeriesSpec, window: int = 10) -> DataFrame:
    """Distance of each standardised window of the first feature to the nearest one that doesn't overlap by half."""

    def kernel(x: np.ndarray, _) -> np.ndarray:
        y = K.fill_linear(x[:, 0])
        w = K.windows(y[:, None], window)
        z = K.zrows(w, 0)
        size = w.shape[1]
        out = np.zeros(len(z))
        for i in range(len(z)):
            d = 2 * (size - z @ z[i])
            d[max(0, i - size // 2) : i + size // 2 + 1] = np.inf
            best = d.min()
            out[i] = np.sqrt(max(best, 0)) if np.isfinite(best) else 0.0
        return K.pad_scores(out, len(y))

    return per_series(df, spec, kernel, ["score"])


def mcd(df: DataFrame, spec: SeriesSpec, window: int | None = 1, share: float = 0.75, starts: int = 10, seed: int = 2024) -> DataFrame:
    """Distance in terms of the covariance of least determinant among `share` of the windows, by concentration steps from random starts."""

    def score(w: np.ndarray) -> np.ndarray:
        n, d = w.shape
        h = max(d + 1, int(share * n))
        if n <= d + 1:
            return np.zeros(n)
        rng = np.random.default_rng(seed)
        best = None
        for _ in range(starts):
            rows = rng.choice(n, min(n, d + 1), replace=False)
            for _ in range(20):
                c = np.atleast_2d(np.cov(w[rows], rowvar=False)) + 1e-9 * np.eye(d)
                e = w - w[rows].mean(0)
                q = np.einsum("ij,jk,ik->i", e, np.linalg.pinv(c), e)
                new = np.argsort(q, kind="stable")[:h]
                if set(new) == set(rows):
                    break
                rows = new
            det = np.linalg.slogdet(np.atleast_2d(np.cov(w[rows], rowvar=False)) + 1e-9 * np.eye(d))[1]
            if best is None or det < best[0]:
                best = det, q
        return best[1]

    return per_series(df, spec, _windowed(score, window), ["score"])


#: The pool by name. The windowed variants take windows of the series' period.
DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "ZScore": zscore, "MAD": mad, "IQR": iqr, "MovingAverage": moving_average, "RollingMedian": rolling_median, "EWMA": ewma, "Kalman": kalman_gain, "HoltWinters": holt_winters,
    "SavGol": savgol, "LOESS": loess, "FFT": fft, "Mahalanobis": mahalanobis, "HotellingT2": hotelling, "PCAStat": pca_residual, "PCA": pca, "KDE": kde, "GMM": gaussian_mixture, "HBOS": hbos,
    "COPOD": copod, "KNN": knn, "LOF": lof, "COF": cof, "CBLOF": cblof, "KMeansAD": kmeans_ad, "IForest": iforest, "EIF": eif, "RobustPCA": robust_pca, "NORMA": norma, "SARAD": correlation_reconstruction,
    "Sub_IForest": lambda d, s: iforest(d, s, None), "Sub_LOF": lambda d, s: lof(d, s, None), "Sub_PCA": lambda d, s: pca(d, s, None), "Sub_HBOS": lambda d, s: hbos(d, s, None), "Sub_KNN": lambda d, s: knn(d, s, None),
    "KMeansAD_U": lambda d, s: kmeans_ad(d, s, window=None), "POLY": polynomial, "SR": spectral_residual, "MatrixProfile": matrix_profile, "MCD": mcd,
}


def ensemble(df: DataFrame, spec: SeriesSpec, names: list[str]) -> DataFrame:
    """`score`: the mean of the sanitised scores of several detectors."""
    out = df
    for i, name in enumerate(names):
        s = sanitise_scores(DETECTORS[name](df, spec).select(*spec.keys, "score"), spec, "score").withColumnRenamed("score", f"__s{i}")
        out = out.join(s, spec.keys)
    cols = [F.col(f"__s{i}") for i in range(len(names))]
    return out.withColumn("score", sum(cols[1:], cols[0]) / len(cols)).drop(*[f"__s{i}" for i in range(len(names))])


def ensemble_scores(df: DataFrame, spec: SeriesSpec, names: list[str]) -> DataFrame:
    """(sample, t, score) of `ensemble`; one detector needs no join."""
    if len(names) > 1:
        return ensemble(df, spec, names).select(*spec.keys, "score")
    return sanitise_scores(DETECTORS[names[0]](df, spec).select(*spec.keys, "score"), spec, "score").where(F.col(spec.sample).isNotNull())


def flag(df: DataFrame, spec: SeriesSpec, factor: float = 3.0) -> DataFrame:
    """is_outlier: score above mean + factor x population deviation of the sample."""
    w = spec.whole
    return df.withColumn("is_outlier", F.coalesce(F.col("score") > F.avg("score").over(w) + factor * F.stddev_pop("score").over(w), F.lit(False)))


def outlier_rates(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.groupBy(spec.sample).agg(F.avg(F.col("is_outlier").cast("double")).alias("outlier_rate"))


def vote(df: DataFrame, spec: SeriesSpec, choose: Callable[[DataFrame], list[str]], samples: int = 3, keep: int = 3, seed: int = 42) -> list[str]:
    """The most frequent detectors that `choose` names for a few samples (the first by hash), for the whole set."""
    ids = [r[0] for r in df.select(spec.sample).distinct().orderBy(F.xxhash64(spec.sample, F.lit(seed))).limit(samples).collect()]
    names = [n for i in ids for n in choose(df.where(F.col(spec.sample) == F.lit(i)))]
    return sorted(dict.fromkeys(names), key=lambda n: (-names.count(n), names.index(n)))[:keep]


