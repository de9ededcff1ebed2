"""Numerical kernels over one series: values (T x D) or one column, missing as NaN. Plain numpy; all that is random takes a seed."""

from __future__ import annotations

import numpy as np

EPS = 1e-8


def fill_linear(x: np.ndarray) -> np.ndarray:
    """Linear between valid values, constant beyond them, zeros where there are none."""
    good = np.isfinite(x)
    if not good.any():
        return np.zeros_like(x)
    at = np.arange(len(x))
    return np.interp(at, at[good], x[good])


def fill_columns(x: np.ndarray) -> np.ndarray:
    return np.stack([fill_linear(x[:, j]) for j in range(x.shape[1])], axis=1) if x.shape[1] else x


def local_level(y: np.ndarray, steps: int = 5) -> np.ndarray:
    """Smoothed level of y[t] = l[t] + e, l[t] = l[t-1] + w by `steps` rounds of EM over the two variances; NaN is missing."""
    good = np.isfinite(y)
    n = len(y)
    if good.sum() < 2:
        return np.where(good, y, np.nanmean(y) if good.any() else 0.0)
    r = q = max(float(np.nanvar(y)), EPS) / 2
    m0, p0 = float(y[good][0]), max(float(np.nanvar(y)), EPS)
    for _ in range(steps + 1):
        m, p, mp, pp = (np.zeros(n) for _ in range(4))
        for i in range(n):
            mp[i], pp[i] = (m0, p0) if i == 0 else (m[i - 1], p[i - 1] + q)
            k = pp[i] / (pp[i] + r) if good[i] else 0.0
            m[i], p[i] = mp[i] + k * (y[i] - mp[i] if good[i] else 0.0), (1 - k) * pp[i]
        s, v, cross = m.copy(), p.copy(), np.zeros(n)
        for i in range(n - 2, -1, -1):
            g = p[i] / pp[i + 1]
            s[i] += g * (s[i + 1] - mp[i + 1])
            v[i] += g * g * (v[i + 1] - pp[i + 1])
            cross[i + 1] = g * v[i + 1]
        r = max(float(((y[good] - s[good]) ** 2 + v[good]).mean()), EPS)
        q = max(float(((s[1:] - s[:-1]) ** 2 + v[1:] + v[:-1] - 2 * cross[1:]).mean()), EPS)
    return s


def boosted_fit(x: np.ndarray, y: np.ndarray, new: np.ndarray, rounds: int = 40, rate: float = 0.1, bins: int = 32, depth: int = 3) -> np.ndarray:
    """Predictions at new by gradient boosting of squared error over histogram trees."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    a, b = (np.stack([np.searchsorted(e, z[:, j]) for j, e in enumerate(edges)], axis=1) for z in (x, new))
    base = y.mean()
    f, g = np.full(len(y), base), np.full(len(new), base)

    def grow(rows: np.ndarray, at: np.ndarray, level: int) -> None:
        value = r[rows].mean()
        best = (1e-12, None, None)
        if level and len(rows) >= 10:
            for j in range(x.shape[1]):
                n = np.bincount(a[rows, j], minlength=len(edges[j]) + 1).cumsum()[:-1]
                s = np.bincount(a[rows, j], r[rows], minlength=len(edges[j]) + 1).cumsum()[:-1]
                rest, left = len(rows) - n, r[rows].sum() - s
                gain = np.where((n >= 3) & (rest >= 3), s**2 / np.maximum(n, 1) + left**2 / np.maximum(rest, 1) - len(rows) * value**2, -1.0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            f[rows] += rate * value
            g[at] += rate * value
            return
        _, j, cut = best
        grow(rows[a[rows, j] <= cut], at[b[at, j] <= cut], level - 1)
        grow(rows[a[rows, j] > cut], at[b[at, j] > cut], level - 1)

    for _ in range(rounds):
        r = y - f
        grow(np.arange(len(y)), np.arange(len(new)), depth)
    return g


def windows(x: np.ndarray, w: int) -> np.ndarray:
    """Flattened windows of w rows, one for each start."""
    w = max(1, min(w, len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, w, axis=0).transpose(0, 2, 1).reshape(len(x) - w + 1, -1)


def pad_scores(s: np.ndarray, n: int) -> np.ndarray:
    """Window scores to n rows: the first value before, the last one after."""
    w = n - len(s) + 1
    before = -(-(w - 1) // 2)
    return np.r_[np.full(before, s[0]), s, np.full(n - len(s) - before, s[-1])] if len(s) else np.zeros(n)


def zrows(x: np.ndarray, ddof: int = 1) -> np.ndarray:
    """Row-wise z-scores; rows without spread become zeros."""
    if x.shape[1] <= ddof:
        return np.zeros_like(x)
    d = x.std(axis=1, ddof=ddof, keepdims=True)
    return np.where(d > 0, (x - x.mean(axis=1, keepdims=True)) / np.where(d > 0, d, 1), 0.0)


def zcols(x: np.ndarray) -> np.ndarray:
    d = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(d > 0, d, 1)


def period(x: np.ndarray, most: int = 400, least: int = 3, default: int = 20) -> int:
    """The strongest period over columns: a local maximum of the autocorrelation at 3 to 300 rows; 20 where there is none."""
    best, at = -np.inf, default
    for j in range(x.shape[1]):
        y = x[:, j] - x[:, j].mean()
        n = min(most, len(y) - 1)
        if n <= least + 2 or not y.any():
            continue
        f = np.fft.rfft(y, 2 * len(y))
        acf = np.fft.irfft(f * f.conj())[: n + 1] / (y @ y)
        tail = acf[least:]
        peaks = np.flatnonzero((tail[1:-1] > tail[:-2]) & (tail[1:-1] > tail[2:])) + 1
        if not len(peaks):
            continue
        k = peaks[tail[peaks].argmax()]
        if 3 <= k + least <= 300 and tail[k] > best:
            best, at = tail[k], int(k + least)
    return at


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(centres, label of each row), k-means++ from a seed."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[[rng.integers(len(x))]]
    for _ in range(1, k):
        d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        moved = np.array([x[new == j].mean(0) if (new == j).any() else centres[j] for j in range(len(centres))])
        if (new == label).all() and np.allclose(moved, centres):
            break
        label, centres = new, moved
    return centres, label


def gaussian_logpdf(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    chol = np.linalg.cholesky(cov)
    z = np.linalg.solve(chol, (x - mean).T)
    return -0.5 * (z**2).sum(0) - np.log(np.diag(chol)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)


def gmm(x: np.ndarray, k: int = 2, kind: str = "full", reg: float = 1e-3, seed: int = 0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, covariances, responsibilities, log likelihood of each row) of a Gaussian mixture by EM."""
    centres, label = kmeans(x, k, seed)
    k, d = centres.shape
    resp = np.eye(k)[label]
    last = -np.inf
    for _ in range(rounds):
        n = resp.sum(0) + 1e-10
        weights, means = n / len(x), resp.T @ x / n[:, None]
        covs = []
        for j in range(k):
            y = x - means[j]
            c = (resp[:, j, None] * y).T @ y / n[j]
            c = np.diag(np.diag(c)) if kind == "diag" else np.eye(d) * np.trace(c) / d if kind == "spherical" else c
            covs.append(c + reg * np.eye(d))
        logs = np.stack([np.log(weights[j]) + gaussian_logpdf(x, means[j], covs[j]) for j in range(k)], axis=1)
        top = logs.max(1, keepdims=True)
        ll = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        resp = np.exp(logs - ll[:, None])
        if abs(ll.mean() - last) < 1e-3:
            break
        last = ll.mean()
    return weights, means, np.array(covs), resp, ll


def gmm_many(xs: list[np.ndarray], k: int, fits: tuple[tuple[str, float], ...] = (("full", 1e-3),), seed: int = 0, rounds: int = 100, at_once: int = 1 << 15) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each table of xs and each (kind, reg) of fits: (means, responsibilities, log likelihood of each row), as gmm gives them. Fits with as many components go side by side, tables of most rows first, in blocks of about at_once rows; those of a table share their start."""
    starts = [kmeans(x, k, seed) for x in xs]
    out: list[list] = [[None] * len(fits) for _ in xs]
    order = sorted(range(len(xs)), key=lambda i: (-len(starts[i][0]), -len(xs[i])))
    while order:
        first = order[0]
        many = max(1, at_once // (len(xs[first]) * len(fits)))
        some = [i for i in order[:many] if starts[i][0].shape == starts[first][0].shape]
        order = order[len(some) :]
        tasks = [(i, f) for i in some for f in range(len(fits))]
        got = _mixtures([xs[i] for i, _ in tasks], [starts[i][1] for i, _ in tasks], len(starts[first][0]), [fits[f] for _, f in tasks], rounds)
        for (i, f), g in zip(tasks, got, strict=True):
            out[i][f] = g
    return out


def _mixtures(xs: list[np.ndarray], labels: list[np.ndarray], k: int, fits: list[tuple[str, float]], rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """EM for all tables at once, longest first, each until its own likelihood settles; what is beyond a table's rows has no responsibility."""
    sizes, d = np.array([len(x) for x in xs]), xs[0].shape[1]
    x, resp = np.zeros((len(xs), sizes[0], d)), np.zeros((len(xs), sizes[0], k))
    for i, (v, label) in enumerate(zip(xs, labels, strict=True)):
        x[i, : len(v)], resp[i, np.arange(len(v)), label] = v, 1.0
    eye = np.eye(d)
    kinds, reg = np.array([kind for kind, _ in fits]), np.array([r for _, r in fits])[:, None, None, None] * eye
    live, last = np.arange(len(xs)), np.full(len(xs), -np.inf)
    out: list = [None] * len(xs)
    for turn in range(rounds):
        rows, long = sizes[live], sizes[live].max()
        there = np.arange(long) < rows[:, None]
        x, resp = x[:, :long], resp[:, :long]
        n = resp.sum(axis=1) + 1e-10
        means = resp.swapaxes(1, 2) @ x / n[:, :, None]
        y = x[:, None] - means[:, :, None]
        c = (resp.swapaxes(1, 2)[..., None] * y).swapaxes(2, 3) @ y / n[:, :, None, None]
        c = np.where((kinds[live] == "full")[:, None, None, None], c, np.where((kinds[live] == "diag")[:, None, None, None], c * eye, np.trace(c, axis1=2, axis2=3)[..., None, None] / d * eye))
        chol = np.linalg.cholesky(c + reg[live])
        z = np.linalg.solve(chol, y.swapaxes(2, 3))
        logs = -0.5 * (z**2).sum(axis=2) - np.log(np.diagonal(chol, axis1=2, axis2=3)).sum(axis=2)[..., None] - 0.5 * d * np.log(2 * np.pi) + np.log(n / rows[:, None])[..., None]
        top = logs.max(axis=1)
        ll = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
        resp = np.where(there[..., None], np.exp(logs - ll[:, None]).swapaxes(1, 2), 0.0)
        mean = np.where(there, ll, 0.0).sum(axis=1) / rows
        done = (np.abs(mean - last[live]) < 1e-3) | (turn == rounds - 1)
        last[live] = mean
        for i in np.flatnonzero(done):
            out[live[i]] = means[i].copy(), resp[i, : rows[i]].copy(), ll[i, : rows[i]].copy()
        live, x, resp = live[~done], x[~done], resp[~done]
        if not len(live):
            break
    return out


def nearest(x: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(distances, rows) of the k nearest other rows of each row, in blocks."""
    k = max(1, min(k, len(x) - 1))
    dist, at = np.zeros((len(x), k)), np.zeros((len(x), k), int)
    sq = (x**2).sum(1)
    for lo in range(0, len(x), block):
        d = sq[lo : lo + block, None] + sq[None] - 2 * x[lo : lo + block] @ x.T
        d[np.arange(d.shape[0]), lo + np.arange(d.shape[0])] = np.inf
        i = np.argpartition(d, k - 1, axis=1)[:, :k]
        v = ((x[lo : lo + block, None] - x[i]) ** 2).sum(-1)  # of those few without what the products above cancel
        order = np.argsort(v, axis=1, kind="stable")
        dist[lo : lo + block], at[lo : lo + block] = np.sqrt(np.take_along_axis(v, order, 1)), np.take_along_axis(i, order, 1)
    return dist, at


def average_path(n: float | np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0, extended: bool = False, at_once: int = 1 << 21) -> np.ndarray:
    """2^(-mean depth / expected depth). A tree cuts one feature of its own; extended: random hyperplanes over all features. All trees grow together, level by level, in blocks of at_once places."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    sample = min(sample, n)
    limit = int(np.ceil(np.log2(max(sample, 2))))
    depth = np.zeros(n)

    def grow(count: int) -> None:
        part = rng.random((count, n)).argpartition(sample - 1, axis=1)[:, :sample] if sample < n else np.broadcast_to(np.arange(n), (count, n))
        tree_p, row_p = np.repeat(np.arange(count), sample), part.ravel()
        tree_r, row_r = np.repeat(np.arange(count), n), np.tile(np.arange(n), count)
        own = rng.integers(width, size=count)
        # places (tree, node) of the rows that grow a tree and of those that fall through it
        node_p, node_r = tree_p.copy(), tree_r.copy()
        for level in range(limit + 1):
            nodes = count << level
            size = np.bincount(node_p, minlength=nodes)
            if extended:
                lo, hi = np.full((nodes, width), np.inf), np.full((nodes, width), -np.inf)
                np.minimum.at(lo, node_p, x[row_p])
                np.maximum.at(hi, node_p, x[row_p])
                splits = size > 1
            else:
                lo, hi = np.full(nodes, np.inf), np.full(nodes, -np.inf)
                value = x[row_p, own[tree_p]]
                np.minimum.at(lo, node_p, value)
                np.maximum.at(hi, node_p, value)
                splits = (size > 1) & (hi > lo)
            if level == limit:
                splits[:] = False
            done = ~splits[node_r]
            np.add.at(depth, row_r[done], level + average_path(size[node_r[done]]))
            stay = splits[node_p]
            tree_p, row_p, node_p = tree_p[stay], row_p[stay], node_p[stay]
            tree_r, row_r, node_r = tree_r[~done], row_r[~done], node_r[~done]
            if not len(row_r):
                break
            if extended:
                normal = rng.normal(size=(nodes, width))
                middle = np.where(splits[:, None], lo + rng.random((nodes, width)) * np.where(splits[:, None], hi - lo, 0.0), 0.0)
                cut = (normal * middle).sum(axis=1)
                above_p, above_r = ((x[r] * normal[k]).sum(axis=1) > cut[k] for r, k in ((row_p, node_p), (row_r, node_r)))
            else:
                cut = np.where(splits, lo + rng.random(nodes) * np.where(splits, hi - lo, 0.0), 0.0)
                above_p, above_r = (x[r, own[t]] > cut[k] for r, t, k in ((row_p, tree_p, node_p), (row_r, tree_r, node_r)))
            node_p, node_r = 2 * node_p + above_p, 2 * node_r + above_r

    block = max(1, min(trees, at_once // max(n, 1)))
    for first in range(0, trees, block):
        grow(min(block, trees - first))
    return 2 ** (-depth / trees / max(float(average_path(sample)), EPS))


def savgol(y: np.ndarray, window: int = 7, poly: int = 2) -> np.ndarray:
    """Savitzky-Golay smoothing; the edges are the polynomial through the first and last window."""
    n, h = len(y), window // 2
    if n < window:
        return y.copy()
    at = np.arange(-h, h + 1)
    design = np.vander(at, poly + 1, increasing=True)
    weights = np.linalg.pinv(design)[0]
    out = np.convolve(y, weights[::-1], "same")
    for part, where in ((slice(0, window), np.arange(h)), (slice(n - window, n), np.arange(window - h, window))):
        fit = np.linalg.lstsq(design, y[part], rcond=None)[0]
        out[np.arange(n)[part][where]] = np.vander(at, poly + 1, increasing=True)[where] @ fit
    return out


def lowess(y: np.ndarray, frac: float = 0.3, robust: int = 3) -> np.ndarray:
    """Locally weighted lines (tricube), made robust by bisquare weights of the residuals."""
    n = len(y)
    k = max(2, min(n, int(frac * n + 1e-10)))
    x, out, delta = np.arange(n, dtype=float), y.astype(float).copy(), np.ones(n)
    if n < 3:
        return out
    left, block = np.clip(np.arange(n) - k // 2, 0, n - k), max(1, (1 << 17) // k)
    for _ in range(robust + 1):
        for lo in range(0, n, block):  # lines of many rows at once, in bounded memory
            at = np.arange(lo, min(n, lo + block))
            part = left[at, None] + np.arange(k)
            d = np.abs(part - x[at, None])
            w = np.clip(1 - (d / np.maximum(d.max(axis=1, keepdims=True) * 1.0001, EPS)) ** 3, 0, None) ** 3 * delta[part]
            s = w.sum(axis=1)
            some = s > 0  # a row without weights keeps what it has
            at, part, w, s = at[some], part[some], w[some], s[some]
            mx, my = (w * part).sum(axis=1) / s, (w * y[part]).sum(axis=1) / s
            dx = part - mx[:, None]
            sxx, sxy = (w * dx**2).sum(axis=1), (w * (dx * (y[part] - my[:, None]))).sum(axis=1)
            steep = sxx > EPS
            out[at] = my + np.where(steep, sxy / np.where(steep, sxx, 1) * (x[at] - mx), 0)
        r = y - out
        mad = np.median(np.abs(r))
        if mad < EPS:
            break
        delta = np.clip(1 - (r / (6 * mad)) ** 2, 0, None) ** 2
    return out


def ar_design(y: np.ndarray, p: int, constant: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(lags and constant, target) for rows p and on; the latest lag first."""
    x = np.stack([y[p - k - 1 : len(y) - k - 1] for k in range(p)], axis=1)
    return (np.hstack([x, np.ones((len(x), 1))]) if constant else x), y[p:]


def ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


def median3(y: np.ndarray) -> np.ndarray:
    """Median of three with nearest values beyond the edges."""
    z = np.r_[y[:1], y, y[-1:]]
    return np.median(np.stack([z[:-2], z[1:-1], z[2:]]), axis=0) if len(y) else y
