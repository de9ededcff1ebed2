"""Kernels that take many series or rows at once, against plain loops."""

import numpy as np

from seriesmend.operators import constrained, kernels, metrics, repair
from seriesmend.operators.constraints import Constraints
from seriesmend.spec import SeriesSpec


def plain_lowess(y, frac, robust=3):
    n, k = len(y), max(2, min(len(y), int(frac * len(y) + 1e-10)))
    out, delta, x = y.copy(), np.ones(n), np.arange(float(n))
    for _ in range(robust + 1):
        for i in range(n):
            lo = min(max(i - k // 2, 0), n - k)
            part = slice(lo, lo + k)
            d = np.abs(x[part] - i)
            w = np.clip(1 - (d / (d.max() * 1.0001)) ** 3, 0, None) ** 3 * delta[part]
            if w.sum() > 0:
                mx, my = (w @ x[part]) / w.sum(), (w @ y[part]) / w.sum()
                sxx = w @ (x[part] - mx) ** 2
                out[i] = my + ((w @ ((x[part] - mx) * (y[part] - my))) / sxx * (i - mx) if sxx > 1e-8 else 0)
        r = y - out
        mad = np.median(np.abs(r))
        if mad < 1e-8:
            break
        delta = np.clip(1 - (r / (6 * mad)) ** 2, 0, None) ** 2
    return out


def test_local_lines_against_loops(monkeypatch):
    rng = np.random.default_rng(2)
    for n, frac in ((3, 0.3), (20, 0.3), (67, 0.3), (500, 0.9)):
        y = rng.standard_normal(n).cumsum() + 8 * (rng.random(n) < 0.05)
        assert np.allclose(kernels.lowess(y, frac), plain_lowess(y, frac))
    calls, clip = [], np.clip
    monkeypatch.setattr(np, "clip", lambda *a, **k: calls.append(1) or clip(*a, **k))
    kernels.lowess(y)
    assert len(calls) < 50  # not one for each row


def test_hidden_states_side_by_side_are_what_each_is_alone(monkeypatch):
    rng = np.random.default_rng(6)
    ys = [rng.standard_normal(n) + 4 * (np.arange(n) // 7 % 3) for n in (30, 2, 66, 1, 41, 30)] + [np.full(12, 3.0)]
    alone = [repair.hidden_states(y, 5) for y in ys]
    assert all(len(path) == len(y) and path.max(initial=0) < len(mean) for y, (mean, _, path) in zip(ys, alone, strict=True))
    groups, plain = [], repair._baum_welch
    monkeypatch.setattr(repair, "_baum_welch", lambda s, *a: groups.append(len(s)) or plain(s, *a))
    for want, got in zip(alone, repair.hidden_states_many(ys, 5), strict=True):
        assert all(np.allclose(p, q) for p, q in zip(want, got, strict=True))
    assert len(groups) < len(ys) and sum(groups) == len(ys)


def plain_variance(y, top, window=10, beta=0.5):
    out, n = y.copy(), len(y)
    for i in range(n):
        picks, weights = [], []
        for k, end in enumerate(range(max(i, window - 1), min(n, i + window))):
            part = out[end - window + 1 : end + 1]
            if part.var() > top + 1e-12:
                rest = np.delete(part, i - (end - window + 1))
                s, q = rest.sum(), (rest**2).sum()
                got = constrained.interval_roots((window - 1) / window**2, -2 * s / window**2, q / window - (s / window) ** 2 - top)
                picks.append(min(max(out[i], got[0]), got[1]) if got else rest.mean())
                weights.append(beta**k)
        if picks:
            out[i] = np.average(picks, weights=weights)
    return out


def plain_least_change(y, p=3, delta=1e-5, most=100, window=11):
    if len(y) <= p:
        return y
    size = min(len(y), window)
    base = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(y, (size // 2, size - 1 - size // 2), mode="symmetric"), size), axis=1)
    rest = y - base
    for _ in range(most):
        x, t = kernels.ar_design(rest, p, constant=False)
        pred = x @ kernels.ols(x, t)
        off = np.abs(t - pred)
        i = int(off.argmax())
        if off[i] < max(3 * np.median(np.abs(off - np.median(off))), 1e-6) or off[i] < delta:
            break
        rest[p + i] = pred[i]
    return base + rest


def uneven():
    rng = np.random.default_rng(7)
    return [rng.exponential(50, size=int(k)) for k in [1, 2, 4, 9, 10, 11, 12, 30, 31, 64, 80]] + [np.full(25, 3.0), np.zeros(14), np.r_[np.zeros(20), 500.0, np.zeros(9)]]


def test_variance_of_many_series_against_loops():
    ys = uneven()
    for y, got in zip(ys, constrained.steadied(ys, 400.0, 10, 0.5), strict=True):
        np.testing.assert_allclose(got, plain_variance(y, 400.0), rtol=1e-9, atol=1e-9)


def test_least_changes_of_many_series_against_loops():
    ys = uneven()
    for y, got in zip(ys, repair.least_changed(ys), strict=True):
        np.testing.assert_allclose(got, plain_least_change(y), rtol=1e-9, atol=1e-9)


def test_mixtures_of_many_tables_against_one_at_a_time():
    rng = np.random.default_rng(5)
    fits = (("full", 1e-3), ("diag", 1e-2), ("spherical", 1e-4))
    for d, k in ((1, 5), (3, 2)):
        xs = [rng.exponential(5, size=(n, d)) for n in (1, 2, 3, 6, 7, 20, 41, 60)] + [np.full((9, d), 2.0)]
        for x, found in zip(xs, kernels.gmm_many(xs, k, fits, at_once=200), strict=True):
            for (kind, reg), (means, resp, ll) in zip(fits, found, strict=True):
                _, m, _, r, like = kernels.gmm(x, k, kind, reg)
                np.testing.assert_allclose(means, m, rtol=1e-7, atol=1e-9)
                np.testing.assert_allclose(resp, r, rtol=1e-7, atol=1e-9)
                np.testing.assert_allclose(ll, like, rtol=1e-7, atol=1e-9)


def plain_search(x, t, speed, generations, population, seed=42, weight=0.05):
    out = kernels.fill_columns(x)

    def cost(x, t):
        d = np.maximum(np.diff(t), kernels.EPS)[:, None]
        v = np.diff(x, axis=1) / d
        bad = np.zeros(x.shape[:2])
        bad[:, 1:] = (np.maximum(speed[0] - v, 0) + np.maximum(v - speed[1], 0)).sum(-1)
        return bad

    if len(x) < 5:
        return out
    edges = np.flatnonzero(np.diff(np.r_[0, (cost(out[None], t)[0] > 1e-9).astype(int), 0]))
    rng, floor, ceil, spread = np.random.default_rng(seed), out.min(0), out.max(0), out.std(0) + kernels.EPS
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        lo, hi = max(0, a - 3), min(len(out), b + 3)

        def fit(pop):
            whole = np.stack([np.concatenate([out[lo:a], p, out[b:hi]]) for p in pop])  # noqa: B023
            return cost(whole, t[lo:hi]).sum(1) + weight * np.abs(pop - out[a:b]).sum((1, 2)) / spread.mean()  # noqa: B023

        line = np.interp(np.arange(a, b), [max(a - 1, 0), min(b, len(out) - 1)], out[[max(a - 1, 0), min(b, len(out) - 1)], 0])[:, None]
        pop = np.concatenate([out[None, a:b], line[None], line + rng.normal(size=(population - 2, b - a, 1)) * spread * 0.2])
        for _ in range(generations):
            best = pop[np.argsort(fit(pop), kind="stable")[: population // 2]]
            rest = population - len(best)
            mix = rng.random((rest, 1, 1))
            child = mix * best[rng.integers(len(best), size=rest)] + (1 - mix) * best[rng.integers(len(best), size=rest)]
            pop = np.concatenate([best, np.clip(child + rng.normal(size=child.shape) * spread * 0.05, floor, ceil)])
        out[a:b] = pop[fit(pop).argmin()]
    return out


def test_the_seeded_search_of_many_series_against_loops(monkeypatch):
    kept = {}
    monkeypatch.setattr(constrained, "per_series", lambda df, spec, kernel, many=False: kept.update(kernel=kernel, many=many))
    constrained.clean4mts(None, SeriesSpec(("col_1",)), Constraints(speed={"col_1": (-0.01, 0.01)}), generations=8, population=6)
    assert kept["many"]
    rng = np.random.default_rng(9)
    xs = [rng.exponential(50, size=(n, 1)) for n in (1, 4, 5, 6, 17, 40, 41)]
    ts = [np.cumsum(rng.integers(0, 20_000, len(x))).astype(float) for x in xs]
    for x, t, got in zip(xs, ts, kept["kernel"](xs, ts), strict=True):
        np.testing.assert_allclose(got, plain_search(x, t, (-0.01, 0.01), 8, 6), rtol=1e-9, atol=1e-9)


def test_volume_areas_of_all_windows_against_one_at_a_time(monkeypatch):
    def plain(y, s, window, thresholds):
        runs, n, h = metrics._runs(y), len(y), window // 2
        soft = y.astype(float)
        for a, b in runs:
            for k in range(1, h + 1):
                for at in (b - 1 + k, a - k):
                    if 0 <= at < n:
                        soft[at] = max(soft[at], np.sqrt(1 - k / window))
        np.testing.assert_array_equal(metrics.soft_labels(y, window), soft)
        mass, cuts = (y.sum() + soft.sum()) / 2, np.sort(s)[::-1][np.linspace(0, n - 1, thresholds).astype(int)]
        t, f, p = [0.0], [0.0], []
        for c in cuts:
            up = s >= c
            hit = soft[up].sum()
            exist = np.mean([up[max(0, a - h) : min(n, b + h)].any() for a, b in runs])
            t.append(min(hit / mass, 1) * exist)
            f.append((up.sum() - hit) / max(n - mass, 1e-10))
            p.append(hit / max(up.sum(), 1))
        t, f = np.array([*t, 1.0]), np.array([*f, 1.0])
        return ((f[1:] - f[:-1]) * (t[1:] + t[:-1]) / 2).sum(), ((t[1:-1] - t[:-2]) * p).sum()

    rng, asked = np.random.default_rng(4), []
    with monkeypatch.context() as m:
        m.setattr(metrics, "soft_labels", lambda y, window: asked.append(window))
        metrics.vus(np.array([0, 1, 0, 0]), np.arange(4.0), 5, 10)
    assert not asked  # all windows come from one pass
    for n, window in ((2, 3), (9, 20), (40, 5), (70, 12)):
        y, s = (np.arange(n) % 7 < 2).astype(int), np.round(rng.random(n), 1)
        y[0] = 0
        want = np.mean([plain(y, s, w, 30) for w in range(window + 1)], axis=0) if y.any() else (0.0, 0.0)
        np.testing.assert_allclose(metrics.vus(y, s, window, 30), want, rtol=1e-9, atol=1e-12)
    np.testing.assert_array_equal(metrics.soft_labels(np.zeros(3, int), 100), np.zeros(3))


def plain_screen(y, t, lo, hi, window):
    """A row at a time."""
    out = y.copy()
    for i in range(1, len(y)):
        later = np.arange(i + 1, np.searchsorted(t, t[i] + window, "right"))
        mid = np.median(np.r_[y[later] - hi * (t[later] - t[i]), y[later] - lo * (t[later] - t[i]), y[i]])
        out[i] = min(max(mid, out[i - 1] + lo * (t[i] - t[i - 1])), out[i - 1] + hi * (t[i] - t[i - 1]))
    return out


def test_middles_of_all_rows_at_once(monkeypatch):
    """the medians that screen takes come from a few arrays, whatever the rows."""
    rng = np.random.default_rng(4)
    for steps in (rng.integers(0, 3, 400), rng.integers(0, 9000, 400), rng.integers(0, 2, 400)):
        y, t = rng.normal(0, 3, 400), np.cumsum(steps).astype(float)
        calls = []
        with monkeypatch.context() as m:
            m.setattr(np, "median", lambda *a, median=np.median, **k: calls.append(1) or median(*a, **k))
            got = constrained.screen_column(y, t, -0.1, 0.2, 5)
        assert len(calls) < 60
        np.testing.assert_array_equal(got, plain_screen(y, t, -0.1, 0.2, 5))
