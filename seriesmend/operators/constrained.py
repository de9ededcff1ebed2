"""Repairs that respect mined constraints: a value depends on repaired ones before it, so each is a kernel over a sample.

`bounds`: feature -> (lower, upper); speed is per unit of time, acceleration per unit of time of the speed. A feature without bounds stays.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappush, heappushpop

import numpy as np
from pyspark.sql import DataFrame

from seriesmend.operators import kernels as K
from seriesmend.operators.constraints import Constraints, RowConstraint
from seriesmend.spec import SeriesSpec, per_series

Bounds = dict[str, tuple[float, float]]


def _each(spec: SeriesSpec, fn: Callable[[np.ndarray, np.ndarray, int], np.ndarray], *needed: Bounds):
    """Kernel: fn(column filled in line, times, place of the feature) for features with all needed bounds."""

    def kernel(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = x.copy()
        for j, f in enumerate(spec.features):
            if all(f in b for b in needed) and len(x) > 1:
                out[:, j] = fn(K.fill_linear(x[:, j]), t, j)
        return out

    return kernel


def _allowed_middles(y: np.ndarray, t: np.ndarray, lo: float, hi: float, window: float, own: bool) -> np.ndarray:
    """For each row the median of what the later rows within `window` time units allow and, with own or where there is none, the own value. Rows with equally many later rows are one array, in parts of a million numbers."""
    if (t[1:] >= t[:-1]).all():
        ends = np.searchsorted(t, t + window, "right")
    else:
        ends = np.array([np.searchsorted(t, v, "right") for v in t + window])
    some, out = ends - np.arange(1, len(y) + 1), y.copy()
    for n in np.unique(some[some > 0]).tolist():
        rows = np.flatnonzero(some == n)
        for i in np.array_split(rows, -(-len(rows) * (2 * n + 1) // 1_000_000)):
            later = i[:, None] + np.arange(1, n + 1)
            gap = t[later] - t[i][:, None]
            out[i] = np.median(np.hstack([y[later] - hi * gap, y[later] - lo * gap, *([y[i][:, None]] if own else [])]), axis=1)
    return out


def screen_column(y: np.ndarray, t: np.ndarray, lo: float, hi: float, window: float) -> np.ndarray:
    """SCREEN: the middle of the own value and what later rows within `window` time units allow, clipped to what the repaired row before allows; the first row stays."""
    out = y.tolist()
    mids, gaps = _allowed_middles(y, t, lo, hi, window, True).tolist(), np.diff(t).tolist()
    for i in range(1, len(out)):
        before, d = out[i - 1], gaps[i - 1]
        out[i] = min(max(mids[i], before + lo * d), before + hi * d)
    return np.array(out)


def screen(df: DataFrame, spec: SeriesSpec, speed: Bounds, window: float = 5) -> DataFrame:
    return per_series(df, spec, _each(spec, lambda y, t, j: screen_column(y, t, *speed[spec.features[j]], window), speed))


def _local(y: np.ndarray, t: np.ndarray, speed: tuple, accel: tuple | None, window: float, own: bool) -> np.ndarray:
    out = y.tolist()
    mids, gaps = _allowed_middles(y, t, *speed, window, own).tolist(), np.maximum(np.diff(t), K.EPS).tolist()
    for i in range(1, len(out)):
        d = gaps[i - 1]
        lo, hi = out[i - 1] + speed[0] * d, out[i - 1] + speed[1] * d
        if accel is not None and i > 1:
            v = (out[i - 1] - out[i - 2]) / gaps[i - 2]
            alo, ahi = out[i - 1] + (v + accel[0] * d) * d, out[i - 1] + (v + accel[1] * d) * d
            lo, hi = (max(lo, alo), min(hi, ahi)) if max(lo, alo) <= min(hi, ahi) else (lo, hi)
        out[i] = min(max(mids[i], lo), hi)
    return np.array(out)


def speed_local(df: DataFrame, spec: SeriesSpec, speed: Bounds, window: float = 50) -> DataFrame:
    """Median of what later rows and the own value allow, clipped by the speed from the repaired row before; the first row stays."""
    return per_series(df, spec, _each(spec, lambda y, t, j: _local(y, t, speed[spec.features[j]], None, window, True), speed))


def speed_accel_local(df: DataFrame, spec: SeriesSpec, speed: Bounds, accel: Bounds, window: float = 50) -> DataFrame:
    """As speed_local, within the acceleration too; speed alone where both leave nothing."""
    return per_series(df, spec, _each(spec, lambda y, t, j: _local(y, t, speed[spec.features[j]], accel[spec.features[j]], window, True), speed, accel))


def speedacc(df: DataFrame, spec: SeriesSpec, speed: Bounds, accel: Bounds, window: float = 5) -> DataFrame:
    """As speed_accel_local with a short window."""
    return speed_accel_local(df, spec, speed, accel, window)


def least_change(y: np.ndarray, maps: list[tuple[np.ndarray, np.ndarray, np.ndarray]], l1: bool, most: int = 60, place: np.ndarray | None = None) -> np.ndarray:
    """Least change of y (absolute or squared) with lower <= A x <= upper for each (A, lower, upper): a primal-dual interior-point method, dense, for a chunk.

    place: for each value of y the place of its x, where several values of y share one (0, 1, ... without gaps; default: one each). The change is then summed over all values of y.
    Rows are scaled to norm 1 and values to their deviation, so that the units of time and value don't matter. ValueError if it doesn't settle.
    """
    place = np.arange(len(y)) if place is None else place
    several = np.bincount(place)
    mean = y.copy() if len(several) == len(y) else np.bincount(place, y) / several
    a = np.vstack([m for m, _, _ in maps])
    lo, hi = np.concatenate([v for _, v, _ in maps]), np.concatenate([v for _, _, v in maps])
    norm = np.sqrt((a**2).sum(axis=1))
    a, lo, hi = a / norm[:, None], lo / norm, hi / norm
    if (y == mean[place]).all() and ((a @ mean >= lo - 1e-12) & (a @ mean <= hi + 1e-12)).all():
        return mean
    middle, unit = y.mean(), max(y.std(), 1e-12)
    shift = a.sum(axis=1) * middle
    g = np.vstack([a[np.isfinite(hi)], -a[np.isfinite(lo)]])
    h = np.r_[(hi - shift)[np.isfinite(hi)], (shift - lo)[np.isfinite(lo)]] / unit
    goal, centre, n, m = (y - middle) / unit, (mean - middle) / unit, len(y), len(h)
    gather = (lambda v: v) if n == len(several) else lambda v: np.bincount(place, v)
    # with l1: goal - s <= x <= goal + s, and the sum of s is least; p and r are the slacks of these, z that of g x <= h; each with its multiplier
    x, s = centre.copy(), np.ones(n)
    slack, mult = np.ones(m + 2 * n * l1), np.ones(m + 2 * n * l1)
    slack[:m] = np.maximum(h - g @ x, 1.0)
    for _ in range(most):
        z, p, r = np.split(slack, [m, m + n * l1])
        lam, u, v = np.split(mult, [m, m + n * l1])
        away = g.T @ lam + (gather(u - v) if l1 else several * (x - centre))
        still = 1 - u - v if l1 else np.zeros(n)
        gap = np.r_[g @ x + z - h, x[place] - s + p - goal, goal - x[place] - s + r] if l1 else g @ x + z - h
        mu = slack @ mult / len(slack)
        if mu < 1e-12 and max(np.abs(away).max(), np.abs(still).max(), np.abs(gap).max()) < 1e-9:
            break
        w = mult / slack
        wz, wp, wr = np.split(w, [m, m + n * l1])
        bent = (g.T * wz) @ g
        if l1:
            both = wp + wr
            bent[np.diag_indices(len(x))] += gather(4 * wp * wr / both)
        else:
            bent[np.diag_indices(len(x))] += several

        def step(target: np.ndarray, bent=bent, away=away, still=still, gap=gap, w=w, slack=slack, mult=mult):
            push = w * gap + (target - slack * mult) / slack  # what the multipliers would be with no move, less what they are
            left = -away - g.T @ push[:m]
            if l1:
                low = -still + push[m : m + n] + push[m + n :]
                left = left - gather(push[m : m + n]) + gather(push[m + n :])
                wp, wr = w[m : m + n], w[m + n :]
                dx = np.linalg.solve(bent, left + gather((wp - wr) / (wp + wr) * low))
                ds = (low + (wp - wr) * dx[place]) / (wp + wr)
                moved = np.r_[g @ dx, dx[place] - ds, -dx[place] - ds]
            else:
                dx = np.linalg.solve(bent, left)
                ds, moved = np.zeros(n), g @ dx
            dslack = -gap - moved
            return dx, ds, dslack, (target - mult * dslack) / slack - mult

        def room(value: np.ndarray, change: np.ndarray) -> float:
            down = change < 0
            return min(1.0, float((value[down] / -change[down]).min(initial=np.inf)))

        bent[np.diag_indices(len(x))] += 1e-14 * bent.max()  # at the bounds the weights of some rows outgrow those of the rest beyond what doubles hold
        dx, ds, dslack, dmult = step(np.zeros(len(slack)))
        after = (slack + room(slack, dslack) * dslack) @ (mult + room(mult, dmult) * dmult) / len(slack)
        dx, ds, dslack, dmult = step((after / mu) ** 3 * mu - dslack * dmult)
        far = 0.995 * min(room(slack, dslack), room(mult, dmult))
        x, s, slack, mult = x + far * dx, s + far * ds, slack + far * dslack, mult + far * dmult
    else:
        if not np.abs(gap).max() < 1e-5:
            raise ValueError("the bounds leave no values, or the solver didn't settle")
    return x * unit + middle


def _steps(t: np.ndarray, order: int) -> np.ndarray:
    """Matrix of speeds (1) or accelerations (2) of a chunk."""
    n = len(t)
    d = np.maximum(np.diff(t), K.EPS)
    s = (np.eye(n)[1:] - np.eye(n)[:-1]) / d[:, None]
    return s if order == 1 else (s[1:] - s[:-1]) / d[1:, None]


def _going_on(v: float, a: float, b: float, last: float, d: float, gap: float, accel: tuple) -> float:
    """The speed nearest v within [a, b] that the value it leads to, d after `last`, can go on with through a next step of `gap`. In a step of no time a value moves by a few units in its last place,
    so that not every speed has a double to go on to; where steps are longer, every one has."""
    place = np.spacing(abs(last + v * d))
    if not place / gap > 0.1 * (accel[1] - accel[0]) * gap:
        return v
    for unit in (place / gap, 2 * place / gap):  # the second where the move leads to values of wider places
        k = np.round(v / unit)
        k = np.floor(b / unit) if k * unit > b else np.ceil(a / unit) if k * unit < a else k
        if a <= k * unit <= b and np.spacing(abs(last + k * unit * d)) <= 1.5 * unit * gap:
            return float(k * unit)
    return v


def _in_time(y: np.ndarray, gaps: np.ndarray, lo: float, hi: float, accel: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the speed of each step, within lo and hi, that leave time to come to a speed which the value before a step of no time can go on with. Such speeds are multiples of what moves a value's
    last place in no time; where those lie too far apart for the acceleration (large values, short steps), the one that is always in reach in time is 0."""
    low, high = np.full(len(gaps), float(lo)), np.full(len(gaps), float(hi))
    if not lo <= 0 <= hi:
        return low, high
    for i in range(len(gaps) - 2, -1, -1):
        still = gaps[i + 1] == K.EPS
        low[i], high[i] = (low[i + 1], high[i + 1]) if still else (max(lo, low[i + 1] - accel[1] * gaps[i + 1]), min(hi, high[i + 1] - accel[0] * gaps[i + 1]))
        if still and gaps[i] > K.EPS:
            unit = 2 * np.spacing(abs(y[i + 1])) / K.EPS  # twice: a repaired value may have a wider last place
            if unit > (accel[1] - accel[0]) / 2 * gaps[i]:
                low[i] = high[i] = 0.0
            else:
                low[i], high[i] = (np.ceil(low[i] / unit) * unit if low[i] > lo else lo), (np.floor(high[i] / unit) * unit if high[i] < hi else hi)
    return low, high


def kept_to(y: np.ndarray, t: np.ndarray, speed: tuple | None, accel: tuple | None) -> np.ndarray:
    """y from left to right, each value moved as little as the ones before it ask for: a series within speed and acceleration stays, any other comes to be. Acceleration bounds hold 0, so that going on at the last speed is always allowed."""
    out, v = y.copy(), None
    lo, hi = speed or (-np.inf, np.inf)
    gaps = np.maximum(np.diff(t), K.EPS)
    low, high = _in_time(y, gaps, lo, hi, accel) if accel is not None else (np.full(len(gaps), lo), np.full(len(gaps), hi))
    for i, d in enumerate(gaps, 1):
        lo, hi = low[i - 1], high[i - 1]
        a, b = (lo, hi) if v is None or accel is None else (max(lo, v + accel[0] * d), min(hi, v + accel[1] * d))
        now = (out[i] - out[i - 1]) / d
        v = v if v is not None and accel is not None and d == K.EPS else min(max(now, a), b)  # in no time the speed goes on as it is
        if accel is not None and i < len(gaps):
            v = _going_on(v, a, b, out[i - 1], d, gaps[i], accel)
        if v != now:
            out[i] = out[i - 1] + v * d
            v = (out[i] - out[i - 1]) / d if d == K.EPS else v
    return out


def within_steps(y: np.ndarray, t: np.ndarray, speed: tuple | None, accel: tuple | None, l1: bool, size: int, overlap: float) -> np.ndarray:
    """Least change within speed and acceleration, in chunks of moments from left to right. A chunk starts with two moments of the one before, which stay, and may change the rest of its overlap.
    Rows without time between them are one moment: no speed leads from one value to another there."""
    if accel is not None and not accel[0] <= 0 <= accel[1]:
        raise ValueError("acceleration bounds must hold 0")
    gaps = np.maximum(np.diff(t, prepend=t[:1]), K.EPS)
    place = np.cumsum(gaps > K.EPS)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    n = len(starts)
    at = t if n == len(t) else np.cumsum(np.r_[0.0, gaps[starts[1:]]])
    ends = np.r_[starts[1:], len(y)]
    goal, middle = y.copy(), np.median if l1 else np.mean
    out = np.array([y[a] if b == a + 1 else middle(y[a:b]) for a, b in zip(starts, ends, strict=True)])
    step = max(3, int(size * (1 - overlap)))
    for lo in range(0, n, step):
        part = slice(max(0, lo - 2 * (lo > 0)), min(n, lo + size))
        m, fixed = part.stop - part.start, lo - part.start
        maps = [(_steps(at[part], k), *(np.full(m - k, x) for x in b)) for k, b in ((1, speed), (2, accel)) if b is not None and m > k]
        first, free = out[part][:fixed], []
        for a, low, high in maps:  # what the rows that stay take up goes to the other side; rows of the map without a free value go
            some = np.abs(a[:, fixed:]).sum(axis=1) > 0
            taken = a[some, :fixed] @ first
            free.append((a[some, fixed:], low[some] - taken, high[some] - taken))
        if free and m > fixed:
            rows = slice(starts[lo], ends[part.stop - 1])
            out[lo : part.stop] = least_change(goal[rows], free, l1, place=place[rows] - lo)
        out[part] = kept_to(out[part], at[part], speed, accel)
        goal[starts[part.start] : ends[part.stop - 1]] = out[place[starts[part.start] : ends[part.stop - 1]]]
        if part.stop == n:
            break
    return kept_to(out[place], t, speed, accel)


def within_speed(y: np.ndarray, t: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The least sum of absolute changes within the speed, exactly, for the whole series in n log n: the cost of a prefix by its last value is convex and piecewise linear, kept as two heaps of the places where its slope changes."""
    left: list[float] = []  # below the least cost, negated; both without the shift that all of one side share
    right: list[float] = []
    down = up = 0.0
    best, d = [], np.maximum(np.diff(t, prepend=t[:1]), K.EPS)
    for i, v in enumerate(y.tolist()):
        if i:
            down, up = down + lo * d[i], up + hi * d[i]
        heappush(right, -heappushpop(left, -(v - down)) + down - up)
        heappush(left, -(heappushpop(right, v - up) + up - down))
        best.append((-left[0] + down, right[0] + up))
    out = y.copy()
    for i in range(len(y) - 1, -1, -1):
        x = min(max(y[i], best[i][0]), best[i][1])
        out[i] = x if i == len(y) - 1 else min(max(x, out[i + 1] - hi * d[i + 1]), out[i + 1] - lo * d[i + 1])
    return kept_to(out, t, (lo, hi), None)


def speed_global(df: DataFrame, spec: SeriesSpec, speed: Bounds) -> DataFrame:
    """Least sum of absolute changes within the speed over whole series."""
    return per_series(df, spec, _each(spec, lambda y, t, j: within_speed(y, t, *speed[spec.features[j]]), speed))


def speed_accel_global(df: DataFrame, spec: SeriesSpec, speed: Bounds, accel: Bounds, size: int = 100, overlap: float = 0.1) -> DataFrame:
    """Least sum of absolute changes within speed and acceleration (both bounds of each), in chunks."""
    return per_series(df, spec, _each(spec, lambda y, t, j: within_steps(y, t, speed[spec.features[j]], accel[spec.features[j]], True, size, overlap), speed, accel))


def _row_step(x: np.ndarray, rows: list[tuple], rate: float = 1.0) -> np.ndarray:
    """One projection of each row onto linearised row constraints; rows: (target, [(features, weight)], intercept, lower, upper) by place."""
    out = x.copy()
    for y, terms, cut, lo, hi in rows:
        value = out[:, y] - cut - sum(w * np.prod(out[:, list(f)], axis=1) for f, w in terms)
        over = np.where(value < lo, value - lo, np.where(value > hi, value - hi, 0.0))
        grad = np.zeros_like(out)
        grad[:, y] = 1
        for f, w in terms:
            for k in range(len(f)):
                grad[:, f[k]] -= w * np.prod(out[:, [c for i, c in enumerate(f) if i != k]], axis=1)
        out -= rate * (over / np.maximum((grad**2).sum(1), K.EPS))[:, None] * grad
    return out


def _placed(spec: SeriesSpec, rows: list[RowConstraint]) -> list[tuple]:
    at = {f: i for i, f in enumerate(spec.features)}
    return [(at[r.target], [([at[c] for c in t], w) for t, w in r.terms], r.intercept, r.lower, r.upper) for r in rows]


def mtclean(df: DataFrame, spec: SeriesSpec, c: Constraints, size: int = 100, rounds: int = 10) -> DataFrame:
    """Least squared change within speed, acceleration and row constraints, by turns of projections on the columns' and the rows' constraints. The columns' come last, so that speed and acceleration always hold."""
    rows = _placed(spec, c.row)

    def kernel(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = K.fill_columns(x)
        if len(x) < 2:
            return out

        def columns(x: np.ndarray) -> np.ndarray:
            got = x.copy()
            for j, f in enumerate(spec.features):
                if f in c.speed or f in c.accel:
                    got[:, j] = within_steps(x[:, j], t, c.speed.get(f), c.accel.get(f), False, size, 0.2)
            return got

        out = columns(out)
        for _ in range(rounds if rows else 0):
            before = out
            out = columns(_row_step(out, rows))
            if np.abs(out - before).max() < 1e-6:
                break
        return out

    return per_series(df, spec, kernel)


def clean4mts(df: DataFrame, spec: SeriesSpec, c: Constraints, generations: int = 50, population: int = 20, seed: int = 42, beta: float = 1.2, weight: float = 0.05) -> DataFrame:
    """In runs of violating rows a seeded search for values of few violations (weighted against the size of the change), starting from the line over the run."""
    rows = _placed(spec, c.row)
    limit = lambda d, k: [d.get(f, (-np.inf, np.inf))[k] for f in spec.features]
    slo, shi, alo, ahi = (np.array(limit(d, k)) for d in (c.speed, c.accel) for k in (0, 1))

    def cost(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Violations of each row of a batch (batch x T x D)."""
        d = np.maximum(np.diff(t), K.EPS)[:, None]
        v = np.diff(x, axis=1) / d
        bad = np.maximum(slo - v, 0) + np.maximum(v - shi, 0)
        out = np.zeros(x.shape[:2])
        out[:, 1:] += np.nan_to_num(bad).sum(-1)
        a = np.diff(v, axis=1) / d[1:]
        out[:, 2:] += np.nan_to_num(np.maximum(alo - a, 0) + np.maximum(a - ahi, 0)).sum(-1)
        for y, terms, cut, lo, hi in rows:
            r = x[..., y] - cut - sum(w * np.prod(x[..., list(f)], axis=-1) for f, w in terms)
            out += beta * (np.maximum(lo - r, 0) + np.maximum(r - hi, 0))
        return out

    def together(group: list[tuple]) -> None:
        """The search in one run of each of several series: (rows, times, generator, least, greatest, deviation, first and last row), all at once; each series draws from its own generator. A run begins at column 3, with up to three rows on either side that stay."""
        n, d, half = len(group), len(spec.features), population // 2
        sizes = np.array([b - a for *_, a, b in group])
        long = sizes.max()
        around, times, there = np.zeros((n, population, long + 6, d)), np.zeros((n, long + 6)), np.zeros((n, long + 6), bool)
        own, pop = np.zeros((n, 1, long, d)), np.zeros((n, population, long, d))
        inside = (np.arange(long) < sizes[:, None])[:, None, :, None]
        floor, ceil, spread = (np.stack([g[k] for g in group])[:, None, None] for k in (3, 4, 5))
        for i, (out, t, rng, _, _, wide, a, b) in enumerate(group):
            lo, hi, m = max(0, a - 3), min(len(out), b + 3), b - a
            put = slice(3 - (a - lo), 3 + hi - a)
            around[i, :, put], times[i, put], there[i, put], own[i, 0, :m] = out[lo:hi], t[lo:hi], True, out[a:b]
            line = np.stack([np.interp(np.arange(a, b), [max(a - 1, 0), min(b, len(out) - 1)], [out[max(a - 1, 0), j], out[min(b, len(out) - 1), j]]) for j in range(d)], axis=1)
            pop[i, :, :m] = np.concatenate([out[None, a:b], line[None], line + rng.normal(size=(population - 2, m, d)) * wide * 0.2])
        step = there[:, 1:] & there[:, :-1]
        gap = np.where(step, np.maximum(np.diff(times, axis=1), K.EPS), 1.0)[:, None, :, None]
        bend, price = (step[:, 1:] & step[:, :-1])[:, None], weight / spread.mean(axis=(1, 2, 3))[:, None]

        def fit() -> np.ndarray:
            np.copyto(around[:, :, 3 : 3 + long], pop, where=inside)
            v = np.diff(around, axis=2) / gap
            total = np.where(step[:, None], (np.maximum(slo - v, 0) + np.maximum(v - shi, 0)).sum(axis=3), 0.0).sum(axis=2)
            a = np.diff(v, axis=2) / gap[:, :, 1:]
            total += np.where(bend, (np.maximum(alo - a, 0) + np.maximum(a - ahi, 0)).sum(axis=3), 0.0).sum(axis=2)
            for y, terms, cut, lo, hi in rows:
                r = around[..., y] - cut - sum(w * np.prod(around[..., list(f)], axis=-1) for f, w in terms)
                total += beta * np.where(there[:, None], np.maximum(lo - r, 0) + np.maximum(r - hi, 0), 0.0).sum(axis=2)
            return total + np.abs(pop - own).sum(axis=(2, 3)) * price

        at, rest = np.arange(n)[:, None], population - half
        mix, one, two, push = np.zeros((n, rest, 1, 1)), np.zeros((n, rest), int), np.zeros((n, rest), int), np.zeros((n, rest, long, d))
        for _ in range(generations):
            best = pop[at, np.argsort(fit(), axis=1, kind="stable")[:, :half]]
            for i, g in enumerate(group):
                mix[i], one[i], two[i] = g[2].random((rest, 1, 1)), g[2].integers(half, size=rest), g[2].integers(half, size=rest)
                push[i, :, : sizes[i]] = g[2].normal(size=(rest, sizes[i], d))
            child = mix * best[at, one] + (1 - mix) * best[at, two]
            pop[:, :half], pop[:, half:] = best, np.clip(child + push * spread * 0.05, floor, ceil) * inside
        for i, (k, (out, *_, a, b)) in enumerate(zip(fit().argmin(axis=1), group, strict=True)):
            out[a:b] = pop[i, k, : b - a]

    def kernel(xs: list[np.ndarray], ts: list[np.ndarray]) -> list[np.ndarray]:
        done, open_ = [K.fill_columns(x) for x in xs], []
        for out, t in zip(done, ts, strict=True):
            if len(out) >= 5:
                edges = np.flatnonzero(np.diff(np.r_[0, (cost(out[None], t)[0] > 1e-9).astype(int), 0]))
                open_.append((list(zip(edges[::2], edges[1::2], strict=True)), (out, t, np.random.default_rng(seed), out.min(0), out.max(0), out.std(0) + K.EPS)))
        turn = 0
        while open_ := [o for o in open_ if len(o[0]) > turn]:  # the next run of every series that has one, those of a length together
            now = sorted((g + runs[turn] for runs, g in open_), key=lambda g: g[7] - g[6])
            while now:
                many = max(1, 4096 // int(now[-1][7] - now[-1][6] + 6))
                together(now[-many:])
                del now[-many:]
            turn += 1
        return done

    return per_series(df, spec, kernel, many=True)


def mtcsc(df: DataFrame, spec: SeriesSpec, speed: Bounds, window: float = 5) -> DataFrame:
    """All features together: a row moves if the way to it from the repaired row before, or from it to a leading row, is too fast in any feature. The leading row is the first of the longest chain in the row's window: later rows each join the chain of the nearest row before
    them that they keep to the speed with, and a row that is near enough to the repaired one may begin a chain. A row that moves goes from the repaired row towards the leading one (itself, if there is no chain) as far as the speed allows up to its own time, at most all the way; without later
    rows in its window it becomes the repaired one."""
    free = (-np.inf, np.inf)
    lo, hi = (np.array([speed.get(f, free)[k] for f in spec.features]) for k in (0, 1))

    def kernel(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = K.fill_columns(x)

        def fits(i: int, k: int) -> bool:
            d, way = max(t[k] - t[i], K.EPS), out[k] - out[i]
            return bool(((way >= lo * d - 1e-12) & (way <= hi * d + 1e-12)).all())

        def leading(i: int, last: int) -> int:
            """The first row of the longest chain among rows i + 1 to last, or i."""
            chain: dict[int, int] = {}
            size: dict[int, int] = {}
            for k in range(i + 1, last + 1):
                first = next((chain[j] for j in range(k - 1, i, -1) if j in chain and fits(j, k)), k if fits(i - 1, k) else None)
                if first is not None:
                    chain[k] = first
                    size[first] = size.get(first, 0) + 1
            return max(size, key=lambda k: (size[k], -k)) if size else i

        for i in range(1, len(out)):
            last = int(np.searchsorted(t, t[i] + window, "right")) - 1
            if last <= i:
                if not fits(i - 1, i):
                    out[i] = out[i - 1]
                continue
            to = leading(i, last)
            if fits(i - 1, i) and (to == i or fits(i, to)):
                continue
            way, d = out[to] - out[i - 1], max(t[i] - t[i - 1], K.EPS)
            allowed = np.where(way > 0, hi, -lo) * d
            share = np.divide(allowed, np.abs(way), out=np.ones_like(way), where=way != 0).min()
            out[i] = out[i - 1] + min(max(share, 0.0), 1.0) * way
        return out

    return per_series(df, spec, kernel)


def _compatible_chain(y: np.ndarray, t: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The most rows of which all neighbours keep to the speed: a longest chain in two coordinates, in n log n."""
    # row i may come before k if y_k - hi t_k <= y_i - hi t_i and y_k - lo t_k >= y_i - lo t_i
    from bisect import bisect_right

    a, b = -(y - hi * t), y - lo * t
    order = np.lexsort((b, a))  # both must not fall; equal times order by value
    tails, at, before = [], [], np.full(len(y), -1)
    for i in order:
        k = bisect_right(tails, b[i])
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(b[i])
            at.append(i)
        else:
            tails[k], at[k] = b[i], i
    keep = np.zeros(len(y), bool)
    i = at[-1] if at else -1
    while i >= 0:
        keep[i] = True
        i = before[i]
    return keep


def htd(df: DataFrame, spec: SeriesSpec, speed: Bounds, degree: int = 3) -> DataFrame:
    """Rows outside of the longest chain that keeps to the speed take a cubic in time through the kept rows around."""
    def fn(y, t, j):
        keep = _compatible_chain(y, t, *speed[spec.features[j]])
        out, good = y.copy(), np.flatnonzero(keep)
        for i in np.flatnonzero(~keep):
            k = np.searchsorted(good, i)
            near = good[max(0, k - degree - 1) : k + degree + 1]
            if len(near) > degree:
                m, s = t[near].mean(), max(np.ptp(t[near]), K.EPS)
                out[i] = np.clip(np.polyval(np.polyfit((t[near] - m) / s, y[near], degree), (t[i] - m) / s), y[near].min(), y[near].max())
        return out

    return per_series(df, spec, _each(spec, fn, speed))


def one_milp(df: DataFrame, spec: SeriesSpec, speed: Bounds) -> DataFrame:
    """The fewest rows are changed: those outside of the longest compatible chain lie on the line between its rows (the ends hold their nearest). Exact, without a solver, for one column."""
    def fn(y, t, j):
        keep = _compatible_chain(y, t, *speed[spec.features[j]])
        return np.interp(t, t[keep], y[keep]) if keep.any() else y

    return per_series(df, spec, _each(spec, fn, speed))


def compatible_rows(x: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The most rows (T x D) of which each keeps to the speed from the one before in all columns. A row's longest chain goes on from the longest chain that ends in a row it can follow: ends of chains are kept by their length, and looked at from the longest down, so that clean
    stretches cost a look at few rows."""
    n = len(x)
    ends: list[list[int]] = []
    before, length = np.full(n, -1), np.ones(n, int)
    for i in range(n):
        for k in range(len(ends), 0, -1):
            rows = np.array(ends[k - 1])
            d, way = np.maximum(t[i] - t[rows], 0)[:, None], x[i] - x[rows]
            fits = ((way >= lo * d - 1e-12) & (way <= hi * d + 1e-12)).all(axis=1)
            if fits.any():
                before[i], length[i] = rows[np.flatnonzero(fits)[-1]], k + 1
                break
        if length[i] > len(ends):
            ends.append([])
        ends[length[i] - 1].append(i)
    keep = np.zeros(n, bool)
    i = int(length.argmax()) if n else -1
    while i >= 0:
        keep[i] = True
        i = before[i]
    return keep


def one_milp_rows(df: DataFrame, spec: SeriesSpec, speed: Bounds) -> DataFrame:
    """The fewest rows are changed, a row counting once whatever columns of it change: those outside of the longest compatible chain of whole rows lie on the line between its rows (the ends hold their nearest). Exact for any number of columns."""
    free = (-np.inf, np.inf)
    lo, hi = (np.array([speed.get(f, free)[k] for f in spec.features]) for k in (0, 1))

    def kernel(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        x = K.fill_columns(x)
        keep = compatible_rows(x, t, lo, hi)
        return np.stack([np.interp(t, t[keep], c[keep]) for c in x.T], axis=1) if keep.any() else x

    return per_series(df, spec, kernel)


def interval_roots(a: float, b: float, c: float) -> tuple[float, float] | None:
    """The interval of a x^2 + b x + c <= 0 for a > 0; a half line for a = 0; None if it is empty."""
    if abs(a) < 1e-15:
        return None if abs(b) < 1e-15 and c > 0 else (-np.inf, np.inf) if abs(b) < 1e-15 else (-np.inf, -c / b) if b > 0 else (-c / b, np.inf)
    d = b * b - 4 * a * c
    return None if d < 0 else tuple(sorted(((-b - d**0.5) / (2 * a), (-b + d**0.5) / (2 * a))))


def steadied(ys: list[np.ndarray], top: float, window: int, beta: float) -> list[np.ndarray]:
    """From left to right: for every window of too great a variance (over top) that ends at or after a row, the value nearest the own one at which that window keeps to it; the weighted mean of those, later windows by beta. All series side by side, longest first."""
    out = [y.copy() for y in ys]
    order = sorted((i for i in range(len(ys)) if len(ys[i]) >= window > 1), key=lambda i: -len(ys[i]))
    if not order:
        return out
    sizes = np.array([len(ys[i]) for i in order])
    wide = np.zeros((len(order), sizes[0]))
    for row, i in zip(wide, order, strict=True):
        row[: len(ys[i])] = ys[i]
    every = np.lib.stride_tricks.sliding_window_view(wide, window, axis=1)
    a = (window - 1) / window**2
    for i in range(sizes[0]):
        live = int((sizes > i).sum())
        ends = np.arange(max(i, window - 1), min(sizes[0], i + window))
        part = every[:live, ends - window + 1]
        over = (part.var(axis=2) > top + 1e-12) & (ends < sizes[:live, None])
        rows = np.flatnonzero(over.any(axis=1))
        if not len(rows):
            continue
        over, own = over[rows], wide[rows, i]
        rest = part[rows][:, np.arange(window) != (i - (ends - window + 1))[:, None]].reshape(len(rows), len(ends), window - 1)
        s, q = rest.sum(axis=2), (rest**2).sum(axis=2)
        b, c = -2 * s / window**2, q / window - (s / window) ** 2 - top
        d = b * b - 4 * a * c
        root = np.sqrt(np.maximum(d, 0))
        near = np.minimum(np.maximum(own[:, None], (-b - root) / (2 * a)), (-b + root) / (2 * a))
        picks = np.where(d < 0, s / (window - 1), near)
        weights = np.where(over, beta ** np.arange(len(ends)), 0.0)
        wide[rows, i] = (np.where(over, picks, 0.0) * weights).sum(axis=1) / weights.sum(axis=1)
    for row, i in zip(wide, order, strict=True):
        out[i] = row[: len(ys[i])].copy()
    return out


def variance(df: DataFrame, spec: SeriesSpec, bounds: Bounds, window: int = 10, beta: float = 0.5) -> DataFrame:
    """Each window keeps to the upper bound of its variance, by `steadied`."""

    def kernel(xs: list[np.ndarray], _) -> list[np.ndarray]:
        out = [x.copy() for x in xs]
        some = [i for i, x in enumerate(xs) if len(x) > 1]
        for j, f in enumerate(spec.features):
            if f in bounds:
                for i, y in zip(some, steadied([K.fill_linear(xs[i][:, j]) for i in some], bounds[f][1], window, beta), strict=True):
                    out[i][:, j] = y
        return out

    return per_series(df, spec, kernel, many=True)


#: Which constraints each repair takes.
CONSTRAINT_REPAIRS: dict[str, Callable[[DataFrame, SeriesSpec, Constraints], DataFrame]] = {
    "mtclean": mtclean, "speedacc": lambda d, s, c: speedacc(d, s, c.speed, c.accel), "clean4mts": clean4mts, "mtcsc_n": lambda d, s, c: mtcsc(d, s, c.speed), "htd": lambda d, s, c: htd(d, s, c.speed),
    "screen": lambda d, s, c: screen(d, s, c.speed), "oneMilp": lambda d, s, c: one_milp(d, s, c.speed), "speed_local": lambda d, s, c: speed_local(d, s, c.speed), "speed_global": lambda d, s, c: speed_global(d, s, c.speed),
    "speed_accel_local": lambda d, s, c: speed_accel_local(d, s, c.speed, c.accel), "speed_accel_global": lambda d, s, c: speed_accel_global(d, s, c.speed, c.accel), "variance": lambda d, s, c: variance(d, s, c.variance), "oneMilp_rows": lambda d, s, c: one_milp_rows(d, s, c.speed),
}
