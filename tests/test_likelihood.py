"""Maximum likelihood against plain formulas and planted models."""

import numpy as np
from pyspark.sql import functions as F

from seriesmend.operators import constrained, likelihood
from seriesmend.spec import SeriesSpec

from .test_models import table

ONE = SeriesSpec(("col_1",))


def simulated(n, ar, ma, seed):
    rng = np.random.default_rng(seed)
    e, y = rng.standard_normal(n + 200), np.zeros(n + 200)
    for t in range(3, n + 200):
        y[t] = sum(a * y[t - 1 - k] for k, a in enumerate(ar)) + e[t] + sum(m * e[t - 1 - k] for k, m in enumerate(ma))
    return y[200:] - y[200:].mean()


def test_partial_autocorrelations_go_both_ways():
    rng = np.random.default_rng(1)
    r = rng.uniform(-0.95, 0.95, (50, 3))
    for row, c in zip(r, likelihood.from_partial(r), strict=True):
        assert np.allclose(likelihood.to_partial(c), row)
        assert np.abs(np.roots([1, *-c])).max() < 1
    assert likelihood.to_partial(np.array([1.2, 0.3])) is None


def test_likelihood_is_that_of_the_joint_law():
    """The density of all rows at once, from their covariances."""
    ar, ma = np.array([[0.6, -0.3], [0.1, 0.5]]), np.array([[0.4], [-0.7]])
    y = simulated(30, ar[0], ma[0], 3)
    got = likelihood.arma_likelihood(y, ar, ma)
    for k in range(2):
        psi = [1.0]
        for j in range(1, 400):
            psi.append((ma[k][j - 1] if j <= 1 else 0) + sum(ar[k][i] * psi[j - 1 - i] for i in range(2) if j - 1 - i >= 0))
        psi = np.array(psi)
        cov = np.array([[(psi[: 400 - abs(i - j)] * psi[abs(i - j) :]).sum() for j in range(30)] for i in range(30)])
        noise = y @ np.linalg.solve(cov, y) / 30
        assert abs(got[k] - (-0.5 * (30 * np.log(noise) + np.linalg.slogdet(cov)[1]))) < 1e-6


def test_fits_are_never_below_two_regressions():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        y = simulated(int(rng.integers(30, 150)), rng.uniform(-0.5, 0.7, 2), rng.uniform(-0.8, 0.8, 1), seed)
        ar, ma = likelihood.fit_arma(y / y.std(), 2, 1)
        found = likelihood.two_regressions(y / y.std(), 2, 1)
        best = likelihood.arma_likelihood(y / y.std(), ar[None], ma[None])[0]
        assert best >= likelihood.arma_likelihood(y, np.zeros((1, 2)), np.zeros((1, 1)))[0] + len(y) * np.log(y.std()) - 1e-9
        if found is not None and likelihood.to_partial(found[0]) is not None and likelihood.to_partial(-found[1]) is not None:
            assert best >= likelihood.arma_likelihood(y / y.std(), found[0][None], found[1][None])[0] - 1e-9
    y = simulated(3000, [0.7, -0.2], [0.4], 99)
    ar, ma = likelihood.fit_arma(y, 2, 1)
    assert np.allclose([*ar, *ma], [0.7, -0.2, 0.4], atol=0.12)


def test_garch_finds_planted_variances():
    rng = np.random.default_rng(6)
    r, v = np.zeros(4000), 1.0
    for t in range(4000):
        r[t] = np.sqrt(v) * rng.standard_normal()
        v = 0.1 + 0.2 * r[t] ** 2 + 0.7 * v
    arch, garch, level = likelihood.fit_garch(r)
    assert abs(arch - 0.2) < 0.06 and abs(garch - 0.7) < 0.1 and 0.4 < level * (1 - arch - garch) / 0.1 < 2.2
    one = lambda *z: likelihood.garch_likelihood(r, *(np.array([x]) for x in z))[0]
    assert one(arch, garch, level) >= one(0.2, 0.7, 1.0) - 2 and one(arch, garch, level) > one(0, 0, (r * r).mean())
    plain, v = [], (r[:50] ** 2).mean()
    for x in r[:50]:
        plain.append(v)
        v = 0.5 * (1 - 0.3 - 0.2) + 0.3 * x * x + 0.2 * v
    assert np.allclose(likelihood.garch_variances(r[:50], np.array([0.3]), np.array([0.2]), np.array([0.5]))[:, 0], plain)


def test_operators_on_odd_series(spark):
    y = simulated(150, [0.5, 0.2], [0.3], 8)
    y[70] += 15
    df = table(spark, {1: y.tolist(), 2: [1.0] * 40, 3: [None, 2.0], None: [float(t) for t in range(20)]})
    fixed = {(r.sample_id, r.t): r.col_1 for r in likelihood.arma_ml(df, ONE).collect()}
    assert len(fixed) == 212 and abs(fixed[1, 70]) < 6 and fixed[2, 5] == 1.0 and fixed[3, 0] == 2.0
    found = likelihood.garch_score(df, ONE)
    assert found.where("score IS NULL").count() == 0 and found.where("sample_id = 1").orderBy(F.desc("score")).first().t == 70
    assert found.where("sample_id = 2 AND score <> 0").count() == 0


# ---- the fewest rows -----------------------------------------------------------------------------------------------


def fewest(x, t, lo, hi):
    """The greatest number of rows that can stay, by trying all subsets."""
    n, best = len(x), 0
    for bits in range(1 << n):
        kept = [i for i in range(n) if bits >> i & 1]
        if len(kept) > best and all(((x[k] - x[i] >= lo * (t[k] - t[i]) - 1e-12) & (x[k] - x[i] <= hi * (t[k] - t[i]) + 1e-12)).all() for i, k in zip(kept, kept[1:], strict=False)):
            best = len(kept)
    return best


def test_fewest_rows_of_three_columns_by_enumeration(spark):
    spec = SeriesSpec(("a", "b", "c"))
    speed = {"a": (-1.0, 1.0), "b": (-0.5, 2.0), "c": (-2.0, 0.7)}
    lo, hi = (np.array([speed[f][k] for f in spec.features]) for k in (0, 1))
    data, want = {}, {}
    for s in range(12):
        rng = np.random.default_rng(s)
        x = np.cumsum(rng.uniform(lo, hi, (12, 3)) * 0.9, axis=0)
        for i in rng.choice(12, 4, replace=False):
            x[i, rng.integers(3)] += rng.choice([-6, 6])
        data[s], want[s] = x, fewest(x, np.arange(12.0), lo, hi)
    df = table(spark, {s: [tuple(r) for r in x] for s, x in data.items()}, spec)
    got = constrained.one_milp_rows(df, spec, speed).orderBy("sample_id", "t").collect()
    for s in range(12):
        y = np.array([(r.a, r.b, r.c) for r in got if r.sample_id == s])
        assert (np.abs(y - data[s]).max(axis=1) < 1e-9).sum() >= want[s]
        steps = np.diff(y, axis=0)
        assert (steps >= lo - 1e-9).all() and (steps <= hi + 1e-9).all()
        assert (np.abs(y - data[s]).max(axis=1) > 1e-9).sum() == 12 - want[s]


def test_fewest_rows_of_one_column_are_those_of_the_chain():
    rng = np.random.default_rng(3)
    for n in (1, 2, 60, 400):
        y, t = np.cumsum(rng.uniform(-1, 1, n)) + np.where(rng.random(n) < 0.2, rng.choice([-9, 9], n), 0), np.arange(float(n))
        keep = constrained.compatible_rows(y[:, None], t, np.array([-1.0]), np.array([1.0]))
        assert keep.sum() == constrained._compatible_chain(y, t, -1.0, 1.0).sum()


def test_series_side_by_side_are_what_each_is_alone(monkeypatch):
    """A search over many series costs few calls: one value() for a round of all of them."""
    rng = np.random.default_rng(8)
    ys = sorted((rng.standard_normal(n).cumsum() * 0.1 + rng.standard_normal(n) for n in (5, 40, 12, 30, 30)), key=lambda y: -len(y))
    ys = [(y - y.mean()) / y.std() for y in ys]
    passes = []
    plain = likelihood.filtered
    monkeypatch.setattr(likelihood, "filtered", lambda *a: passes.append(len(a[2])) or plain(*a))
    ar, ma = likelihood.fit_armas(ys, 2, 1)
    assert passes == [len(ys)] * likelihood.ROUNDS
    for k, (y, told) in enumerate(zip(ys, likelihood.forecasts(ys, ar, ma), strict=True)):
        one = likelihood.fit_arma(y, 2, 1)
        assert np.allclose(one[0], ar[k]) and np.allclose(one[1], ma[k])
        assert np.allclose(told, likelihood.innovations(y, ar[k : k + 1], ma[k : k + 1])[0][:, 0])
    for k, found in enumerate(zip(*likelihood.fit_garches(ys), strict=True)):
        assert np.allclose(found, likelihood.fit_garch(ys[k]))
