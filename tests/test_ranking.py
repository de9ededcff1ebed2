"""The ranking of detectors: gradients, the fall of the loss, and held-out ranks against a fixed choice."""

import numpy as np

from seriesmend.operators import tape
from seriesmend.operators.tape import Node
from seriesmend.plans import ranking

from .test_models import numeric_gradients


def test_gain_and_its_gradient():
    rng = np.random.default_rng(1)
    u, v, y = rng.standard_normal((5, 3)), rng.standard_normal((3, 4)), rng.random((5, 4))
    p = {"u": Node(u), "v": Node(v)}
    tape.backward(ranking.rank_gain(p["u"], p["v"], y, 2.0))
    plain = numeric_gradients(lambda w: float(ranking.rank_gain(Node(w["u"]), Node(w["v"]), y, 2.0).value), {"u": u, "v": v}, "uv")
    assert all(np.allclose(p[k].grad, plain[k], atol=1e-6) for k in "uv")
    # very steep, it is the gain of the order itself
    s = u @ v
    rank = (s[:, None] > s[:, :, None]).sum(2) + 1
    gain = 2.0**y - 1
    want = (gain / np.log2(1 + rank)).sum(1) / (-np.sort(-gain, axis=1) / np.log2(2 + np.arange(4))).sum(1)
    assert abs(float(ranking.rank_gain(Node(u), Node(v), y, 1e4).value) - want.sum()) < 1e-6


def test_ranks_held_out_sets_better_than_a_fixed_choice(spark):
    rng = np.random.default_rng(5)
    models = [f"m{k}" for k in range(8)]
    taste = rng.standard_normal((3, 8))

    def sets(n):
        hidden = rng.standard_normal((n, 3))
        x = np.hstack([hidden @ rng2, np.abs(hidden), rng.standard_normal((n, 2))])
        y = 1 / (1 + np.exp(-(hidden @ taste) - 0.1 * rng.standard_normal((n, 8))))
        return x, y

    rng2 = np.random.default_rng(6).standard_normal((3, 6))
    (x, y), (new_x, new_y) = sets(150), sets(60)
    table = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "features array<double>, scores array<double>").repartition(5)
    fitted = ranking.Ranking(models, rounds=15).fit(table)
    assert fitted.history[-1] > fitted.history[0] + 0.05
    new = spark.createDataFrame([(k, [*a.tolist()[:-1], None if k == 0 else float(a[-1])]) for k, a in enumerate(new_x)], "id long, features array<double>")
    got = {r.id: r.ranked for r in fitted.predict(new).collect()}
    assert len(got) == 60 and all(sorted(r) == models for r in got.values())
    rank = lambda i, m: int((new_y[i] > new_y[i, m]).sum())
    mine = np.mean([rank(i, int(got[i][0][1:])) for i in range(60)])
    fixed = min(np.mean([rank(i, m) for i in range(60)]) for m in range(8))
    assert mine < 0.6 * fixed
