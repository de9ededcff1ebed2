"""Kernels' shares against loops, and the choice of clusters."""

import numpy as np
from pyspark.sql import functions as F

from seriesmend.functions import rockets
from seriesmend.spec import SeriesSpec

TWO = SeriesSpec(("a", "b"))


def plain(x, kernel, dilation):
    w = [2 if k in kernel else -1 for k in range(9)]
    at = lambda i: x[i] if 0 <= i < len(x) else 0.0
    return [sum(w[k] * at(t + (k - 4) * dilation) for k in range(9)) for t in range(len(x))]


def test_shares_against_loops(spark):
    rng = np.random.default_rng(1)
    data = {1: rng.standard_normal((40, 2)), 2: rng.standard_normal((5, 2)), None: np.ones((9, 2))}
    rows = [(s, t, float(r[0]), float(r[1]) if (t + 1) % 7 else None) for s, x in data.items() for t, r in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id long, t long, a double, b double").repartition(5)
    biases = rockets.fit_biases(df, TWO, [1, 4])
    assert set(biases) == {("a", 1), ("a", 4), ("b", 1), ("b", 4)} and all(len(v) == 84 for v in biases.values())
    biases = {k: [x + 1e-6 for x in v] for k, v in biases.items()}  # a bias is a convolution of the series that it was fitted to
    got = {(r["sample"], r["col"], r["dilation"]): r["shares"] for r in rockets.shares(df, TWO, [1, 4], biases).collect()}
    assert len(got) == 12
    for (s, c, d), found in got.items():
        x = [(0.0 if c == "b" and (t + 1) % 7 == 0 else v) for t, v in enumerate(data[s][:, 0 if c == "a" else 1])]
        want = [np.mean([v > bias for v in plain(x, kernel, d)]) for kernel, bias in zip(rockets.KERNELS, biases[c, d], strict=True)]
        assert np.allclose(found, want)
    assert len(rockets.KERNELS) == 84 and rockets.shares(df.where("false"), TWO, [1]).count() == 0


def test_clusters_are_found(spark):
    rng = np.random.default_rng(3)
    kinds = [lambda t: np.sin(t / 2), lambda t: np.sign(np.sin(t / 7)), lambda t: (t % 11) / 5 - 1]
    rows = [(s, int(t), float(v)) for s in range(30) for t, v in enumerate(kinds[s % 3](np.arange(80) + rng.integers(20)) + 0.05 * rng.standard_normal(80))]
    df = spark.createDataFrame(rows, "sample_id long, t long, a double")
    one = SeriesSpec(("a",))
    k, score = rockets.auto_select_k(df, one, high=6)
    assert k == 3 and score > 0.7
    assert rockets.auto_select_k(df.where("sample_id < 5"), one) == (2, -100.0)
    assert rockets.rocket_points(df.where(F.col("sample_id") < 1), one).count() == 1


def test_all_dilations_share_one_window(spark):
    df = spark.createDataFrame([(1, t, float(t % 5)) for t in range(40)], "sample_id long, t long, a double")
    one = SeriesSpec(("a",))
    found = rockets.shares(df, one, [1, 2, 4])
    assert found.count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition") <= len({(k - 4) * d for d in (1, 2, 4) for k in range(9)}) and plan.count("Window ") == 1
    for d in (1, 2, 4):  # together as each alone
        alone = rockets.shares(df, one, [d]).first()["shares"]
        assert alone == found.where(f"dilation = {d}").first()["shares"]
