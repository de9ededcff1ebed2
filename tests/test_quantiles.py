"""Percentiles of whole columns that no task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmend.functions import quantiles
from seriesmend.operators import constraints
from seriesmend.spec import SeriesSpec


@pytest.mark.parametrize("band", [quantiles.BAND, 1e-9, 0.5])
def test_quantiles_are_those_of_percentile(spark, band, monkeypatch):
    monkeypatch.setattr(quantiles, "BAND", band)
    rng = np.random.default_rng(1)
    n = 20_011
    columns = [rng.standard_normal(n), np.floor(rng.exponential(2, n)), np.full(n, 7.0), np.where(rng.random(n) < 0.3, np.nan, rng.random(n)), np.r_[5.0, [None] * (n - 1)], np.full(n, None)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in zip(*columns, strict=True)], ", ".join(f"c{k} double" for k in range(6))).repartition(5)
    levels = [0.0, 0.025, 1 / 3, 0.5, 2 / 3, 0.975, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, levels))).alias(c) for c in df.columns]).first()
    got = quantiles.quantiles(df, {c: F.col(c) for c in df.columns}, levels)
    for c in df.columns:
        assert np.array_equal(np.array(got[c], float), np.array(want[c] or [None] * len(levels), float), equal_nan=True), c


def test_mining_takes_no_column_through_one_task(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a = rng.uniform(1, 5, (3, 70))
    df = spark.createDataFrame([(s, t, t, float(v), float(2 * v + 0.01 * (t % 3)), float(-v)) for s in range(3) for t, v in enumerate(a[s])], "sample_id long, t long, timestamp long, col_1 double, col_2 double, col_3 double")
    spec = SeriesSpec(("col_1", "col_2", "col_3"))
    rows = constraints.differences(df, spec).unpivot([*spec.keys, "col"], ["speed", "accel", "variance"], "kind", "x").where("x is not null")
    want = {(r["col"], r["kind"]): (r["lower"], r["upper"]) for r in constraints.robust_bounds(rows, ["col", "kind"], "x").collect()}
    monkeypatch.setattr(F, "percentile", None)
    found = constraints.mine_all(df, spec)
    got = {(c, kind): v for kind in ("speed", "accel", "variance") for c, v in getattr(found, kind).items()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-12) for k in want)
    assert found.order and found.row
