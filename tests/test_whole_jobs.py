"""Jobs over all that they are given: whole series, every candidate."""

import numpy as np

from seriesmend import registry_models
from seriesmend.operators import kernels, metrics
from seriesmend.plans import harness
from seriesmend.spec import SeriesSpec


def test_harness_scores_whole_series(spark):
    n = 20_600
    y = np.zeros(n, int)
    y[100:110] = y[20_300:20_340] = 1
    x = np.sin(np.arange(n) / 5) + 4.0 * (np.arange(n) >= 20_300) * y  # what is found comes after the 20,000th row
    df = spark.createDataFrame(list(zip([1] * n, range(n), x.tolist(), y.tolist(), strict=True)), "sample_id long, t long, col_1 double, label int")
    got = harness.score_table(df, SeriesSpec(), ["ZScore"]).collect()
    z = np.abs(x - x.mean()) / (x.std() + 1e-12)
    period = kernels.period(x[:, None])
    want = metrics.vus(y, (z - z.min()) / (z.max() - z.min()), period)[1]
    part = metrics.vus(y[:20_000], z[:20_000], period)[1]
    assert len(got) == 1 and np.isclose(got[0].ZScore, want, atol=0.01) and want > part + 0.1


def test_all_numbers_of_clusters_are_tried(spark, tmp_path):
    """Eight kinds of series: none of the numbers up to five is theirs."""
    rng = np.random.default_rng(5)
    rows = []
    for user in range(64):
        wave = np.sign(np.sin(np.arange(96) * np.pi / (user % 8 + 1) ** 1.3 + 0.3)) * 20 + 50 + 0.1 * rng.standard_normal(96)
        rows += [(user * 96 + t, t, user, float(v)) for t, v in enumerate(wave)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "'view' AS event_type", "value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = registry_models.QUERIES["auto_select_k"](spark, str(tmp_path)).first()
    assert found["k"] > 5 and found["score"] > 0.7
