"""Tail thresholds: rates of false alarms on planted laws, and the stream's state against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmend.operators import thresholds
from seriesmend.spec import SeriesSpec

ONE = SeriesSpec(("score",))


@pytest.mark.parametrize("fit", ["weighted", "moments"])
def test_false_alarms_are_as_chosen(spark, fit):
    rng = np.random.default_rng(11)
    laws = {"exponential": rng.exponential(2, 60_000), "normal": rng.standard_normal(60_000), "uniform": rng.random(60_000), "heavy": rng.pareto(6, 60_000)}
    df = spark.createDataFrame([(s, t, float(v)) for s, x in laws.items() for t, v in enumerate(x)], "sample_id string, t long, score double").repartition(8)
    alarms = thresholds.flag_tail(df, ONE, risk=2e-3, level=0.96, fit=fit).groupBy("sample_id").agg(F.avg(F.col("is_outlier").cast("double")).alias("rate"))
    rates = {r.sample_id: r.rate for r in alarms.collect()}
    assert len(rates) == 4 and all(abs(r - 2e-3) <= 0.2 * 2e-3 for r in rates.values()), rates


def test_limits_by_hand(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(1, 500)
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)] + [("b", t, 1.0) for t in range(9)] + [("c", 0, None), ("c", 1, float("nan"))] + [(None, t, float(t)) for t in range(20)], "sample_id string, t long, score double")
    got = {r.sample_id: r for r in thresholds.tail_limits(df.repartition(5), ONE, risk=1e-3, level=0.9).collect()}
    assert set(got) == {"a", "b", None} and got["b"].limit == 1.0 and got[None].limit == 19.0 and got["b"].shape is None
    start = np.quantile(x, 0.9)
    y = np.sort(x[x > start] - start)
    a, z = y.mean(), ((1 - (np.arange(1, len(y) + 1) - 0.35) / len(y)) * y).mean()
    shape, scale = 2 - a / (a - 2 * z), 2 * a * z / (a - 2 * z)
    assert math.isclose(got["a"].shape, shape) and math.isclose(got["a"].scale, scale)
    assert math.isclose(got["a"].limit, start + scale / shape * ((1e-3 * 500 / len(y)) ** -shape - 1))
    assert thresholds.flag_tail(df, ONE).count() == df.count() and thresholds.flag_tail(df.where("false"), ONE).count() == 0
    with pytest.raises(ValueError, match="no such fit"):
        thresholds.tail_limits(df, ONE, fit="x")


def test_stream_keeps_the_limit(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.exponential(1, 3000)
    x[[1500, 2200]] = 60.0
    rows = [("a", 1_700_000_000 + t, float(v)) for t, v in enumerate(x)] + [("b", 1_700_000_000 + t, 1.0) for t in range(30)]
    df = spark.createDataFrame(rows, "sample_id string, at long, score double").select("sample_id", F.timestamp_seconds("at").alias("ts"), "score")
    for k in range(3):
        part = df.where((F.col("ts").cast("long") - 1_700_000_000).between(1000 * k, 1000 * k + 999))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = thresholds.tail_stream(stream, risk=1e-3, level=0.95, first=500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.time, r.score, r.limit, r.is_outlier) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) == 3000
    start = float(np.quantile(x[:500], 0.95))
    high = x[:500][x[:500] > start] - start
    n, peaks, total, squares = 500, len(high), high.sum(), (high**2).sum()
    for t in range(500, 3000):
        limit = thresholds.law_limit(start, n, peaks, total, squares, 1e-3)
        assert math.isclose(got[t][2], limit, rel_tol=1e-9) and got[t][3] == (x[t] > limit)
        if x[t] <= limit:
            n += 1
            if x[t] > start:
                peaks, total, squares = peaks + 1, total + x[t] - start, squares + (x[t] - start) ** 2
    flagged = [t for t in range(3000) if got[t][3]]
    assert {1500, 2200} <= set(flagged) and len(flagged) < 20
