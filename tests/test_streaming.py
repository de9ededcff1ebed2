"""Streams give what the same rows give as a table."""

import numpy as np

from seriesmend.operators.constrained import screen_column
from seriesmend.streaming import online


def test_screen_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.uniform(-1, 1, 200))
    y[[40, 90, 91]] += 15
    t0 = 1_700_000_000
    rows = [(1, t0 + i, float(v)) for i, v in enumerate(y)]
    spark.createDataFrame(rows, "sample_id long, s long, value double").selectExpr("sample_id", "timestamp_seconds(s) ts", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = online.screen_stream(stream, -2, 2, 5, lateness="1 second").writeStream.format("memory").queryName("screened").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([(2, t0 + 10_000, 0.0)], "sample_id long, s long, value double").selectExpr("sample_id", "timestamp_seconds(s) ts", "value").write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        spark.createDataFrame([(2, t0 + 20_000, 0.0)], "sample_id long, s long, value double").selectExpr("sample_id", "timestamp_seconds(s) ts", "value").write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        got = spark.sql("select * from screened where sample_id = 1 order by time").collect()
    finally:
        q.stop()
    want = screen_column(y, np.arange(200.0), -2, 2, 5)
    assert len(got) >= 190 and np.allclose([r.repaired for r in got], want[: len(got)])


def test_windows_and_sessions_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "user_id", "event_type", "value")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    for name, fn in (("rates", online.windowed_rates), ("sess", online.sessions)):
        q = fn(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert sorted(map(repr, spark.table(name).collect())) == sorted(map(repr, fn(events).collect()))
