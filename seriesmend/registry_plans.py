"""Queries of the benchmark harness, the selector, the policy, distances, files and streams, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmend.operators import constraints, detect, distances, metrics, missing
from seriesmend.plans import harness, policy, selection
from seriesmend.registry import EV, EV_RULES, LAB, RULES, SM, VIOL, ev, lab, r6
from seriesmend.runtime import prepare, scratch, written
from seriesmend.sources import series
from seriesmend.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir, fn=fn: fn(prepare(spark), sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# ---- harness -------------------------------------------------------------------------------------------------------


@query("harness_bounded", f"""
    WITH {EV}, {LAB}, f AS (SELECT *, first_value(label) OVER (PARTITION BY sample_id ORDER BY t) AS f FROM lab),
    o AS (SELECT sample_id, min(t) FILTER (label <> f) AS o FROM f GROUP BY 1)
    SELECT sample_id, t, label FROM lab JOIN o USING (sample_id) WHERE o IS NOT NULL AND t < 8 + ceil(greatest(o + 1 - 8, 0) / 5) * 5""")
def _(spark, sf):
    return harness.bounded(*lab(spark, sf), most=8, step=5).select("sample_id", "t", "label")


@query("harness_scores")
def _(spark, sf):
    d, s = lab(spark, sf)
    rows = d.withColumn("col_1", F.col("score")).select("sample_id", "t", "timestamp", "col_1", "label")
    return harness.score_table(rows, s, ["ZScore", "MAD", "EWMA", "IForest"])


@query("prediction_metrics")
def _(spark, sf):
    return metrics.prediction_metrics(*lab(spark, sf), window=20)


@query("label_metrics", f"""
    WITH {EV}, j AS (SELECT sample_id, t, clean_1 AS c, CASE WHEN t % 5 = 0 THEN clean_1 + 30 ELSE clean_1 END AS d, CASE WHEN t % 10 = 0 THEN clean_1 + 1 WHEN t % 5 = 0 THEN clean_1 + 30 WHEN t % 7 = 0 THEN clean_1 - 2 ELSE clean_1 END AS r, t % 5 = 0 AS e FROM ev),
    g AS (SELECT r, c, abs(d - r) > 1e-6 AS moved, e, abs((r - min(r) OVER w) / coalesce(nullif(max(r) OVER w - min(r) OVER w, 0), 1) - (c - min(c) OVER w) / coalesce(nullif(max(c) OVER w - min(c) OVER w, 0), 1)) AS gap FROM j WINDOW w AS (PARTITION BY sample_id)),
    m AS (SELECT sqrt(avg((r - c) ^ 2)) AS rmse, avg(gap) AS mnad, count(*) FILTER (moved AND e) AS tp, count(*) FILTER (moved) AS pp, count(*) FILTER (e) AS p FROM g)
    SELECT round(rmse, 6) + 0.0 AS rmse, round(mnad, 6) + 0.0 AS mnad, round(tp / p, 6) + 0.0 AS rra, round(tp / pp, 6) + 0.0 AS precision, round(tp / p, 6) + 0.0 AS recall, round(2 * tp / (pp + p), 6) + 0.0 AS f1 FROM m""")
def _(spark, sf):
    d, s = ev(spark, sf)
    c, t = F.col("clean_1"), F.col("t")
    of = lambda value: d.select("sample_id", "t", value.alias("col_1"))
    fixed = F.when(t % 10 == 0, c + 1).when(t % 5 == 0, c + 30).when(t % 7 == 0, c - 2).otherwise(c)
    m = metrics.label_metrics(of(fixed), of(c), of(F.when(t % 5 == 0, c + 30).otherwise(c)), of((t % 5 == 0).cast("double")), s)
    return r6(m, *m.columns)


# ---- distances -----------------------------------------------------------------------------------------------------


def _halves(spark, sf) -> DataFrame:
    """The first and the second half of each user's series; the middle value of an odd number stays out."""
    d, _ = ev(spark, sf, 0)
    rows = d.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "col_1"))), lambda r: r["col_1"]).alias("v"))
    n = F.floor(F.size("v") / 2).cast("int")
    return rows.where(n > 0).select("sample_id", F.slice("v", F.lit(1), n).alias("x"), F.slice("v", F.size("v") - n + 1, n).alias("y"))


@query("distance_norms", f"""
    WITH {EV}, n AS (SELECT sample_id, count(*) AS n, count(*) // 2 AS m FROM ev GROUP BY 1),
    p AS (SELECT a.sample_id, m, a.clean_1 - b.clean_1 AS d FROM ev a JOIN n USING (sample_id) JOIN ev b ON a.sample_id = b.sample_id AND b.t = a.t + n - m WHERE a.t < m)
    SELECT sample_id, round(sum(abs(d)) / m + 1e-8, 6) + 0.0 AS euclidean, round(sum(d * d) / m + 1e-8, 6) + 0.0 AS mahalanobis, round(sqrt(m * sum(d * d)) / m + 1e-8, 6) + 0.0 AS fourier
    FROM p GROUP BY 1, m""")
def _(spark, sf):
    # the spectrum's norm is that of the difference, times the root of the length; a hair more sends what is half-way between two sixth decimals up in both dialects
    measures = {"euclidean": distances.euclidean, "mahalanobis": distances.mahalanobis, "fourier": distances.fourier}
    found = distances.between(_halves(spark, sf), "x", "y", measures).drop("x", "y")
    return r6(found.withColumns({m: F.col(m) + 1e-8 for m in measures}), *measures)


@query("distance_warped")
def _(spark, sf):
    measures = {"ssa": distances.ssa, "dtw": distances.dtw, "edr": partial(distances.edr, reach=10.0), "twed": distances.twed}
    return r6(distances.between(_halves(spark, sf), "x", "y", measures).drop("x", "y"), *measures)


# ---- time and order ------------------------------------------------------------------------------------------------


@query("impute_time", f"""
    WITH {EV}, h AS (SELECT sample_id, t, CASE WHEN (t * 7 + sample_id) % 3 = 0 THEN CAST(timestamp AS DOUBLE) END AS v FROM ev),
    n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, first_value(v IGNORE NULLS) OVER f AS z, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tz
        FROM h WINDOW b AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT sample_id, t, round(coalesce(v, a + (z - a) * (t - ta) / nullif(tz - ta, 0), a, z, 0), 3) + 0.0 AS timestamp FROM n""")
def _(spark, sf):
    d, s = ev(spark, sf)
    d = d.withColumn("timestamp", F.when((F.col("t") * 7 + F.col("sample_id")) % 3 == 0, F.col("timestamp")))
    return missing.impute_time(d, s).select("sample_id", "t", (F.round("timestamp", 3) + 0.0).alias("timestamp"))


@query("step_violations", f"""
    WITH {SM}, d AS (SELECT sample_id, t, col_1, col_2 - lag(col_2) OVER (PARTITION BY sample_id ORDER BY col_1, t) AS step FROM sm),
    v AS (SELECT *, CASE WHEN step < -20000 THEN -20000 - step WHEN step > 50000 THEN step - 50000 END AS degree FROM d WHERE col_1 BETWEEN 0 AND 150 OR col_1 BETWEEN 200 AND 400)
    SELECT sample_id, t, round(step, 4) + 0.0 AS step, round(degree, 4) + 0.0 AS degree FROM v WHERE degree IS NOT NULL""")
def _(spark, sf):
    v = constraints.step_violations(*series.supplier_months(spark, sf), "col_1", "col_2", [(0, 150), (200, 400)], (-20000.0, 50000.0))
    return v.select("sample_id", "t", (F.round("step", 4) + 0.0).alias("step"), (F.round("degree", 4) + 0.0).alias("degree"))


@query("order_correlation", f"""
    WITH {SM}, r AS (SELECT sample_id, t, rank() OVER (PARTITION BY sample_id ORDER BY col_1) + (count(*) OVER (PARTITION BY sample_id, col_1) - 1) / 2 AS rx, rank() OVER (PARTITION BY sample_id ORDER BY col_2) + (count(*) OVER (PARTITION BY sample_id, col_2) - 1) / 2 AS ry FROM sm),
    s AS (SELECT sample_id, corr(rx, ry) AS spearman FROM r GROUP BY 1), p AS (SELECT a.sample_id, sign(b.col_1 - a.col_1) AS x, sign(b.col_2 - a.col_2) AS y FROM sm a JOIN sm b ON a.sample_id = b.sample_id AND b.t > a.t),
    k AS (SELECT sample_id, sum(x * y) / nullif(sqrt(sum(abs(x)) * sum(abs(y))), 0) AS kendall FROM p GROUP BY 1)
    SELECT sample_id, round(spearman, 6) + 0.0 AS spearman, round(kendall, 6) + 0.0 AS kendall FROM s LEFT JOIN k USING (sample_id)""")
def _(spark, sf):
    return r6(constraints.order_correlation(*series.supplier_months(spark, sf), "col_1", "col_2"), "spearman", "kendall")


for _method, _value, _rule in (
    ("fixed", 60.0, "coalesce(score >= 60, FALSE)"), ("percentile", 90.0, "score >= quantile_cont(score, 0.9) OVER (PARTITION BY sample_id)"),
    ("topk", 5, "score >= min(CASE WHEN r <= 5 THEN score END) OVER (PARTITION BY sample_id)"),
):
    @query(f"threshold_{_method}", f"""
        WITH {EV}, {LAB}, k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, t) AS r FROM lab)
        SELECT sample_id, t, CAST({_rule} AS INTEGER) AS pred FROM k""")
    def _(spark, sf, method=_method, value=_value):
        return metrics.threshold(*lab(spark, sf), method, value=value).select("sample_id", "t", "pred")


@query("rates_by_constraint", f"""
    {VIOL}, n AS (SELECT sample_id, count(*) AS n FROM sm GROUP BY 1), b AS (SELECT sample_id, kind, count(DISTINCT t) AS bad FROM vio GROUP BY 1, 2)
    SELECT sample_id, CASE kind WHEN 'accel' THEN 'acceleration' ELSE kind END || '_constraints' AS "constraint", round(bad / n, 6) + 0.0 AS rate FROM b JOIN n USING (sample_id)""")
def _(spark, sf):
    d, s = series.supplier_months(spark, sf)
    rates = constraints.violation_rates(d, s, constraints.violations(d, s, RULES))
    return r6(constraints.named_rates(rates, s), "rate")


# ---- selection and policy ------------------------------------------------------------------------------------------


@query("select_detectors")
def _(spark, sf):
    """A selector trained on the suppliers' series, cut by supplier, for the whole set. They are made once: some forty passes read them."""
    d, s = series.supplier_months(spark, sf)
    d = written(d, "months")
    names = ["ZScore", "MAD", "MovingAverage", "Mahalanobis"]
    parts = [d.where(F.col("sample_id") % 4 == k) for k in range(4)]
    x = np.stack([selection.meta_features(p, s) for p in parts])
    scores = [[detect.outlier_rates(detect.flag(detect.DETECTORS[n](p, s), s), s).agg(F.avg("outlier_rate")).first()[0] or 0.0 for n in names] for p in parts]
    model = selection.FactorizationMachine(names).fit(x, np.array(scores), epochs=50)
    chosen = selection.select_detectors(d, s, model, 3)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(chosen)], "place int, model string")


def _environment(spark, sf) -> policy.Environment:
    d, s = ev(spark, sf)
    return policy.Environment(d.select("sample_id", "t", "timestamp", "col_1"), s, EV_RULES, most_steps=2)


ACTIONS = {"MISSING": ["interpolation", "moving_average", "kalman_filter"], "OUTLIER": ["smurf", "moving_average", "imr"], "CONSTRAINT": ["screen", "speed_local", "speedacc"]}


@query("policy_train")
def _(spark, sf):
    return policy.train(_environment(spark, sf), episodes=2, actions=ACTIONS).best.select("sample_id", "t", "col_1")


@query("policy_apply")
def _(spark, sf):
    """Agents that an episode has taught, by way of a file, on the same series."""
    path = scratch(spark, "agents")
    env = _environment(spark, sf)
    series.save_agents(spark, policy.train(env, episodes=1, actions=ACTIONS).agents(), path)
    return policy.apply_agents(env, series.load_agents(spark, path), ACTIONS).select("sample_id", "t", "col_1")


@query("cluster_choice")
def _(spark, sf):
    d, s = series.supplier_months(spark, sf)
    rows = policy.cluster_scores(policy.shape_features(d, s), 4)
    return spark.createDataFrame([tuple(r) for r in rows], "k int, calinski_harabasz double, silhouette double, davies_bouldin double")


# ---- files and streams ---------------------------------------------------------------------------------------------


@query("csv_round_trip", """
    WITH d AS (SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS timestamp, CAST(sum(TRY_CAST(o_totalprice AS DECIMAL(18, 4))) AS DOUBLE) AS col_1, CAST(count(*) AS DOUBLE) AS col_2 FROM orders GROUP BY 1)
    SELECT CAST(0 AS BIGINT) AS sample_id, row_number() OVER (ORDER BY timestamp) - 1 AS t, timestamp, round(col_1, 4) + 0.0 AS col_1, col_2 FROM d""")
def _(spark, sf):
    d, s = series.order_days(spark, sf)
    path = scratch(spark, "days")
    series.write_series(d.repartition(4, "t").select("timestamp", "col_1", "col_2"), path, "csv", header=True)
    back, _ = series.read_series_csv(spark, path, by_time=True)
    return back.select("sample_id", "t", "timestamp", (F.round("col_1", 4) + 0.0).alias("col_1"), "col_2")




@query("stream_screen")
def _(spark, sf):
    """All events as a stream of files, one for each range of time, repaired as they come; what the last watermark holds back isn't there."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("sample_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    source, out, state = scratch(spark, "stream-in"), scratch(spark, "stream-out"), scratch(spark, "stream-state")
    rows.repartitionByRange("ts").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    repaired = online.screen_stream(stream, -0.01, 0.01, 5)
    repaired.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return r6(spark.read.schema(repaired.schema).parquet(out), "value", "repaired")
