"""All registered queries of the time-series side, and what they are in SQL.

Series that the star schema lacks errors for get them in the query, by the same deterministic rules in both dialects: a value is missing for event ids divisible by 7, a label is 1 for ids divisible by 11.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmend import oracles
from seriesmend.functions import scaling
from seriesmend.operators import constrained, constraints, detect, inject, metrics, missing, repair
from seriesmend.plans import selection
from seriesmend.runtime import prepare, written
from seriesmend.sources import series
from seriesmend.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EV = """ev AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp,
 CASE WHEN event_id % 7 <> 0 THEN value END AS col_1, value AS clean_1 FROM events)"""
LAB = """lab AS (SELECT sample_id, t, timestamp, clean_1 AS score, CAST(timestamp % 11 = 0 AS INTEGER) AS label, CAST(clean_1 > 60 AS INTEGER) AS pred FROM ev)"""
SM = """g AS (SELECT l_suppkey AS sample_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS timestamp, CAST(sum(TRY_CAST(l_quantity AS DECIMAL(18, 4))) AS DOUBLE) AS col_1,
 CAST(sum(TRY_CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) AS col_2, CAST(sum(TRY_CAST(l_discount AS DECIMAL(18, 4))) AS DOUBLE) / nullif(count(TRY_CAST(l_discount AS DECIMAL(18, 4))), 0) AS col_3 FROM lineitem GROUP BY 1, 2),
 sm AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY timestamp) - 1 AS t, timestamp, col_1, col_2, col_3 FROM g)"""
LINEAR = """nb AS (SELECT *, last_value(col_1 IGNORE NULLS) OVER b AS a, last_value(CASE WHEN col_1 IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, first_value(col_1 IGNORE NULLS) OVER f AS z, first_value(CASE WHEN col_1 IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tz
 FROM ev WINDOW b AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 lin AS (SELECT sample_id, t, timestamp, coalesce(col_1, a + (z - a) * (t - ta) / nullif(tz - ta, 0), a, z, 0.0) AS x FROM nb)"""
Three = ("col_1", "col_2", "col_3")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir, fn=fn: fn(prepare(spark), sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def ev(spark, sf, every=7):
    return series.user_events(spark, sf, every)


def lab(spark, sf):
    d, s = ev(spark, sf)
    return d.select("sample_id", "t", "timestamp", F.col("clean_1").alias("score"), (F.col("timestamp") % 11 == 0).cast("int").alias("label"), (F.col("clean_1") > 60).cast("int").alias("pred")), s


def r6(df, *cols):
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in cols})


def R(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 AS {alias or c}"


# ---- end to end and missing values ---------------------------------------------------------------------------------


@query("flagship_user_issue_rates", f"""WITH {EV}, {LINEAR}, sc AS (SELECT sample_id, t, abs((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-8)) AS score FROM lin WINDOW w AS (PARTITION BY sample_id)),
 fl AS (SELECT sample_id, CAST(score > avg(score) OVER w + 3 * stddev_pop(score) OVER w AS DOUBLE) AS o FROM sc WINDOW w AS (PARTITION BY sample_id)),
 m AS (SELECT sample_id, avg(CASE WHEN col_1 IS NULL THEN 0.5 ELSE 0 END) AS missing_rate FROM ev GROUP BY 1), o AS (SELECT sample_id, avg(o) AS outlier_rate FROM fl GROUP BY 1)
 SELECT sample_id, {R('missing_rate')}, {R('outlier_rate')} FROM m JOIN o USING (sample_id)""")
def _(spark, sf):
    d, s = ev(spark, sf)
    d = d.drop("clean_1")
    out = detect.outlier_rates(detect.flag(detect.zscore(missing.impute_linear(d, s), s), s), s)
    return r6(missing.missing_rates(d, s).select("sample_id", "missing_rate").join(out, "sample_id"), "missing_rate", "outlier_rate")


@query("missing_rates", f"WITH {EV} SELECT sample_id, count(*) > count(col_1) AS any_missing, {R('(count(*) - count(col_1)) / (2.0 * count(*))', 'missing_rate')} FROM ev GROUP BY 1")
def _(spark, sf):
    d, s = ev(spark, sf)
    return r6(missing.missing_rates(d.drop("clean_1"), s), "missing_rate")


DUP = """od AS (SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, CAST(sum(TRY_CAST(o_totalprice AS DECIMAL(18, 4))) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS c FROM orders GROUP BY 1),
 os AS (SELECT row_number() OVER (ORDER BY day) - 1 AS t, day, p, c FROM od),
 dd AS (SELECT t, CASE WHEN t % 20 < 3 + (t // 20) % 9 THEN t - t % 20 ELSE 100000 + t END AS timestamp, CASE WHEN t % 20 < 3 + (t // 20) % 9 THEN CAST(t // 20 AS DOUBLE) ELSE p END AS col_1, CASE WHEN t % 20 < 3 + (t // 20) % 9 THEN 1.0 ELSE c END AS col_2 FROM os)"""


@query("duplicate_runs", f"""WITH {DUP}, e AS (SELECT *, coalesce(timestamp = lag(timestamp) OVER w AND col_1 = lag(col_1) OVER w AND col_2 = lag(col_2) OVER w, FALSE) AS eq FROM dd WINDOW w AS (ORDER BY t)),
 i AS (SELECT *, t - row_number() OVER (PARTITION BY eq ORDER BY t) AS island FROM e) SELECT CAST(1 AS BIGINT) AS sample_id, t, eq AND count(*) OVER (PARTITION BY eq, island) + 1 >= 8 AS is_duplicate FROM i""")
def _(spark, sf):
    d, s = series.order_days(spark, sf)
    run = F.col("t") % 20 < 3 + F.floor(F.col("t") / 20) % 9
    d = d.withColumns({"timestamp": F.when(run, F.col("t") - F.col("t") % 20).otherwise(100000 + F.col("t")), "col_1": F.when(run, F.floor(F.col("t") / 20).cast("double")).otherwise(F.col("col_1")), "col_2": F.when(run, 1.0).otherwise(F.col("col_2"))})
    return missing.duplicate_runs(d, s).select("sample_id", "t", "is_duplicate")


@query("rebuild_time", f"""WITH {EV}, h AS (SELECT sample_id, t, CASE WHEN (t * 7 + sample_id) % 3 = 0 THEN timestamp END AS v FROM ev), d AS (SELECT *, v - lag(v) OVER (PARTITION BY sample_id ORDER BY t) AS d1 FROM h),
 p AS (SELECT sample_id, min(CASE WHEN v IS NOT NULL THEN t END) AS t0, max(CASE WHEN v IS NOT NULL THEN t END) AS t1, arg_min(v, t) FILTER (v IS NOT NULL) AS v0, arg_max(v, t) FILTER (v IS NOT NULL) AS v1, arg_min(d1, t) FILTER (d1 IS NOT NULL) AS dd FROM d GROUP BY 1)
 SELECT sample_id, t, CAST(round_even(v0 + (t - t0) * coalesce(CAST(dd AS DOUBLE), (v1 - v0) / nullif(CAST(t1 - t0 AS DOUBLE), 0), 0.0), 0) AS BIGINT) AS timestamp FROM h JOIN p USING (sample_id)""")
def _(spark, sf):
    d, s = ev(spark, sf)
    d = d.withColumn("timestamp", F.when((F.col("t") * 7 + F.col("sample_id")) % 3 == 0, F.col("timestamp")))
    return missing.rebuild_time(d, s).select("sample_id", "t", "timestamp")


@query("impute_linear", f"WITH {EV}, {LINEAR} SELECT sample_id, t, {R('x', 'col_1')} FROM lin")
def _(spark, sf):
    d, s = ev(spark, sf)
    return r6(missing.impute_linear(d, s).select("sample_id", "t", "col_1"), "col_1")


@query("impute_rolling_mean", f"WITH {EV} SELECT sample_id, t, round(coalesce(col_1, avg(col_1) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), 6) + 0.0 AS col_1 FROM ev")
def _(spark, sf):
    d, s = ev(spark, sf)
    return r6(missing.impute_rolling_mean(d, s).select("sample_id", "t", "col_1"), "col_1")


@query("impute_mean", f"WITH {EV} SELECT sample_id, t, round(coalesce(col_1, avg(col_1) OVER (PARTITION BY sample_id)), 6) + 0.0 AS col_1 FROM ev")
def _(spark, sf):
    d, s = ev(spark, sf)
    return r6(missing.impute_mean(d, s).select("sample_id", "t", "col_1"), "col_1")


@query("repair_missing_interpolation", f"""WITH {EV}, {LINEAR}, v AS (SELECT sample_id, t, col_1, row_number() OVER (PARTITION BY sample_id ORDER BY t) AS k, row_number() OVER (PARTITION BY sample_id ORDER BY t DESC) AS e FROM ev WHERE col_1 IS NOT NULL),
 p AS (SELECT sample_id, min(col_1) AS lo, max(col_1) AS hi, max(CASE WHEN k = 1 THEN t END) AS t1, max(CASE WHEN k = 1 THEN col_1 END) AS x1, max(CASE WHEN k = 2 THEN t END) AS t2, max(CASE WHEN k = 2 THEN col_1 END) AS x2,
  max(CASE WHEN e = 1 THEN t END) AS u1, max(CASE WHEN e = 1 THEN col_1 END) AS y1, max(CASE WHEN e = 2 THEN t END) AS u2, max(CASE WHEN e = 2 THEN col_1 END) AS y2 FROM v GROUP BY 1)
 SELECT sample_id, t, round(coalesce(nb.col_1, a + (z - a) * (t - ta) / nullif(tz - ta, 0), CASE WHEN a IS NULL AND x2 IS NOT NULL THEN greatest(lo, least(hi, x1 + (x2 - x1) * (t - t1) / (t2 - t1))) END,
  CASE WHEN z IS NULL AND y2 IS NOT NULL THEN greatest(lo, least(hi, y1 + (y2 - y1) * (t - u1) / (u2 - u1))) END, a, z, (SELECT avg(col_1) FROM ev), 0.0), 6) + 0.0 AS col_1 FROM nb LEFT JOIN p USING (sample_id)""")
def _(spark, sf):
    d, s = ev(spark, sf)
    return r6(repair.impute_interpolation(d, s).select("sample_id", "t", "col_1"), "col_1")


# ---- scaling and order statistics ----------------------------------------------------------------------------------

_COLS = lambda e: ", ".join(f"round({e.format(c=c)}, 6) + 0.0 AS {c}" for c in Three)


def _sm(op, *cols):
    def run(spark, sf):
        d, s = series.supplier_months(spark, sf)
        return r6(op(d, s).select("sample_id", "t", *(cols or Three)), *(cols or Three))

    return run


def _window(name: str, expr: str, op) -> None:
    query(name, f"WITH {SM} SELECT sample_id, t, {_COLS(expr)} FROM sm WINDOW w AS (PARTITION BY sample_id)")(_sm(op))


_window("adjust_scale", "({c} - min({c}) OVER w) * coalesce(10.0 / nullif(avg({c}) OVER w - min({c}) OVER w, 0), 1)", scaling.adjust_scale)
_window("restore_scale", "{c}", lambda d, s: scaling.restore_scale(scaling.adjust_scale(d, s), d, s))
_window("normalize", "({c} - min({c}) OVER w) / coalesce(nullif(max({c}) OVER w - min({c}) OVER w, 0), 1)", scaling.minmax)
_window("standardizer", "({c} - avg({c}) OVER w) / coalesce(nullif(stddev_pop({c}) OVER w, 0), 1)", scaling.standardise)
query("zscore_rows", f"WITH {SM}, m AS (SELECT *, (col_1 + col_2 + col_3) / 3 AS mean FROM sm), d AS (SELECT *, sqrt(((col_1 - mean) ^ 2 + (col_2 - mean) ^ 2 + (col_3 - mean) ^ 2) / 2) AS dev FROM m) SELECT sample_id, t, {_COLS('CASE WHEN dev > 0 THEN ({c} - mean) / dev END')} FROM d")(_sm(scaling.zscore_rows))


@query("column_bounds", f"""WITH {SM}, u AS (UNPIVOT sm ON col_1, col_2, col_3 INTO NAME col VALUE x) SELECT sample_id, col, {R('min(x)', 'lo')}, {R('max(x)', 'hi')}, {R('avg(x)', 'mean')} FROM u GROUP BY 1, 2""")
def _(spark, sf):
    return r6(scaling.column_bounds(*series.supplier_months(spark, sf)), "lo", "hi", "mean")


query("column_ecdf", f"WITH {SM} SELECT sample_id, t, " + ", ".join(f"round(cume_dist() OVER (PARTITION BY sample_id ORDER BY {c}), 6) + 0.0 AS ecdf_{c}" for c in Three) + " FROM sm")(_sm(scaling.ecdf, *[f"ecdf_{c}" for c in Three]))


@query("weighted_pearson", f"""WITH {SM}, s AS (SELECT sample_id, sum(col_3) AS s, sum(col_3 * col_1) AS sx, sum(col_3 * col_2) AS sy, sum(col_3 * col_1 * col_1) AS sxx, sum(col_3 * col_2 * col_2) AS syy, sum(col_3 * col_1 * col_2) AS sxy FROM sm GROUP BY 1)
 SELECT sample_id, round((sxy / s - sx / s * sy / s) / sqrt((sxx / s - sx / s * sx / s) * (syy / s - sy / s * sy / s)), 6) + 0.0 AS wpearson FROM s""")
def _(spark, sf):
    return r6(scaling.weighted_pearson(*series.supplier_months(spark, sf), "col_1", "col_2", "col_3"), "wpearson")


query("pairwise_distance", f"WITH {SM} SELECT sample_id, t, {R('sqrt((col_1 - col_2) ^ 2 + (col_2 - col_3) ^ 2)', 'distance')} FROM sm")(_sm(lambda d, s: scaling.row_distance(d, ["col_1", "col_2"], ["col_2", "col_3"]), "distance"))


@query("score_to_label", f"WITH {EV} SELECT sample_id, t, CAST(clean_1 > quantile_cont(clean_1, 0.9) OVER (PARTITION BY sample_id) AS INTEGER) AS label FROM ev")
def _(spark, sf):
    return scaling.score_to_label(*ev(spark, sf), "clean_1").select("sample_id", "t", "label")


@query("argmaxn", f"WITH {EV}, r AS (SELECT sample_id, t, clean_1, row_number() OVER (PARTITION BY sample_id ORDER BY clean_1 DESC, t) AS rank FROM ev) SELECT sample_id, t, {R('clean_1')}, rank FROM r WHERE rank <= 5")
def _(spark, sf):
    return r6(scaling.top_n(*ev(spark, sf), "clean_1", 5), "clean_1")


@query("precision_n_scores", f"""WITH {EV}, {LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, t) AS r, sum(label) OVER (PARTITION BY sample_id) AS k FROM lab), c AS (SELECT *, min(CASE WHEN r <= k THEN score END) OVER (PARTITION BY sample_id) AS c FROM r)
 SELECT sample_id, round(count(*) FILTER (score >= c AND label = 1) / nullif(count(*) FILTER (score >= c), 0), 6) + 0.0 AS precision_at_n FROM c GROUP BY 1""")
def _(spark, sf):
    return r6(scaling.precision_at_n(*lab(spark, sf), "score", "label"), "precision_at_n")


@query("load_rate", f"WITH {EV} SELECT sample_id, t FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM ev) WHERE t < greatest(1, floor(n * 0.3))")
def _(spark, sf):
    return series.head_rate(*ev(spark, sf), 0.3).select("sample_id", "t")


@query("densest_subset", f"""WITH {EV}, {LAB}, k AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, sum(label) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS c FROM lab),
 b AS (SELECT sample_id, arg_min(t, -c * 1000000 + t) AS s FROM k WHERE t <= greatest(n - 20, 0) GROUP BY 1) SELECT sample_id, t, label FROM lab JOIN b USING (sample_id) WHERE t >= s AND t < s + 20""")
def _(spark, sf):
    return series.densest_subset(*lab(spark, sf), "label", 20).select("sample_id", "t", "label")


@query("rank_models", "WITH s AS (SELECT l_suppkey AS \"Dataset\", CAST(avg(l_quantity) AS DOUBLE) AS a, CAST(avg(l_discount) AS DOUBLE) AS b, CAST(avg(l_tax) AS DOUBLE) AS c FROM lineitem GROUP BY 1), u AS (UNPIVOT s ON a, b, c INTO NAME model VALUE score), m AS (SELECT model, avg(score) AS mean_score FROM u GROUP BY 1) SELECT model, round(mean_score, 6) + 0.0 AS mean_score, row_number() OVER (ORDER BY mean_score DESC, model) AS rank FROM m")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("Dataset")).agg(F.avg("l_quantity").cast("double").alias("a"), F.avg("l_discount").cast("double").alias("b"), F.avg("l_tax").cast("double").alias("c"))
    return r6(series.rank_models(t), "mean_score")


# ---- detectors -----------------------------------------------------------------------------------------------------

_MOST = lambda e: f"round(greatest({', '.join(e.format(c=c) for c in Three)}), 6) + 0.0 AS score"


def _score(name: str, sql: str) -> None:
    query(f"detect_{name.lower()}", sql)(_sm(detect.DETECTORS[name], "score"))


_score("ZScore", f"WITH {SM} SELECT sample_id, t, {_MOST('abs(({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-8))')} FROM sm WINDOW w AS (PARTITION BY sample_id)")
_score("MAD", f"WITH {SM}, d AS (SELECT sample_id, t, " + ", ".join(f"abs({c} - quantile_cont({c}, 0.5) OVER w) AS {c}" for c in Three) + f" FROM sm WINDOW w AS (PARTITION BY sample_id)) SELECT sample_id, t, {_MOST('{c} / (quantile_cont({c}, 0.5) OVER w + 1e-8)')} FROM d WINDOW w AS (PARTITION BY sample_id)")
_score("IQR", f"WITH {SM}, q AS (SELECT sample_id, t, " + ", ".join(f"{c}, quantile_cont({c}, 0.25) OVER w AS a_{c}, quantile_cont({c}, 0.75) OVER w AS b_{c}" for c in Three) + f" FROM sm WINDOW w AS (PARTITION BY sample_id)) SELECT sample_id, t, {_MOST('CAST({c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}) AS DOUBLE)')} FROM q")
_FRAME = "WINDOW w AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_score("MovingAverage", f"WITH {SM} SELECT sample_id, t, {_MOST('abs({c} - avg({c}) OVER w)')} FROM sm {_FRAME}")
_score("RollingMedian", f"WITH {SM} SELECT sample_id, t, {_MOST('abs({c} - quantile_cont({c}, 0.5) OVER w)')} FROM sm {_FRAME}")


def _recursive(name: str, sql: str) -> None:
    """Weights of one digit and amounts in cents have values half-way between two sixth decimals; a hair more sends them up in both dialects."""

    def run(spark, sf):
        d, s = series.supplier_months(spark, sf)
        return r6(detect.DETECTORS[name](d, s).select("sample_id", "t", (F.col("score") + 1e-8).alias("score")), "score")

    query(f"detect_{name.lower()}", sql.replace("), 6) + 0.0 AS score", ") + 1e-8, 6) + 0.0 AS score"))(run)


_recursive("EWMA", f"WITH {SM}, s AS (SELECT sample_id, t, " + ", ".join(f"{c}, list_reduce(list({c}) OVER w, lambda a, x: 0.3 * x + 0.7 * a) AS s_{c}" for c in Three) + f" FROM sm WINDOW w AS (PARTITION BY sample_id ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT sample_id, t, {_MOST('abs({c} - s_{c})')} FROM s")
_recursive("Kalman", ORACLE_SQL["detect_ewma"].replace("0.3 * x + 0.7 * a", "0.5 * x + 0.5 * a").replace(") + 1e-8, 6)", "), 6)"))


def _score3(name: str) -> None:
    """Sums of prices and densities of narrow bins: six decimals are beyond a double."""

    def run(spark, sf):
        d, s = series.supplier_months(spark, sf)
        return detect.DETECTORS[name](d, s).select("sample_id", "t", (F.round("score", 3) + 0.0).alias("score"))

    query(f"detect_{name.lower()}")(run)


_score3("FFT")
_score3("HBOS")
_score3("KNN")
_score3("MatrixProfile")
_TRIPLE = "(col_1 + col_2 + col_3) / 3"
ORACLE_SQL["detect_knn"] = f"""WITH {SM}, m AS (SELECT sample_id, t, count(*) OVER (PARTITION BY sample_id) AS n, {_TRIPLE} AS m, col_1, col_2, col_3 FROM sm),
    d AS (SELECT *, sqrt(((col_1 - m) ^ 2 + (col_2 - m) ^ 2 + (col_3 - m) ^ 2) / 2) AS d FROM m),
    z AS (SELECT sample_id, t, n, CASE WHEN d > 0 THEN (col_1 - m) / d ELSE 0 END AS x, CASE WHEN d > 0 THEN (col_2 - m) / d ELSE 0 END AS y, CASE WHEN d > 0 THEN (col_3 - m) / d ELSE 0 END AS w FROM d),
    p AS (SELECT a.sample_id, a.t, a.n, (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.w - b.w) ^ 2 AS q FROM z a JOIN z b ON a.sample_id = b.sample_id AND a.t <> b.t),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, t ORDER BY q) AS k FROM p)
    SELECT sample_id, t, round(coalesce(sqrt(q), 0.0), 3) + 0.0 AS score FROM sm LEFT JOIN (SELECT * FROM r WHERE k = least(10, n - 1)) USING (sample_id, t)"""
_score3("LOF")
ORACLE_SQL["detect_lof"] = ORACLE_SQL["detect_knn"].split("    r AS (")[0] + """    r AS (SELECT *, sqrt(q) AS e, row_number() OVER (PARTITION BY sample_id, t ORDER BY q) AS k FROM p),
    h AS (SELECT sample_id, t, u, e FROM r WHERE k <= least(20, n - 1)),
    f AS (SELECT sample_id, t, max(e) AS far FROM h GROUP BY 1, 2),
    y AS (SELECT h.sample_id, h.t, 1 / (avg(greatest(h.e, f.far)) + 1e-10) AS dense FROM h JOIN f ON f.sample_id = h.sample_id AND f.t = h.u GROUP BY 1, 2),
    o AS (SELECT h.sample_id, h.t, avg(b.dense) / any_value(a.dense) AS s FROM h JOIN y a ON a.sample_id = h.sample_id AND a.t = h.t JOIN y b ON b.sample_id = h.sample_id AND b.t = h.u GROUP BY 1, 2)
    SELECT sample_id, t, round(coalesce(s, 0.0), 3) + 0.0 AS score FROM sm LEFT JOIN o USING (sample_id, t)"""
ORACLE_SQL["detect_lof"] = ORACLE_SQL["detect_lof"].replace("SELECT a.sample_id, a.t, a.n, (a.x", "SELECT a.sample_id, a.t, b.t AS u, a.n, (a.x")
ORACLE_SQL["detect_matrixprofile"] = f"""WITH {SM}, l AS (SELECT sample_id, t, count(*) OVER (PARTITION BY sample_id) AS n, list(col_1) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS v FROM sm),
    w AS (SELECT *, list_avg(v) AS m, list_stddev_pop(v) AS s FROM l WHERE len(v) = 10),
    z AS (SELECT sample_id, t, n, list_transform(v, lambda x: CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END) AS v FROM w),
    p AS (SELECT a.sample_id, a.t, min(2 * (10 - list_dot_product(a.v, b.v))) AS d FROM z a JOIN z b ON a.sample_id = b.sample_id AND abs(a.t - b.t) > 5 GROUP BY 1, 2)
    SELECT l.sample_id, l.t, round(coalesce(sqrt(greatest(d, 0)), 0.0), 3) + 0.0 AS score FROM l LEFT JOIN p ON p.sample_id = l.sample_id AND p.t = greatest(0, least(l.t - 5, n - 10))"""


for _name in detect.DETECTORS:
    if f"detect_{_name.lower()}" not in QUERIES:
        query(f"detect_{_name.lower()}")(_sm(detect.DETECTORS[_name], "score"))


@query("detect_ensemble")
def _(spark, sf):
    d, s = series.supplier_months(spark, sf)
    return r6(detect.flag(detect.ensemble(d, s, ["ZScore", "MAD", "RollingMedian"]), s).select("sample_id", "t", "score", "is_outlier"), "score")


# ---- constraints ---------------------------------------------------------------------------------------------------

DIFF = """u AS (UNPIVOT sm ON col_1, col_2, col_3 INTO NAME col VALUE x), s1 AS (SELECT sample_id, t, col, x, x - lag(x) OVER w AS speed, count(x) OVER v AS n, var_samp(x) OVER v AS vs FROM u WINDOW w AS (PARTITION BY sample_id, col ORDER BY t), v AS (PARTITION BY sample_id, col ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
 s2 AS (SELECT sample_id, t, col, speed, speed - lag(speed) OVER (PARTITION BY sample_id, col ORDER BY t) AS accel, CASE WHEN n = 5 THEN vs END AS variance FROM s1), k AS (UNPIVOT s2 ON speed, accel, variance INTO NAME kind VALUE y)"""


@query("mine_column_constraints", f"WITH {SM}, {DIFF}, m AS (SELECT col, kind, median(y) AS med FROM k GROUP BY 1, 2), d AS (SELECT col, kind, any_value(med) AS med, median(abs(y - med)) AS mad FROM k JOIN m USING (col, kind) GROUP BY 1, 2) SELECT col, kind, round(med - 3 * 1.4826 * mad, 4) + 0.0 AS lower, round(med + 3 * 1.4826 * mad, 4) + 0.0 AS upper FROM d")
def _(spark, sf):
    d = constraints.column_bounds_table(*series.supplier_months(spark, sf))
    return d.select("col", "kind", (F.round("lower", 4) + 0.0).alias("lower"), (F.round("upper", 4) + 0.0).alias("upper"))


@query("mine_column_quantiles", f"WITH {SM}, {DIFF} SELECT sample_id, col, kind, round(quantile_cont(y, 0.05), 4) + 0.0 AS lower, round(quantile_cont(y, 0.95), 4) + 0.0 AS upper FROM k GROUP BY 1, 2, 3")
def _(spark, sf):
    d = constraints.column_bounds_table(*series.supplier_months(spark, sf), per_sample=True, quantiles=(0.05, 0.95))
    return d.select("sample_id", "col", "kind", (F.round("lower", 4) + 0.0).alias("lower"), (F.round("upper", 4) + 0.0).alias("upper"))


@query("order_dependency_ratios", f"WITH {SM} " + " UNION ALL ".join(f"SELECT sample_id, '{a}' AS source, '{b}' AS target, round(avg(CAST(d >= 0 AS DOUBLE)), 6) + 0.0 AS increasing, round(avg(CAST(d <= 0 AS DOUBLE)), 6) + 0.0 AS decreasing FROM (SELECT sample_id, {b} - lag({b}) OVER (PARTITION BY sample_id ORDER BY {a}, t) AS d FROM sm) GROUP BY 1" for a in Three for b in Three if a != b))
def _(spark, sf):
    return r6(constraints.order_ratios(*series.supplier_months(spark, sf)), "increasing", "decreasing")


@query("trend_dependency", f"WITH {SM}, d AS (SELECT sample_id, sign(col_1 - lag(col_1) OVER w) AS x, sign(col_2 - lag(col_2) OVER w) AS y FROM sm WINDOW w AS (PARTITION BY sample_id ORDER BY t)) SELECT sample_id, round(avg(CAST(x = y AS DOUBLE)), 6) + 0.0 AS same, round(avg(CAST(x = -y AS DOUBLE)), 6) + 0.0 AS opposite FROM d WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return r6(constraints.trend_agreement(*series.supplier_months(spark, sf), "col_1", "col_2"), "same", "opposite")


@query("sequential_dependency", f"""WITH {SM}, d AS (SELECT sample_id, t, sign(col_1 - lag(col_1) OVER w) AS s, sign(col_2 - lag(col_2) OVER w) AS d FROM sm WINDOW w AS (PARTITION BY sample_id ORDER BY t)), i AS (SELECT *, t - row_number() OVER (PARTITION BY sample_id, s ORDER BY t) AS island FROM d WHERE s IS NOT NULL AND s <> 0),
 r AS (SELECT sample_id, s, island, count(*) AS n, count(*) FILTER (s = d) AS k FROM i GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT sample_id, round(sum(k) / sum(n), 6) + 0.0 AS same_direction, CAST(sum(n) AS BIGINT) AS steps FROM r GROUP BY 1""")
def _(spark, sf):
    return r6(constraints.monotone_segments(*series.supplier_months(spark, sf), "col_1", "col_2", 2), "same_direction")


RULES = constraints.Constraints(speed={"col_1": (-300.0, 300.0)}, accel={"col_1": (-400.0, 400.0)}, variance={"col_1": (0.0, 30000.0)}, amplitude={"col_3": (0.01, 0.09)})

EV_RULES = constraints.Constraints(speed={"col_1": (-0.01, 0.01)}, accel={"col_1": (-0.001, 0.001)}, variance={"col_1": (0.0, 400.0)})
VIOL = f"""WITH {SM}, q AS (SELECT *, col_1 - lag(col_1) OVER w AS sp, col_1 - 2 * lag(col_1) OVER w + lag(col_1, 2) OVER w AS ac, CASE WHEN count(col_1) OVER v = 10 THEN var_pop(col_1) OVER v END AS va FROM sm WINDOW w AS (PARTITION BY sample_id ORDER BY t), v AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
 vio AS (SELECT sample_id, t, 'speed' AS kind, 'col_1' AS cols, sp AS value, greatest(-300 - sp, sp - 300) AS degree FROM q WHERE abs(sp) > 300 UNION ALL SELECT sample_id, t, 'accel', 'col_1', ac, greatest(-400 - ac, ac - 400) FROM q WHERE abs(ac) > 400
  UNION ALL SELECT sample_id, t, 'variance', 'col_1', va, va - 30000 FROM q WHERE va > 30000 UNION ALL SELECT sample_id, t, 'amplitude', 'col_3', col_3, greatest(0.01 - col_3, col_3 - 0.09) FROM q WHERE col_3 < 0.01 OR col_3 > 0.09)"""


@query("column_violations", f"{VIOL} SELECT sample_id, t, kind, cols, round(value, 4) + 0.0 AS value, round(degree, 4) + 0.0 AS degree FROM vio")
def _(spark, sf):
    v = constraints.violations(*series.supplier_months(spark, sf), RULES)
    return v.select("sample_id", "t", "kind", F.array_join("cols", ",").alias("cols"), (F.round("value", 4) + 0.0).alias("value"), (F.round("degree", 4) + 0.0).alias("degree"))


@query("violation_rates", f"""{VIOL}, n AS (SELECT sample_id, count(*) AS n FROM sm GROUP BY 1), b AS (SELECT sample_id, kind, cols, count(DISTINCT t) AS bad FROM vio GROUP BY GROUPING SETS ((sample_id), (sample_id, kind), (sample_id, kind, cols))),
 z AS (SELECT * FROM b UNION ALL SELECT sample_id, NULL, NULL, 0 FROM n), m AS (SELECT sample_id, kind, cols, max(bad) AS bad FROM z GROUP BY 1, 2, 3) SELECT sample_id, kind, cols, round(bad / n, 6) + 0.0 AS rate FROM m JOIN n USING (sample_id)""")
def _(spark, sf):
    d, s = series.supplier_months(spark, sf)
    return r6(constraints.violation_rates(d, s, constraints.violations(d, s, RULES)), "rate")


@query("order_violations", f"WITH {SM}, m AS (SELECT *, max(col_2) OVER (PARTITION BY sample_id ORDER BY col_1, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sm) SELECT sample_id, t, round(m - col_2, 4) + 0.0 AS degree FROM m WHERE m > col_2")
def _(spark, sf):
    d, s = series.supplier_months(spark, sf)
    rule = constraints.Constraints(order=[constraints.OrderConstraint("col_1", "col_2", "increasing", 1.0)])
    return constraints.violations(d, s, rule).select("sample_id", "t", (F.round("degree", 4) + 0.0).alias("degree"))


@query("mine_row_order_denial")
def _(spark, sf):
    d, s = series.supplier_months(spark, sf)
    c = constraints.mine_all(written(d, "months"), s, max_std=None)  # a score of passes read the months
    return spark.createDataFrame([(line,) for line in constraints.report(c).split("\n")], "constraint string")


# ---- repairs -------------------------------------------------------------------------------------------------------


def _ev_op(op, *cols):
    def run(spark, sf):
        d, s = ev(spark, sf)
        return r6(op(d, s).select("sample_id", "t", "col_1"), "col_1")

    return run


def _clean(op):
    """The repair of the complete series."""

    def run(spark, sf):
        d, s = ev(spark, sf, 0)
        return r6(op(d, s).select("sample_id", "t", "col_1"), "col_1")

    return run


query("repair_moving_average", f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM ev), w AS (SELECT *, avg(clean_1) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, avg(CASE WHEN t < 5 THEN clean_1 END) OVER (PARTITION BY sample_id) AS h, avg(CASE WHEN t >= n - 5 THEN clean_1 END) OVER (PARTITION BY sample_id) AS e FROM n)
 SELECT sample_id, t, round(CASE WHEN t < 2 THEN h WHEN t >= n - 2 THEN e ELSE m END, 6) + 0.0 AS col_1 FROM w""")(_clean(repair.moving_average))
query("repair_interpolation", f"""WITH {EV.replace("CASE WHEN event_id % 7 <> 0 THEN value END AS col_1", "value AS v0")}, ev2 AS (SELECT sample_id, t, timestamp, CASE WHEN t % 3 = 0 OR t = max(t) OVER (PARTITION BY sample_id) THEN v0 END AS col_1 FROM ev), {LINEAR.replace("FROM ev WINDOW", "FROM ev2 WINDOW")} SELECT sample_id, t, {R('x', 'col_1')} FROM lin""")(_clean(repair.interpolation))
query("repair_smurf", f"""WITH {EV}, w AS (SELECT *, avg(clean_1) OVER f AS m, coalesce(stddev_samp(clean_1) OVER f, 0) AS s, stddev_pop(clean_1) OVER (PARTITION BY sample_id) AS g FROM ev WINDOW f AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
 SELECT sample_id, t, round(CASE WHEN abs(clean_1 - m) > 3 * s + 0.1 * g THEN m ELSE clean_1 END, 6) + 0.0 AS col_1 FROM w""")(_clean(repair.smurf))
query("repair_window_regression", f"""WITH {EV}, w AS (SELECT *, regr_slope(clean_1, t) OVER f AS b, regr_intercept(clean_1, t) OVER f AS a, regr_syy(clean_1, t) OVER f AS syy, regr_sxy(clean_1, t) OVER f AS sxy, regr_sxx(clean_1, t) OVER f AS sxx, regr_count(clean_1, t) OVER f AS n FROM ev WINDOW f AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
 SELECT sample_id, t, round(CASE WHEN abs(clean_1 - (a + b * t)) > 3 * sqrt(greatest(syy - coalesce(sxy ^ 2 / nullif(sxx, 0), 0), 0) / n) + 1e-12 THEN a + b * t ELSE clean_1 END, 6) + 0.0 AS col_1 FROM w""")(_clean(repair.window_regression))
query("repair_abnormal_sequence_interpolation", f"""WITH {EV.replace("CASE WHEN event_id % 7 <> 0 THEN value END AS col_1", "value AS v0")}, h AS (SELECT *, list(v0) OVER f AS l, quantile_cont(v0, 0.5) OVER f AS m FROM ev WINDOW f AS (PARTITION BY sample_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
 ev2 AS (SELECT sample_id, t, timestamp, CASE WHEN abs(v0 - m) <= 3 * list_median(list_transform(l, lambda x: abs(x - m))) THEN v0 END AS col_1 FROM h), {LINEAR.replace("FROM ev WINDOW", "FROM ev2 WINDOW")} SELECT sample_id, t, {R('x', 'col_1')} FROM lin""")(_clean(repair.abnormal_sequence))
for _name in repair.MISSING_REPAIRS:
    if _name != "interpolation":
        query(f"repair_missing_{_name}")(_ev_op(repair.MISSING_REPAIRS[_name]))
# halves of halves lie on the edge of rounding: a shift takes them off
query("repair_exponential_smoothing")(_clean(lambda d, s: (r := repair.exponential_smoothing(d, s)).withColumn("col_1", r["col_1"] + 1e-9)))
query("repair_akane")(_ev_op(repair.OUTLIER_REPAIRS["akane"]))
for _name in repair.OUTLIER_REPAIRS:
    if f"repair_{_name}" not in QUERIES:
        query(f"repair_{_name}")(_clean(repair.OUTLIER_REPAIRS[_name]))
for _name in constrained.CONSTRAINT_REPAIRS:
    query(f"repair_constraint_{_name.lower()}")(_clean(lambda d, s, n=_name: constrained.CONSTRAINT_REPAIRS[n](d, s, EV_RULES)))


def _bounds(name: str):
    """Steps of each sample, and those beyond the speed and (if the repair keeps to it) the acceleration, after a repair: none may be left."""

    def run(spark, sf):
        d, s = ev(spark, sf, 0)
        r = constrained.CONSTRAINT_REPAIRS[name](d, s, EV_RULES)
        gap = F.greatest((F.col("timestamp") - F.lag("timestamp").over(s.ordered)).cast("double"), F.lit(1e-8))
        r = r.withColumns({"d": gap, "v": (F.col("col_1") - F.lag("col_1").over(s.ordered)) / gap})
        r = r.withColumn("a", (F.col("v") - F.lag("v").over(s.ordered)) / F.col("d"))
        sharp = F.count_if(F.abs("a") > 0.001 + 1e-6) if name in ("speed_accel_global", "mtclean") else F.lit(0).cast("long")
        return r.groupBy("sample_id").agg(F.count("v").alias("steps"), F.count_if(F.abs("v") > 0.01 + 1e-6).alias("too_fast"), sharp.alias("too_sharp"))

    return run


for _name in ("screen", "speed_local", "speed_global", "speedacc", "speed_accel_local", "speed_accel_global", "mtclean", "mtcsc_n", "oneMilp", "oneMilp_rows"):
    _none = "CAST(0 AS BIGINT)"
    query(f"bounds_{_name.lower()}", f"WITH {EV} SELECT sample_id, count(*) - 1 AS steps, {_none} AS too_fast, {_none} AS too_sharp FROM ev GROUP BY 1")(_bounds(_name))
for _name in ("ewma", "ridge", "kalman"):
    query(f"impute_{_name}")(_ev_op(missing.IMPUTERS[_name]))


@query("repair_labelled")
def _(spark, sf):
    d, s = ev(spark, sf, 0)
    return r6(repair.repair_labelled(d.withColumn("label", (F.col("timestamp") % 11 == 0).cast("int")), s, "label", "ols_residual").select("sample_id", "t", "col_1"), "col_1")


@query("inject_errors")
def _(spark, sf):
    d, s = ev(spark, sf, 0)
    return inject.inject(d, s, 0.3).select("sample_id", "t", "timestamp", "col_1", "mask_col_1")


@query("inject_drift_blocks", f"""WITH {EV}, b AS (SELECT sample_id, 20 + sample_id % 5 AS start, 8 + sample_id % 6 AS len FROM ev GROUP BY 1), s AS (SELECT *, min(clean_1) OVER w AS lo, coalesce(10 / nullif(avg(clean_1) OVER w - min(clean_1) OVER w, 0), 1) AS f FROM ev WINDOW w AS (PARTITION BY sample_id))
 SELECT sample_id, t, round(CASE WHEN t >= start AND t < start + len THEN greatest(0, least(30, (clean_1 - lo) * f + 6)) ELSE (clean_1 - lo) * f END / f + lo, 6) + 0.0 AS col_1, t >= start AND t < start + len AS mask_col_1 FROM s JOIN b USING (sample_id)""")
def _(spark, sf):
    d, s = ev(spark, sf, 0)
    b = d.select("sample_id").distinct().select("sample_id", (20 + F.col("sample_id") % 5).cast("long").alias("start"), (8 + F.col("sample_id") % 6).cast("int").alias("length"), F.lit("drift").alias("kind"), F.array(F.lit("col_1")).alias("cols"))
    return r6(inject.apply_schedule(d, s, b).select("sample_id", "t", "col_1", "mask_col_1"), "col_1")


# ---- metrics -------------------------------------------------------------------------------------------------------


@query("repair_metrics", f"""WITH {EV}, {LINEAR}, j AS (SELECT x AS r, clean_1 AS c, coalesce(ev.col_1, 0) AS d FROM lin JOIN ev USING (sample_id, t)), b AS (SELECT *, (max(d) OVER () - min(d) OVER ()) / 1e4 AS bound, max(c) OVER () - min(c) OVER () AS span FROM j),
 g AS (SELECT avg(((r - c) / span) ^ 2) AS mse, avg(abs((r - c) / span)) AS mnad, 1 - sum(abs(r - c)) / (sum(abs(d - c)) + sum(abs(r - d))) AS rra, count(*) FILTER (abs(d - c) > bound AND abs(r - d) > bound AND abs(r - c) < abs(d - c)) AS ok, count(*) FILTER (abs(r - d) > bound) AS rep, count(*) FILTER (abs(d - c) > bound) AS err, sum(CASE WHEN d <> c THEN abs(r - c) END) / count(*) FILTER (d <> c) AS mae FROM b)
 SELECT round(mse, 6) + 0.0 AS mse, round(mnad, 6) + 0.0 AS mnad, round(rra, 6) + 0.0 AS rra, round(ok / rep, 6) + 0.0 AS precision, round(ok / err, 6) + 0.0 AS recall, round(2 * (ok / rep) * (ok / err) / (ok / rep + ok / err), 6) + 0.0 AS f1, round(mae, 6) + 0.0 AS mae_error FROM g""")
def _(spark, sf):
    d, s = ev(spark, sf)
    m = metrics.repair_metrics(missing.impute_linear(d, s), d.withColumn("col_1", F.col("clean_1")), d, s)
    return r6(m, *m.columns)


@query("structure_metric", f"WITH {EV} SELECT sample_id, round(-avg(abs(clean_1 - (coalesce(a, 0) + clean_1 + coalesce(b, 0)) / 3)), 6) + 0.0 AS structure FROM (SELECT sample_id, clean_1, lag(clean_1) OVER w AS a, lead(clean_1) OVER w AS b FROM ev WINDOW w AS (PARTITION BY sample_id ORDER BY t)) GROUP BY 1")
def _(spark, sf):
    return r6(metrics.structure(*ev(spark, sf), "clean_1"), "structure")


@query("label_events", f"WITH {EV}, {LAB}, i AS (SELECT sample_id, t, t - row_number() OVER (PARTITION BY sample_id ORDER BY t) AS k FROM lab WHERE pred = 1) SELECT sample_id, min(t) AS start, max(t) + 1 AS \"end\" FROM i GROUP BY sample_id, k")
def _(spark, sf):
    return metrics.events(*lab(spark, sf), "pred")


@query("point_scores", f"""WITH {EV}, {LAB}, g AS (SELECT sample_id, count(*) FILTER (label = 1 AND pred = 1) AS tp, sum(pred) AS pp, sum(label) AS p FROM lab GROUP BY 1), m AS (SELECT sample_id, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(p, 0), 0) AS recall FROM g)
 SELECT sample_id, {R('precision')}, {R('recall')}, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) + 0.0 AS f1 FROM m""")
def _(spark, sf):
    return r6(metrics.point_scores(*lab(spark, sf)), "precision", "recall", "f1")


@query("roc_auc", f"""WITH {EV}, {LAB}, g AS (SELECT sample_id, score, sum(label) AS p, sum(1 - label) AS n FROM lab GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sample_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
 SELECT sample_id, round(sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0), 6) + 0.0 AS auc FROM b GROUP BY 1""")
def _(spark, sf):
    return r6(metrics.roc_auc(*lab(spark, sf)), "auc")


@query("average_precision", f"""WITH {EV}, {LAB}, g AS (SELECT sample_id, score, sum(label) AS p, count(*) AS m FROM lab GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS al FROM g WINDOW w AS (PARTITION BY sample_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT sample_id, round(sum(tp / al * p) / nullif(sum(p), 0), 6) + 0.0 AS ap FROM c GROUP BY 1""")
def _(spark, sf):
    return r6(metrics.average_precision(*lab(spark, sf)), "ap")


_EVENTS = lambda f: f"(SELECT sample_id, min(t) AS a, max(t) + 1 AS b FROM (SELECT sample_id, t, t - row_number() OVER (PARTITION BY sample_id ORDER BY t) AS k FROM lab WHERE {f} = 1) GROUP BY sample_id, k)"
_F1 = "round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) + 0.0 AS f1"


@query("range_f1", f"""WITH {EV}, {LAB}, l AS {_EVENTS('label')}, p AS {_EVENTS('pred')}, r1 AS (SELECT l.sample_id, l.a, l.b, count(p.a) AS k, sum(least(l.b, p.b) - greatest(l.a, p.a)) AS o FROM l LEFT JOIN p ON l.sample_id = p.sample_id AND p.a < l.b AND p.b > l.a GROUP BY 1, 2, 3),
 p1 AS (SELECT p.sample_id, p.a, p.b, count(l.a) AS k, sum(least(l.b, p.b) - greatest(l.a, p.a)) AS o FROM p LEFT JOIN l ON l.sample_id = p.sample_id AND p.a < l.b AND p.b > l.a GROUP BY 1, 2, 3),
 r AS (SELECT sample_id, avg(CASE WHEN k > 0 THEN 0.2 + 0.8 * o / (b - a) / k ELSE 0 END) AS recall FROM r1 GROUP BY 1), q AS (SELECT sample_id, avg(CASE WHEN k > 0 THEN o / (b - a) / k ELSE 0 END) AS precision FROM p1 GROUP BY 1),
 m AS (SELECT sample_id, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall FROM (SELECT DISTINCT sample_id FROM lab) LEFT JOIN q USING (sample_id) LEFT JOIN r USING (sample_id)) SELECT sample_id, {R('precision')}, {R('recall')}, {_F1} FROM m""")
def _(spark, sf):
    return r6(metrics.range_f1(*lab(spark, sf)), "precision", "recall", "f1")


_ADJUST = """adj AS (SELECT sample_id, t, label, CASE WHEN label = 1 AND (t > 0 OR pred = 1) THEN max(pred) OVER (PARTITION BY sample_id, label, k) ELSE pred END AS pred FROM (SELECT *, t - row_number() OVER (PARTITION BY sample_id, label ORDER BY t) AS k FROM lab))"""


@query("event_f1", f"""WITH {EV}, {LAB}, {_ADJUST}, l AS {_EVENTS('label')}, h AS (SELECT l.sample_id, l.a, max(CASE WHEN pred = 1 THEN 1 ELSE 0 END) AS hit FROM l JOIN lab ON l.sample_id = lab.sample_id AND t >= l.a AND t < l.b GROUP BY 1, 2), r AS (SELECT sample_id, avg(hit) AS recall FROM h GROUP BY 1),
 p AS (SELECT sample_id, coalesce(count(*) FILTER (label = 1 AND pred = 1) / nullif(sum(pred), 0), 0) AS precision FROM adj GROUP BY 1), m AS (SELECT sample_id, precision, coalesce(recall, 0) AS recall FROM p LEFT JOIN r USING (sample_id)) SELECT sample_id, {R('precision')}, {R('recall')}, {_F1} FROM m""")
def _(spark, sf):
    return r6(metrics.event_f1(*lab(spark, sf)), "precision", "recall", "f1")


@query("best_f1", f"""WITH {EV}, {LAB}, g AS (SELECT sample_id, score, sum(label) AS p, count(*) AS m FROM lab GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS al, sum(p) OVER (PARTITION BY sample_id) AS pos FROM g WINDOW w AS (PARTITION BY sample_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT sample_id, round(max(2 * (tp / al) * (tp / nullif(pos, 0)) / (tp / al + tp / nullif(pos, 0) + 1e-5)), 6) + 0.0 AS best_f1 FROM c GROUP BY 1""")
def _(spark, sf):
    return r6(metrics.best_f1(*lab(spark, sf)), "best_f1")


@query("point_adjust", f"WITH {EV}, {LAB}, {_ADJUST} SELECT sample_id, t, label, pred FROM adj")
def _(spark, sf):
    return metrics.point_adjust(*lab(spark, sf)).select("sample_id", "t", "label", "pred")


@query("detection_metrics")
def _(spark, sf):
    return metrics.detection_metrics(*lab(spark, sf), window=20)


@query("threshold_sigma", f"WITH {EV}, {LAB} SELECT sample_id, t, CAST(score > avg(score) OVER w + 1.5 * stddev_pop(score) OVER w AS INTEGER) AS pred FROM lab WINDOW w AS (PARTITION BY sample_id)")
def _(spark, sf):
    return metrics.threshold(*lab(spark, sf), "sigma", value=1.5).select("sample_id", "t", "pred")


@query("meta_gini", f"""WITH {SM}, u AS (UNPIVOT sm ON col_1, col_2, col_3 INTO NAME col VALUE x), m AS (SELECT col, x - least(min(x) OVER (PARTITION BY col), 0) + 1e-7 AS v FROM u), r AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) AS r, count(*) OVER (PARTITION BY col) AS n FROM m)
 SELECT col, round(sum((2 * r - n - 1) * v) / (any_value(n) * sum(v)), 6) + 0.0 AS gini FROM r GROUP BY 1""")
def _(spark, sf):
    from seriesmend.spec import long_form

    d, s = series.supplier_months(spark, sf)
    return r6(selection.gini(long_form(d, s), ["col"], "value"), "gini")


# ---- windows of event time -----------------------------------------------------------------------------------------


@query("hourly_rates", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY ALL")
def _(spark, sf):
    return r6(online.windowed_rates(spark.read.parquet(f"{sf}/events.parquet")), "mean")


@query("user_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, TRUE) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(CAST(s AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM k GROUP BY user_id, k""")
def _(spark, sf):
    return online.sessions(spark.read.parquet(f"{sf}/events.parquet"), "6 hours")


# ---- SQL of recursions and of sums over pairs of rows --------------------------------------------------------------

ORACLE_SQL.update(oracles.detectors(SM, Three) | oracles.repairs(EV, LINEAR))
