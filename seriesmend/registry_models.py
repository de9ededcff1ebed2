"""Queries of what is learned from all series at once: shape graphs, networks, support vectors; and what SQL can say of them."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmend.functions import rockets
from seriesmend.operators import detect, graphs, kshape, likelihood, metrics, networks, recurrent, svm, thresholds
from seriesmend.plans import ranking, selection
from seriesmend.registry import _ADJUST, _EVENTS, EV, LAB, LINEAR, R, ev, lab, r6
from seriesmend.runtime import prepare, written
from seriesmend.sources import series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir, fn=fn: fn(prepare(spark), sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# ---- shape graphs --------------------------------------------------------------------------------------------------

LENGTH, SMOOTH, RAYS, BINS = 8, 2, 24, 64


def _point(weights: list[float]) -> str:
    return " + ".join(f"{a!r} * lead(x, {m}) OVER w" for m, a in enumerate(weights))


_X, _Y = map(_point, graphs.fourier_weights(LENGTH, SMOOTH))
PATH = f"""{EV}, {LINEAR},
    pt AS (SELECT sample_id, t, {_X} AS x, {_Y} AS y FROM lin WINDOW w AS (PARTITION BY sample_id ORDER BY t) QUALIFY lead(x, {LENGTH - 1}) OVER w IS NOT NULL),
    tn AS (SELECT *, (CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + {2 * math.pi!r} ELSE atan2(y, x) END) * {RAYS / (2 * math.pi)!r} AS a, sqrt(avg(x * x + y * y) OVER (PARTITION BY sample_id)) AS scale FROM pt),
    nx AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(a) OVER w - a AS d0 FROM tn WINDOW w AS (PARTITION BY sample_id ORDER BY t)),
    wr AS (SELECT *, CASE WHEN d0 > {RAYS / 2} THEN d0 - {RAYS} WHEN d0 <= -{RAYS / 2} THEN d0 + {RAYS} ELSE d0 END AS d FROM nx WHERE x2 IS NOT NULL),
    fl AS (SELECT *, CAST(CASE WHEN d > 0 THEN floor(a) + 1 ELSE ceil(a) - 1 END AS BIGINT) AS f, CAST(CASE WHEN d > 0 THEN floor(a + d) ELSE ceil(a + d) END AS BIGINT) AS l FROM wr WHERE d <> 0),
    ex AS (SELECT *, unnest(range(abs(l - f) + 1)) AS k FROM fl WHERE CASE WHEN d > 0 THEN l >= f ELSE l <= f END),
    ry AS (SELECT *, (((f + k * sign(d)) % {RAYS}) + {RAYS}) % {RAYS} AS ray FROM ex),
    ac AS (SELECT *, cos(ray * {2 * math.pi / RAYS!r}) * (y2 - y) - sin(ray * {2 * math.pi / RAYS!r}) * (x2 - x) AS across FROM ry),
    ds AS (SELECT *, greatest(CASE WHEN across <> 0 THEN (x * y2 - x2 * y) / across ELSE 0.0 END, 0.0) AS dist FROM ac),
    cr AS (SELECT sample_id, t, k, CAST(ray AS BIGINT) AS ray, least(CAST(floor({BINS} * dist / (dist + scale)) AS BIGINT), {BINS - 1}) AS bin FROM ds),
    sm AS (SELECT sample_id, ray, bin + o AS bin, sum(n * e) AS n FROM (SELECT sample_id, ray, bin, count(*) AS n FROM cr GROUP BY 1, 2, 3), (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) AS v(o, e)
           WHERE bin + o BETWEEN 0 AND {BINS - 1} GROUP BY 1, 2, 3),
    tp AS (SELECT *, CASE WHEN n > (CASE WHEN lag(bin) OVER w = bin - 1 THEN lag(n) OVER w ELSE 0 END) AND n >= (CASE WHEN lead(bin) OVER w = bin + 1 THEN lead(n) OVER w ELSE 0 END) THEN bin END AS top
           FROM sm WINDOW w AS (PARTITION BY sample_id, ray ORDER BY bin)),
    nr AS (SELECT sample_id, ray, bin, last_value(top IGNORE NULLS) OVER (PARTITION BY sample_id, ray ORDER BY bin ROWS UNBOUNDED PRECEDING) AS lo,
                  first_value(top IGNORE NULLS) OVER (PARTITION BY sample_id, ray ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM tp),
    st AS (SELECT cr.sample_id, t, k, ray AS from_ray, CASE WHEN lo IS NULL OR hi - bin < bin - lo THEN hi ELSE lo END AS from_bin FROM cr JOIN nr USING (sample_id, ray, bin)),
    path AS (SELECT sample_id, t, from_ray, from_bin, lead(from_ray) OVER w AS to_ray, lead(from_bin) OVER w AS to_bin FROM st WINDOW w AS (PARTITION BY sample_id ORDER BY t, k) QUALIFY to_ray IS NOT NULL),
    edges AS (SELECT sample_id, from_ray, from_bin, to_ray, to_bin, count(*) AS weight FROM path GROUP BY ALL)"""


@query("series2graph_edges", f"WITH {PATH} SELECT * FROM edges")
def _(spark, sf):
    d, s = ev(spark, sf)
    edges = graphs.shape_edges(graphs.shape_path(d, s, LENGTH, SMOOTH, RAYS, BINS, "fourier"))
    return edges.withColumnRenamed("sample", "sample_id").drop("col")


@query("detect_series2graph_fourier", f"""WITH {PATH},
    dg AS (SELECT sample_id, ray, bin, count(*) AS degree FROM (SELECT sample_id, from_ray AS ray, from_bin AS bin FROM edges UNION ALL SELECT sample_id, to_ray, to_bin FROM edges) GROUP BY ALL),
    wo AS (SELECT e.*, weight * (degree - 1) AS worth FROM edges e JOIN dg ON e.sample_id = dg.sample_id AND from_ray = ray AND from_bin = bin),
    gone AS (SELECT sample_id, t, sum(worth) AS v FROM path JOIN wo USING (sample_id, from_ray, from_bin, to_ray, to_bin) GROUP BY ALL),
    ro AS (SELECT sample_id, t, CASE WHEN t < count(*) OVER (PARTITION BY sample_id) - {LENGTH} THEN coalesce(v, 0) END AS v FROM ev LEFT JOIN gone USING (sample_id, t)),
    no AS (SELECT *, avg(v) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN {2 * LENGTH - 1} PRECEDING AND CURRENT ROW) AS normal FROM ro),
    mx AS (SELECT *, max(normal) OVER (PARTITION BY sample_id) AS most FROM no),
    sc AS (SELECT sample_id, t, CASE WHEN most > 0 THEN coalesce(1 - normal / most, 0.0) ELSE 0.0 END AS score FROM mx)
    SELECT sample_id, t, {R('score')} FROM sc""")
def _(spark, sf):
    d, s = ev(spark, sf)
    found = graphs.series2graph(d, s, LENGTH, SMOOTH, rays=RAYS, bins=BINS, projection="fourier")
    return r6(found.select("sample_id", "t", "score"), "score")


@query("detect_series2graph")
def _(spark, sf):
    d, s = ev(spark, sf)
    return graphs.series2graph(d, s).select("sample_id", "t", "score")


# ---- networks ------------------------------------------------------------------------------------------------------


def months(spark, sf):
    return series.supplier_months(spark, sf)


def _scores(found):
    return found.select("sample_id", "t", "score")


@query("detect_autoencoder")
def _(spark, sf):
    return _scores(networks.autoencoder(*ev(spark, sf)))


@query("detect_usad")
def _(spark, sf):
    return _scores(networks.usad(*months(spark, sf)))


@query("detect_window_means")
def _(spark, sf):
    return _scores(networks.window_mean_autoencoder(*months(spark, sf)))


@query("detect_lstm")
def _(spark, sf):
    return _scores(recurrent.lstm_detector(*ev(spark, sf), window=10))


@query("detect_catch")
def _(spark, sf):
    return _scores(recurrent.catch(*months(spark, sf), window=16))


@query("detect_tranad")
def _(spark, sf):
    return _scores(recurrent.tranad(*months(spark, sf)))


@query("repair_cae_m")
def _(spark, sf):
    return networks.cae_m_repair(*ev(spark, sf)).select("sample_id", "t", "col_1")


@query("repair_lstm_sequence")
def _(spark, sf):
    return recurrent.lstm_sequence_repair(*ev(spark, sf)).select("sample_id", "t", "col_1")


@query("forecast_lstm")
def _(spark, sf):
    """A forecaster of the users with even ids' events, judged on all users'; both halves hold whole series."""
    d, s = ev(spark, sf)
    score = recurrent.lstm_forecast_score(d.where("sample_id % 2 = 0"), d, s, window=12, horizon=3)
    return spark.createDataFrame([(score,)], "score double")


# ---- shapes --------------------------------------------------------------------------------------------------------


@query("detect_sand")
def _(spark, sf):
    return _scores(kshape.sand(*ev(spark, sf), pattern=6))


@query("sand_batches")
def _(spark, sf):
    """All users' events in the batches of their first 24 rows, the next 24 and so on."""
    d, s = ev(spark, sf)
    last = d.agg(F.max("t")).first()[0]
    parts = (d.where(F.floor(F.col("t") / 24) == k) for k in range((last or 0) // 24 + 1))
    found = [_scores(scored) for scored, _ in kshape.sand_batches(parts, s, 12, 6, k=4, stride=3, rounds=4)]
    return reduce(DataFrame.unionByName, found)


# ---- support vectors -----------------------------------------------------------------------------------------------


@query("detect_ocsvm")
def _(spark, sf):
    return _scores(svm.one_class(*ev(spark, sf), window=10, nu=0.2))


@query("repair_svr_tube")
def _(spark, sf):
    return svm.tube_repair(*ev(spark, sf)).select("sample_id", "t", "col_1")


# ---- thresholds ----------------------------------------------------------------------------------------------------


@query("tail_limits", f"""WITH {EV}, b AS (SELECT sample_id, count(*) AS n, quantile_cont(clean_1, 0.8) AS start, max(clean_1) AS top FROM ev GROUP BY 1),
    p AS (SELECT sample_id, clean_1 - start AS y FROM ev JOIN b USING (sample_id) WHERE clean_1 > start),
    z AS (SELECT *, (1 - (row_number() OVER (PARTITION BY sample_id ORDER BY y) - 0.35) / count(*) OVER (PARTITION BY sample_id)) * y AS z FROM p),
    m AS (SELECT sample_id, count(*) AS peaks, avg(y) AS a, avg(z) AS z FROM z GROUP BY 1),
    f AS (SELECT *, 2 - a / nullif(a - 2 * z, 0) AS shape, 2 * a * z / nullif(a - 2 * z, 0) AS scale FROM m),
    l AS (SELECT b.*, coalesce(peaks, 0) AS peaks, CASE WHEN peaks >= 10 AND scale > 0 THEN shape END AS shape, CASE WHEN peaks >= 10 AND shape IS NOT NULL AND scale > 0 THEN scale END AS scale FROM b LEFT JOIN f USING (sample_id))
    SELECT sample_id, n, peaks, {R('start')}, {R('shape')}, {R('scale')}, round(CASE WHEN shape IS NULL THEN top WHEN abs(shape) > 1e-9 THEN start + scale / shape * (pow(0.05 * n / peaks, -shape) - 1) ELSE start - scale * ln(0.05 * n / peaks) END, 6) + 0.0 AS "limit" FROM l""")
def _(spark, sf):
    d, s = ev(spark, sf)
    return r6(thresholds.tail_limits(d, s, "clean_1", risk=0.05, level=0.8), "start", "shape", "scale", "limit")


# ---- fixed kernels -------------------------------------------------------------------------------------------------


_TAPS = ", ".join(f"coalesce(lag(x, {(4 - k) * 2}) OVER w, 0.0)" for k in range(9))


@query("rocket_shares", f"""WITH {EV}, v AS (SELECT sample_id, t, coalesce(col_1, 0.0) - 50.0 AS x FROM ev), tp AS (SELECT sample_id, [{_TAPS}] AS taps FROM v WINDOW w AS (PARTITION BY sample_id ORDER BY t)),
    k AS (SELECT a.range AS a, b.range AS b, c.range AS c FROM range(9) a, range(9) b, range(9) c WHERE a.range < b.range AND b.range < c.range),
    cv AS (SELECT sample_id, a, b, c, 3 * (taps[a + 1] + taps[b + 1] + taps[c + 1]) - list_sum(taps) AS y FROM tp, k)
    SELECT sample_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, {R('avg(CAST(y > 0.001 AS INTEGER))', 'share')} FROM cv GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    """All 84 kernels at dilation 2 over all users' events; values have two decimals, so that no convolution lies at the bias."""
    d, s = ev(spark, sf)
    d = d.withColumn("col_1", F.coalesce("col_1", F.lit(0.0)) - 50.0)
    found = rockets.shares(d, s, [2], {("col_1", 2): [0.001] * len(rockets.KERNELS)}).select(F.col("sample").alias("sample_id"), F.posexplode("shares").alias("k", "share"))
    place = lambda i: F.get(F.from_json(F.lit(str([k[i] for k in rockets.KERNELS])), "array<int>"), F.col("k"))
    return r6(found.select("sample_id", *[place(i).alias(c) for i, c in enumerate("abc")], "share"), "share")


@query("auto_select_k")
def _(spark, sf):
    k, score = rockets.auto_select_k(*ev(spark, sf))
    return spark.createDataFrame([(k, score)], "k int, score double")


# ---- maximum likelihood --------------------------------------------------------------------------------------------


@query("repair_arma_ml")
def _(spark, sf):
    return likelihood.arma_ml(*ev(spark, sf)).select("sample_id", "t", "col_1")


@query("detect_garch")
def _(spark, sf):
    return _scores(likelihood.garch_score(*ev(spark, sf)))


# ---- metrics -------------------------------------------------------------------------------------------------------


_NAMES = ["auc", "precision", "recall", "f1", "point_f1", "range_recall", "existence", "overlap", "range_precision", "range_f1", "precision_at_k"]


@query("combined_metrics", f"""WITH {EV}, {LAB}, {_ADJUST}, l AS {_EVENTS('label')}, p AS {_EVENTS('pred')},
    g AS (SELECT sample_id, score, sum(label) AS p, sum(1 - label) AS n FROM lab GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sample_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
    au AS (SELECT sample_id, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM b GROUP BY 1),
    po AS (SELECT sample_id, coalesce(count(*) FILTER (label = 1 AND pred = 1) / nullif(sum(pred), 0), 0) AS precision, count(*) FILTER (label = 1 AND pred = 1) / sum(label) AS recall FROM lab GROUP BY 1 HAVING sum(label) > 0),
    aj AS (SELECT sample_id, coalesce(2 * count(*) FILTER (label = 1 AND pred = 1) / nullif(sum(pred) + sum(label), 0), 0) AS point_f1 FROM adj GROUP BY 1),
    r1 AS (SELECT l.sample_id, l.a, l.b, count(p.a) AS k, sum(least(l.b, p.b) - greatest(l.a, p.a)) AS o FROM l LEFT JOIN p ON l.sample_id = p.sample_id AND p.a < l.b AND p.b > l.a GROUP BY 1, 2, 3),
    p1 AS (SELECT p.sample_id, p.a, p.b, count(l.a) AS k, sum(least(l.b, p.b) - greatest(l.a, p.a)) AS o FROM p LEFT JOIN l ON l.sample_id = p.sample_id AND p.a < l.b AND p.b > l.a GROUP BY 1, 2, 3),
    rr AS (SELECT sample_id, avg(CAST(k > 0 AS DOUBLE)) AS existence, avg(CASE WHEN k > 0 THEN o / (b - a) / k ELSE 0 END) AS overlap FROM r1 GROUP BY 1),
    rp AS (SELECT sample_id, avg(CASE WHEN k > 0 THEN o / (b - a) / k ELSE 0 END) AS range_precision FROM p1 GROUP BY 1),
    ls AS (SELECT sample_id, list_sort(list(score)) AS v, count(*) AS n, sum(label) AS k FROM lab GROUP BY 1 HAVING sum(label) > 0),
    hh AS (SELECT sample_id, v, k, (1 - k / n) * (n - 1) AS h FROM ls),
    ct AS (SELECT sample_id, k, v[CAST(floor(h) AS BIGINT) + 1] + (h - floor(h)) * (coalesce(v[CAST(floor(h) AS BIGINT) + 2], v[CAST(floor(h) AS BIGINT) + 1]) - v[CAST(floor(h) AS BIGINT) + 1]) AS cut FROM hh),
    pk AS (SELECT sample_id, count(*) FILTER (score > cut AND label = 1) / any_value(k) AS precision_at_k FROM lab JOIN ct USING (sample_id) GROUP BY 1),
    m AS (SELECT sample_id, auc, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, point_f1, coalesce(existence, 0) AS existence, coalesce(overlap, 0) AS overlap, coalesce(range_precision, 0) AS range_precision, precision_at_k
        FROM po LEFT JOIN au USING (sample_id) LEFT JOIN aj USING (sample_id) LEFT JOIN rr USING (sample_id) LEFT JOIN rp USING (sample_id) LEFT JOIN pk USING (sample_id)),
    q AS (SELECT *, 0.2 * existence + 0.8 * overlap AS range_recall FROM m),
    z AS (SELECT *, coalesce(2 * range_precision * range_recall / nullif(range_precision + range_recall, 0), 0) AS range_f1 FROM q)
    SELECT sample_id, {", ".join(R(c) for c in _NAMES)} FROM z""")
def _(spark, sf):
    return r6(metrics.combined_metrics(*lab(spark, sf), pred="pred"), *_NAMES).select("sample_id", *_NAMES)


@query("rank_detectors")
def _(spark, sf):
    """Each user's series is a set: its features are statistics of its values, its performances the detectors' average precision; the ranking learns from users with even ids and ranks for all."""
    d, s = lab(spark, sf)
    rows = d.withColumn("col_1", F.col("score"))
    names = ["ZScore", "MAD", "MovingAverage", "EWMA"]
    told = selection.list_statistics(rows, ["sample_id"], "col_1").select("sample_id", F.array(*[F.col(c).cast("double") for c in ("min", "max", "mean", "std", "skew", "kurtosis")]).alias("features"))
    for n in names:
        found = detect.DETECTORS[n](rows.drop("score"), s).select("sample_id", "t", "score").join(d.select("sample_id", "t", "label"), ["sample_id", "t"])
        told = told.join(metrics.average_precision(found, s).withColumnRenamed("ap", n), "sample_id", "left")
    told = written(told.select("sample_id", "features", F.array(*names).alias("scores")), "rank-sets")
    fitted = ranking.Ranking(names, rounds=10).fit(told.where("sample_id % 2 = 0"))
    return fitted.predict(told.select("sample_id", "features")).select("sample_id", F.posexplode("ranked").alias("place", "model"))
