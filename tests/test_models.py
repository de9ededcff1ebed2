"""Shape graphs, trained networks and support vectors against plain versions."""

import math
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmend import registry_models
from seriesmend.operators import detect, graphs, kshape, learned, metrics, networks, recurrent, svm, tape
from seriesmend.operators.tape import Node
from seriesmend.plans import harness, policy
from seriesmend.runtime import written
from seriesmend.spec import SeriesSpec

from .test_series import duck, normal  # noqa: F401

ONE = SeriesSpec(("col_1",))


def table(spark, series, spec=ONE):
    """series: {sample: list of rows or of numbers}."""
    rows = [(s, t, t, *(float(v) if v is not None else None for v in (row if isinstance(row, (list, tuple)) else [row]))) for s, x in series.items() for t, row in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id long, t long, timestamp long, " + ", ".join(f"{f} double" for f in spec.features))


def scores(df):
    out = {}
    for r in df.orderBy("sample_id", "t").collect():
        out.setdefault(r.sample_id, []).append(r.score)
    return {s: np.array(x) for s, x in out.items()}


# ---- shape graphs --------------------------------------------------------------------------------------------------


def test_shape_edges_of_repeated_values_equal_the_sql(spark, tmp_path):
    """Windows of equal values are points beside the origin, some of them a rounding below the first ray."""
    import duckdb

    c = duckdb.connect()
    c.execute(f"""copy (select event_id + k * 100000 as event_id, ts, user_id, event_type, value, props from '/root/testdata/sf0.1/events.parquet', (select unnest(range(6)) as k)
        where user_id in (140, 806)) to '{tmp_path}/events.parquet'""")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = registry_models.QUERIES["series2graph_edges"](spark, str(tmp_path)).toPandas()
    assert normal(got) == normal(c.execute(registry_models.ORACLE_SQL["series2graph_edges"]).df())



def plain_graph(x, length, smooth, rays, bins, query, weights=None):
    """(edges, scores) of one series by the definition, loops alone."""
    n, d = len(x), length - smooth + 1
    sums = np.array([[x[t + j : t + j + smooth].sum() for j in range(d)] for t in range(n - length + 1)])
    if weights is None:
        angle = 2 * np.pi * np.arange(d) / d
        points = np.stack([sums @ np.cos(angle), sums @ np.sin(angle)], axis=1)
    else:
        w, off = graphs.plane(sums.T @ sums, sums.sum(0), len(sums), length, smooth)
        points = np.array([x[t : t + length] for t in range(len(sums))]) @ w - off
    scale = math.sqrt((points**2).sum(1).mean())
    turn = [math.atan2(y, u) % (2 * math.pi) * rays / (2 * math.pi) for u, y in points]
    crossed = []
    for t in range(len(points) - 1):
        way = turn[t + 1] - turn[t]
        way = way - rays if way > rays / 2 else way + rays if way <= -rays / 2 else way
        at = range(math.floor(turn[t]) + 1, math.floor(turn[t] + way) + 1) if way > 0 else range(math.ceil(turn[t]) - 1, math.ceil(turn[t] + way) - 1, -1) if way < 0 else ()
        (a, b), (c, e) = points[t], points[t + 1]
        for k in at:
            psi = 2 * math.pi * (k % rays) / rays
            across = math.cos(psi) * (e - b) - math.sin(psi) * (c - a)
            far = max((a * e - c * b) / across, 0) if across else 0.0
            crossed.append((t, k % rays, min(int(bins * far / (far + scale)), bins - 1)))
    count = Counter((r, b) for _, r, b in crossed)
    smoothed = Counter()
    for (r, b), m in count.items():
        for o, w in graphs.SMOOTHING.items():
            if 0 <= b + o < bins:
                smoothed[r, b + o] += m * w
    tops = {r: sorted(b for q, b in smoothed if q == r and smoothed[r, b] > smoothed.get((r, b - 1), 0) and smoothed[r, b] >= smoothed.get((r, b + 1), 0)) for r in range(rays)}
    steps = [(t, r, min(tops[r], key=lambda node: (abs(node - b), node))) for t, r, b in crossed]
    edges = Counter((a[1:], b[1:]) for a, b in zip(steps, steps[1:], strict=False))
    degree = Counter(node for edge in edges for node in edge)
    worth = np.zeros(max(0, n - length))
    for a, b in zip(steps, steps[1:], strict=False):
        worth[a[0]] += edges[a[1:], b[1:]] * (degree[a[1:]] - 1)
    normal = np.array([worth[max(0, t - query + 1) : t + 1].mean() if len(worth[max(0, t - query + 1) : t + 1]) else np.nan for t in range(n)])
    most = np.nanmax(normal) if np.isfinite(normal).any() else 0
    return edges, np.where(np.isfinite(normal), 1 - normal / most, 0) if most > 0 else np.zeros(n)


@pytest.mark.parametrize("projection,length,smooth,rays,bins", [("fourier", 8, 2, 24, 64), ("fourier", 12, 4, 7, 16), ("pca", 10, 3, 24, 64), ("pca", 9, 1, 50, 128)])
def test_shape_graph_of_one_series(spark, projection, length, smooth, rays, bins):
    rng = np.random.default_rng(length)
    x = np.round(np.sin(np.arange(300) / 4) + 0.1 * rng.standard_normal(300) + np.where(np.arange(300) // 10 == 17, 2, 0), 3)
    df = table(spark, {1: x.tolist(), 2: [1.0] * 30, 3: [5.0, 1.0]})
    edges, want = plain_graph(x, length, smooth, rays, bins, 2 * length, None if projection == "fourier" else True)
    got = graphs.shape_edges(graphs.shape_path(df, ONE, length, smooth, rays, bins, projection)).where("sample = 1").collect()
    assert {((r.from_ray, r.from_bin), (r.to_ray, r.to_bin)): r.weight for r in got} == dict(edges)
    found = scores(graphs.series2graph(df.repartition(7), ONE, length, smooth, rays=rays, bins=bins, projection=projection))
    assert np.allclose(found[1], want) and not found[2].any() and not found[3].any()
    assert max(found[1][170:190]) > np.quantile(found[1], 0.9)


def test_shape_graph_of_odd_series(spark):
    spec = SeriesSpec(("col_1", "a"))
    df = table(spark, {1: [(math.sin(t), None) for t in range(60)], 2: [(None, None)] * 12, None: [(t % 5, t % 7) for t in range(50)]}, spec).withColumn("score", F.lit("x"))
    for projection in ("pca", "fourier"):
        got = graphs.series2graph(df, spec, projection=projection)
        assert got.count() == 122 and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert graphs.series2graph(df.where("false"), spec, projection=projection).count() == 0
    with pytest.raises(ValueError, match="running sums"):
        graphs.series2graph(df, spec, length=4, smooth=3)


# ---- networks ------------------------------------------------------------------------------------------------------


def numeric_gradients(loss, weights, names, eps=1e-6):
    out = {}
    for k in names:
        g = np.zeros_like(weights[k])
        for at in np.ndindex(g.shape):
            near = {n: v.copy() for n, v in weights.items()}
            near[k][at] += eps
            high = loss(near)
            near[k][at] -= 2 * eps
            g[at] = (high - loss(near)) / (2 * eps)
        out[k] = g
    return out


def check_gradients(network, x, turn=3, names=None):
    weights = network.start(np.random.default_rng(5), x.shape[1], x.shape[2])
    for which, (_, wanted) in enumerate(network.losses({k: Node(v) for k, v in weights.items()}, x, turn)):
        p = {k: Node(v) for k, v in weights.items()}
        top, _ = network.losses(p, x, turn)[which]
        tape.backward(top)
        some = [k for k in wanted if names is None or k in names]
        plain = numeric_gradients(lambda w: float(network.losses({k: Node(v) for k, v in w.items()}, x, turn)[which][0].value), weights, some)
        for k in some:
            assert np.allclose(p[k].grad, plain[k], rtol=1e-4, atol=1e-6), k


def test_tape_against_differences():
    rng = np.random.default_rng(0)
    a, b, c = rng.standard_normal((2, 3, 4)), rng.standard_normal((4, 5)), rng.standard_normal(5)

    def made(p):
        y = tape.softmax(tape.tanh(p["a"] @ p["b"] + p["c"]))
        z = tape.joined([y[:, :, 1:3], tape.sigmoid(p["a"].swap(1, 2).reshape(2, 3, 4))[:, :, :2] * p["c"][:2]], 2)
        return (tape.squares(z - 0.3) * tape.exp(p["c"][1:2])).sum() + tape.relu(p["b"]).sum()

    weights = {"a": a, "b": b, "c": c}
    p = {k: Node(v) for k, v in weights.items()}
    tape.backward(made(p))
    plain = numeric_gradients(lambda w: float(made({k: Node(v) for k, v in w.items()}).value), weights, weights)
    for k in weights:
        assert np.allclose(p[k].grad, plain[k], atol=1e-6), k


def test_network_gradients():
    x = np.random.default_rng(1).random((6, 4, 2))
    check_gradients(networks.AutoEncoder((7, 3)), x)
    check_gradients(networks.AutoEncoder((5,), unit=True), x)
    check_gradients(networks.Usad(6, 3, rounds=2), x)
    check_gradients(recurrent.Forecaster(2, hidden=3, layers=2), x)
    check_gradients(recurrent.EncoderForecaster(1, hidden=3, layers=1), x)
    check_gradients(recurrent.SequenceAutoEncoder(3), x)
    check_gradients(recurrent.Tranad(4, rounds=2), x)
    check_gradients(recurrent.Catch(2, size=4), np.random.default_rng(2).random((3, 6, 3)))


def waves(samples, n, features=1, seed=0):
    rng = np.random.default_rng(seed)
    out = {}
    for s in range(samples):
        t = np.arange(n) + rng.integers(100)
        out[s] = np.stack([np.sin(t / (3 + k)) + 0.05 * rng.standard_normal(n) for k in range(features)], axis=1)
    return out


def test_window_blocks_hold_every_window_once(spark):
    spec = SeriesSpec(("col_1", "b"))
    series = {1: [(t, -t) for t in range(25)], 2: [(t * t, None if t == 3 else 1) for t in range(7)], 3: [(1, 2)] * 4, None: [(5 * t, t) for t in range(9)]}
    df = table(spark, series, spec).repartition(5)
    for length, block in ((5, 8), (1, 4), (7, 7), (5, 512)):
        blocks = networks.window_blocks(df, spec, length, batches=3, block=block)
        got = sorted(((str(r["sample"]), r.begin + k, x.tolist()) for r in blocks.table.collect() for k, x in enumerate(np.lib.stride_tricks.sliding_window_view(np.array(r["values"]).reshape(-1, 2), length, axis=0).swapaxes(1, 2))), key=str)
        filled = {s: np.array([[v if v is not None else 1 for v in row] for row in x], float) for s, x in series.items()}
        assert got == sorted(((str(s), t, x[t : t + length].tolist()) for s, x in filled.items() for t in range(len(x) - length + 1)), key=str)


@pytest.mark.parametrize("network,scaling", [(networks.AutoEncoder((8, 3)), "all"), (networks.Usad(8, 3), "range")])
def test_training_is_that_of_one_process(spark, network, scaling):
    """The same losses and weights as plain numpy, at 1 and at 8 tasks, and with gradients that tasks add up first."""
    series = waves(9, 60)
    df = table(spark, {s: x[:, 0].tolist() for s, x in series.items()})
    shared = networks.window_blocks(df, ONE, 6, scaling, batches=2, block=20)
    rows = shared.table.select("batch", "values").collect()
    parts = [np.concatenate([np.lib.stride_tricks.sliding_window_view(np.array(r["values"])[:, None], 6, axis=0).swapaxes(1, 2) for r in rows if r.batch == k]) for k in range(2)]
    weights, adam, history = network.start(np.random.default_rng(1), 6, 1), networks.Adam(0.02), []
    for turn in range(8):
        s, g = networks.gradients(network, weights, parts[turn % 2], turn)
        n = len(parts[turn % 2])
        history.append([v / n for v in s])
        weights = adam.step(weights, {k: v / n for k, v in g.items()})
    whole = shared.table
    for n, few in ((1, 16), (8, 16), (8, 1)):
        shared.table = written(whole.repartition(n), "test-blocks")
        networks.FEW = few
        got = networks.train(shared, network, 8, 0.02)
        networks.FEW = 16
        assert np.allclose(got.history, history, rtol=1e-9)
        assert all(np.allclose(got.weights[k], weights[k], rtol=1e-7, atol=1e-9) for k in weights)
    assert scaling == "range" or history[-1][0] < history[0][0]  # the other one is a contest


@pytest.mark.parametrize("make,features", [(networks.autoencoder, 1), (networks.usad, 1), (networks.usad, 2), (partial(networks.window_mean_autoencoder, hidden=1), 2), (recurrent.lstm_detector, 1), (recurrent.tranad, 2)])
def test_network_detectors(spark, make, features):
    series = waves(6, 150, features, seed=3)
    for s in range(6):
        series[s][80 + s : 84 + s] += 3
    spec = SeriesSpec(tuple(f"col_{k + 1}" for k in range(features)))
    data = {s: [tuple(r) for r in x.tolist()] for s, x in series.items()} | {90: [(None,) * features] * 30, 91: [(1.0,) * features] * 3}
    df = table(spark, data, spec)
    got = make(df, spec, batches=1)
    assert got.count() == df.count() and got.where("score IS NULL").count() == 0
    found = scores(got)
    assert sum(70 + s <= int(found[s].argmax()) <= 105 + s for s in range(6)) >= 5
    assert not found[91].any()
    assert make(df.where("false"), spec).count() == 0


@pytest.mark.parametrize("repair", [partial(networks.cae_m_repair, latent=2), partial(recurrent.lstm_sequence_repair, hidden=8)])
def test_reconstruction_repairs(spark, repair):
    clean = waves(12, 100, 2, seed=4)
    dirty = {s: [list(r) for r in x.tolist()] for s, x in clean.items()}
    wrong = [(s, 20 + 3 * s + k) for s in (1, 5, 9) for k in range(2)]
    for s, t in wrong:
        dirty[s][t][0] += 6
    for s in dirty:
        dirty[s][90][1] = None
    spec = SeriesSpec(("col_1", "col_2"))
    df = table(spark, dirty | {77: [[1.0, None], [2.0, 3.0]]}, spec)
    got = {(r.sample_id, r.t): (r.col_1, r.col_2) for r in repair(df, spec, batches=1).collect()}
    assert len(got) == 1202 and all(v is not None for r in got.values() for v in r)
    off = sum(abs(got[s, t][0] - clean[s][t, 0]) for s, t in wrong)
    assert off < 0.4 * 6 * len(wrong)
    assert 0.9 * 1200 <= sum(got[s, t] == tuple(dirty[s][t]) for s in range(12) for t in range(100)) <= 0.97 * 1200
    assert got[77, 1] == (2.0, 3.0) and got[77, 0][0] == 1.0


def test_lstm_forecasts_better_than_a_line(spark):
    """The logistic map: what follows is a parabola of what is, so that no linear map tells more than the mean."""
    def logistic(seed, n):
        x = [0.1 + 0.07 * seed]
        while len(x) < n:
            x.append(3.9 * x[-1] * (1 - x[-1]))
        return x

    fitted, judged = (table(spark, {s: logistic(s, 300) for s in some}) for some in (range(8), range(8, 11)))
    line = policy.linear_forecast_score(fitted, judged, ONE, 4, 1)
    trained, blocks = recurrent.fit_forecaster(fitted, ONE, 4, 1, hidden=16, rounds=120, rate=0.05, batches=1)
    got = recurrent.forecast_score(trained, blocks, judged, ONE)
    assert trained.history[-1][0] < 0.3 * trained.history[0][0] and got > line + 0.1
    # the score by hand
    p, v = [], []
    for s in range(8, 11):
        x = np.array(logistic(s, 300))
        for t in range(0, 296, 5):
            known = ((x[t : t + 4] - blocks.centre) / blocks.spread).reshape(1, 4, 1)
            p.append(trained.network.forecast(trained.nodes(), known).value[0, 0, 0] * blocks.spread[0] + blocks.centre[0])
            v.append(x[t + 4])
    p, v = np.array(p), np.array(v)
    assert abs(got - (0.6 * math.exp(-math.sqrt(((p - v) ** 2).mean()) / (v.std() + 1e-8)) + 0.4 * (np.corrcoef(p, v)[0, 1] + 1) / 2)) < 1e-6
    assert recurrent.forecast_score(trained, blocks, judged.where("t < 3"), ONE) == 0.0


def test_catch_finds_a_broken_correlation(spark):
    """Channels that follow one another part for a while, each looking as ever: principal components of windows tell less of that (VUS-PR on the harness's metric)."""
    rng = np.random.default_rng(8)
    n, data, labels = 400, {}, []
    for s in range(6):
        base = np.convolve(rng.standard_normal(n + 40), np.ones(6) / 2.4, "same")
        other = np.convolve(rng.standard_normal(n + 40), np.ones(6) / 2.4, "same")
        x = np.stack([base[:n], 0.8 * base[:n], -base[:n]], axis=1) + 0.05 * rng.standard_normal((n, 3))
        at = 150 + 30 * s
        x[at : at + 40, 1] = 0.8 * other[at : at + 40]
        data[s] = [tuple(r) for r in x.tolist()]
        labels += [(s, t, int(at <= t < at + 40)) for t in range(n)]
    spec = SeriesSpec(("col_1", "col_2", "col_3"))
    df = table(spark, data, spec)
    label = spark.createDataFrame(labels, "sample_id long, t long, label int")
    share = lambda found: metrics.detection_metrics(found.join(label, ["sample_id", "t"]), spec).agg(F.avg("vus_pr")).first()[0]
    got = share(recurrent.catch(df, spec, window=16, batches=1))
    assert got > share(detect.pca(df, spec, 16)) and got > share(detect.pca(df, spec, 1))


# ---- shapes --------------------------------------------------------------------------------------------------------


def plain_correlation(x, y):
    """(greatest normalised cross-correlation, shift) by trying all shifts."""
    n = len(x)
    best = (-np.inf, 0)
    for s in range(-(n - 1), n):
        v = sum(x[t + s] * y[t] for t in range(n) if 0 <= t + s < n)
        if v > best[0] + 1e-9:
            best = (v, s)
    norm = np.linalg.norm(x) * np.linalg.norm(y)
    return (best[0] / norm if norm else 0.0), best[1]


def test_shape_distance_by_all_shifts():
    rng = np.random.default_rng(3)
    x, y = kshape.standard(rng.standard_normal((20, 11))), kshape.standard(rng.standard_normal((4, 11)))
    x[3] = 0
    near, shift = kshape.correlations(x, y)
    for i in range(20):
        for j in range(4):
            v, s = plain_correlation(x[i], y[j])
            assert abs(near[i, j] - v) < 1e-9 and (i == 3 or shift[i, j] == s)
    moved = kshape.aligned(x, np.array([2] * 10 + [-3] * 10))
    assert (moved[0, :9] == x[0, 2:]).all() and not moved[0, 9:].any() and (moved[15, 3:] == x[15, :-3]).all()


def test_k_shape_is_that_of_one_process(spark):
    series = waves(8, 90, seed=6)
    df = table(spark, {s: (np.sign(x) if s % 2 else x)[:, 0].tolist() for s, x in series.items()})
    blocks = networks.window_blocks(df, ONE, 16, block=40)
    shapes, sums = kshape.k_shape(blocks, 3, stride=3, rounds=4)
    # the last round by hand: windows to the nearest of the shapes that it was started with
    rows = blocks.table.collect()
    x = kshape.standard(np.array([w for r in rows for k, w in enumerate(np.lib.stride_tricks.sliding_window_view(np.array(r["values"]), 16)) if (r.begin + k) % 3 == 0]))
    near, shift = kshape.correlations(x, shapes)
    label = near.argmax(axis=1)
    take = lambda v: np.take_along_axis(v, label[:, None], axis=1)[:, 0]
    plain = kshape.Sums.of(kshape.cluster_sums(x, label, shapes, take(shift), take(near)), len(shapes), 16)
    assert sums.n.sum() == len(x) == 8 * 25 and sums.n.tolist() == plain.n.tolist()
    for a in ("far", "total", "products"):
        assert np.allclose(getattr(sums, a), getattr(plain, a))
    blocks.table = written(blocks.table.repartition(7), "test-blocks")
    assert np.allclose(kshape.k_shape(blocks, 3, stride=3, rounds=4)[0], shapes, atol=1e-6)
    best = kshape.shape_of(sums.products[0], sums.total[0])
    mine = kshape.aligned(x[label == 0], take(shift)[label == 0])
    mine = mine - mine.mean(axis=1, keepdims=True)
    assert ((mine @ best) ** 2).sum() >= max(((mine @ kshape.standard(v)) ** 2).sum() for v in [*mine, shapes[0]]) - 1e-6


def test_sand_batches_and_stream_agree(spark, tmp_path):
    series = {s: x[:, 0].tolist() for s, x in waves(4, 240, seed=7).items()}
    for s in range(4):
        series[s][200 + 4 * s : 206 + 4 * s] = [2.0, -2.0] * 3
    df = table(spark, series)
    parts = [df.where(F.col("t").between(80 * k, 80 * k + 79)).orderBy("sample_id", "t") for k in range(3)]
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    how = dict(length=16, pattern=6, k=3, stride=2, rounds=4)
    want, models = [], []
    for scored, model in kshape.sand_batches(parts, ONE, **how):
        want += [(r.sample_id, r.t, round(r.score, 6)) for r in scored.collect()]
        models.append(model)
    assert len(want) == 960 and models[-1].batch == 3 and sum(models[-1].n) == 3 * 4 * 33
    top = sorted(want, key=lambda r: -r[2])[:20]
    assert sum(195 + 4 * s <= t <= 222 + 4 * s for s, t, _ in top) >= 15
    files = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = kshape.sand_stream(files, ONE, f"file://{tmp_path}/out", **how).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.sample_id, r.t, round(r.score, 6)) for r in spark.read.parquet(f"file://{tmp_path}/out/scores").collect()]
    assert sorted(got) == sorted(want)
    last = kshape.ShapeModel.load(spark, f"file://{tmp_path}/out/models", 3)
    assert np.allclose(last.shapes, models[-1].shapes, atol=1e-6) and np.allclose(last.weight, models[-1].weight)


def test_sand_of_odd_series(spark):
    df = table(spark, {1: [math.sin(t / 3) for t in range(100)], 2: [None] * 50, 3: [1.0], None: [float(t % 4) for t in range(64)]})
    got = kshape.sand(df, ONE, 6)
    assert got.count() == 215 and got.where("score IS NULL OR isnan(score)").count() == 0
    assert kshape.sand(df.where("false"), ONE, 6).count() == 0


# ---- support vectors -----------------------------------------------------------------------------------------------


def check_conditions(machine, x, y, at, beta, level, n):
    """Every row's optimality condition, with its own coefficient."""
    own = np.zeros(len(x))
    for a, b in zip(at, beta, strict=True):
        own[int(np.abs(x - a).sum(axis=1).argmin())] += b
    g = machine.gap(x, y, at, beta, level)
    assert machine.broken(g, own, n, level).max() <= 1.5e-3
    return own


def test_tube_meets_its_conditions(spark):
    rng = np.random.default_rng(4)
    series = {s: (np.sin(np.arange(n) / 9) + 0.3 * rng.standard_normal(n) + np.where(np.arange(n) % 37 == 5, 4, 0)).tolist() for s, n in ((1, 400), (2, 150), (3, 2))}
    df = table(spark, {s: [(t / 20, v) for t, v in enumerate(x)] for s, x in series.items()}, SeriesSpec(("a", "b")))
    blocks = networks.window_blocks(df, SeriesSpec(("a", "b")), 1, block=50)
    machine = svm.Tube(1.0, 0.1, 1.0)
    objective = []
    for parts in (1, 7):
        blocks.table = written(blocks.table.repartition(parts), "test-blocks")
        got = {r.s: r for r in svm.fit(blocks, machine, svm._pair).collect()}
        assert sorted(got) == [1, 2, 3]
        for s, r in got.items():
            x, y = np.arange(len(series[s]))[:, None] / 20, np.array(series[s])
            beta = check_conditions(machine, x, y, np.array(r["at"])[:, None], np.array(r.beta), r.level, len(x))
            assert np.abs(beta).max() <= 1 and 0 < len(r.beta) <= len(x)
            k = svm.gaussian(x, x, 1.0) + 1
            objective.append(0.5 * beta @ k @ beta - y @ beta + 0.1 * np.abs(beta).sum())
            whole, _ = machine.solve(x, y, np.zeros(len(x)), len(x), 5e-4)
            assert abs(objective[-1] - (0.5 * whole @ k @ whole - y @ whole + 0.1 * np.abs(whole).sum())) < 1e-2
    assert np.allclose(objective[:3], objective[3:], atol=5e-3)


@pytest.mark.parametrize("nu", [0.1, 0.5])
def test_one_class_meets_its_conditions(spark, nu):
    series = {s: x[:, 0] for s, x in waves(3, 200, seed=9).items()}
    series[1][90:95] += 2
    df = table(spark, {s: x.tolist() for s, x in series.items()} | {8: [1.0] * 5, 9: [2.0] * 40})
    blocks, machine = networks.window_blocks(df, ONE, 10, block=60), svm.OneClass(nu, 0.1)
    got = {r.s: r for r in svm.fit(blocks, machine, svm.unit_windows).collect()}
    assert sorted(got) == [0, 1, 2, 9]
    for s in range(3):
        x, _ = svm.unit_windows(np.lib.stride_tricks.sliding_window_view(series[s], 10)[:, :, None])
        r = got[s]
        beta = check_conditions(machine, x, np.zeros(len(x)), np.array(r["at"]).reshape(-1, 10), np.array(r.beta), r.level, len(x))
        below = (machine.value(x, np.array(r["at"]).reshape(-1, 10), np.array(r.beta), 0) < r.level - 2e-3).mean()
        assert abs(beta.sum() - 1) < 1e-9 and below <= nu + 0.02 and (beta > 0).mean() >= nu - 0.02
    found = scores(svm.one_class(df, ONE, 10, nu))
    assert 80 <= int(found[1].argmax()) <= 105 and not found[8].any() and np.allclose(found[9], 0, atol=2e-3)
    assert svm.one_class(df.where("false"), ONE, 10).count() == 0


def test_tube_repair(spark):
    rng = np.random.default_rng(5)
    clean = np.sin(np.arange(120) / 15)
    y = clean + 0.05 * rng.standard_normal(120)
    y[[30, 31, 70]] += 5
    spec = SeriesSpec(("col_1", "col_2"))
    df = table(spark, {1: [(float(v), None if t == 4 else 2.0) for t, v in enumerate(y)], 2: [(1.0, 2.0)], None: [(3.0, None), (4.0, None)]}, spec)
    got = svm.tube_repair(df, spec)
    assert sorted(got.columns) == sorted(df.columns)
    rows = {(r.sample_id, r.t): (r.col_1, r.col_2) for r in got.collect()}
    assert len(rows) == 123 and rows[2, 0] == (1.0, 2.0) and rows[None, 0][1] == 0.0
    fitted = np.array([rows[1, t][0] for t in range(120)])
    assert np.abs(fitted - clean)[5:-5].mean() < 0.15 and np.abs(fitted - clean)[[30, 70]].max() < 1.0
    assert all(rows[1, t][1] == 2.0 for t in range(120))


# ---- queries -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry_models.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = registry_models.QUERIES[name](spark, sf).toPandas(), duck.execute(registry_models.ORACLE_SQL[name]).df()
    assert len(got) > 0 and normal(got) == normal(want)


def test_harness_knows_learned_detectors(spark):
    series = {s: [(v, int(80 + s <= t < 84 + s)) for t, v in enumerate(np.where((np.arange(120) >= 80 + s) & (np.arange(120) < 84 + s), 5.0, x[:, 0]).tolist())] for s, x in waves(3, 120, seed=2).items()}
    df = table(spark, series, SeriesSpec(("col_1", "label"))).withColumn("label", F.col("label").cast("int"))
    got = harness.score_table(df, ONE, ["Series2Graph", "OCSVM", "GARCH"], most=200).collect()
    assert len(got) == 3 and all(0 <= r[n] <= 1 for r in got for n in ("Series2Graph", "OCSVM", "GARCH"))
    assert set(learned.DETECTORS) <= set(harness.POOL)


def test_tubes_side_by_side_are_what_each_is_alone(monkeypatch):
    rng = np.random.default_rng(4)
    sets = []
    for n in (30, 12, 1, 25, 40):
        x = np.linspace(-1.7, 1.7, n)[:, None]
        sets.append((x, np.sin(3 * x[:, 0]) + 0.3 * rng.standard_normal(n), np.zeros(n), float(n)))
    machine = svm.Tube()
    plain = [machine.solve(x, y, beta.copy(), n, 5e-4)[0] for x, y, beta, n in sets]
    monkeypatch.setattr(svm.Tube, "solve", None)  # none is solved alone
    for want, (found, level) in zip(plain, machine.solve_many(sets, 5e-4), strict=True):
        assert np.array_equal(want, found) and level == 0.0


@pytest.mark.parametrize("masked", [False, True])
def test_attention_is_one_node(masked):
    """F8, F11: attention and a linear layer are a node each; values and gradients are those of the formulas."""
    rng = np.random.default_rng(6)
    q, k, v, m = (tape.Node(rng.normal(size=s)) for s in ((6, 3, 4), (6, 5, 4), (6, 5, 4), (2, 3, 5)))
    w = tape.Node(rng.normal(size=(5, 2)))
    parts = [q, k, v] + [m] * masked

    def plain(q, k, v, m=np.zeros((1, 3, 5)), w=w.value):
        cut = lambda x: x.reshape(6, -1, 2, 2).swapaxes(1, 2)
        logits = cut(q) @ cut(k).swapaxes(2, 3) / np.sqrt(2) + np.tile(m, (6 // len(m), 1, 1))[:, None]
        e = np.exp(logits)
        return (e / e.sum(3, keepdims=True) @ cut(v)).swapaxes(1, 2).reshape(6, 3, 4) @ w[:-1] + w[-1]

    found = tape.looked(q, k, v, 2, m if masked else None)
    out = tape.linear(found, w)
    assert [p for p, _ in found.parents] == parts and {id(p) for p, _ in out.parents} == {id(found), id(w)}
    values = [p.value for p in parts]
    np.testing.assert_allclose(out.value, plain(*values), rtol=1e-12)
    tape.backward(tape.squares(out).sum())
    for n, p in enumerate([*parts, w]):
        for at in np.ndindex(*p.value.shape):
            both = []
            for step in (1e-6, -1e-6):
                moved = [x.value.copy() for x in [*parts, w]]
                moved[n][at] += step
                both.append((plain(*moved[:-1], w=moved[-1]) ** 2).sum())
            assert p.grad[at] == pytest.approx((both[0] - both[1]) / 2e-6, rel=1e-4, abs=1e-6)


def test_constants_have_no_gradients():
    """F8, F11: what isn't a node takes no part in the backward pass."""
    x = tape.Node([1.0, 2.0])
    assert all(len(y.parents) == 1 for y in (x + 1.0, x - np.ones(2), x * 3.0))
