"""A cleaning pipeline found by two levels of tabular Q-learning: what to treat next, and with which repair.

The driver holds Q tables and a handful of numbers for each step; series stay in tables. Each step is one repair and one pass for rates. Tables of steps are written in the shared folder, so lineage never grows.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.functions.scaling import sanitise
from seriesmend.operators import constrained, constraints, detect, missing, repair
from seriesmend.runtime import arrow_map, shared_dir
from seriesmend.spec import SeriesSpec

MACRO = ("MISSING", "OUTLIER", "CONSTRAINT", "FINISH")
LOW: dict[str, list[str]] = {"MISSING": list(repair.MISSING_REPAIRS), "OUTLIER": list(repair.OUTLIER_REPAIRS), "CONSTRAINT": list(constrained.CONSTRAINT_REPAIRS)}


def supervised(df: DataFrame, spec: SeriesSpec, window: int = 30, horizon: int = 10, stride: int = 5) -> DataFrame:
    """(sample, t, x, y): windows of `window` steps, each with the `horizon` after it, as flat arrays; every stride-th start."""
    row = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in spec.features])
    w = spec.ordered
    rows = df.select(*spec.keys, F.collect_list(row).over(w.rowsBetween(0, window - 1)).alias("x"), F.collect_list(row).over(w.rowsBetween(window, window + horizon - 1)).alias("y"))
    return rows.where((F.size("x") == window) & (F.size("y") == horizon) & (F.col(spec.t) % stride == 0)).select(*spec.keys, F.flatten("x").alias("x"), F.flatten("y").alias("y"))


#: Rows that are cut into windows at once, at least.
CUT = 8192


def window_products(df: DataFrame, spec: SeriesSpec, window: int = 30, horizon: int = 10, stride: int = 5, side: Column | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """side -> (number, sums of products) of its windows as `supervised` has them, each with a 1 behind it. Rows of a sample are on one side (0) or, by a column that never falls with t, on several (a window has rows of one side alone).

    Windows aren't tables: a task gets its samples' rows sorted, cuts many samples' rows at once, and sends one matrix of (window + horizon) x features for each side, whatever its rows."""
    wide, size = len(spec.features), window + horizon
    cells = size * wide + 1
    schema = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("products", T.BinaryType())])

    def sent(found: dict):
        yield {"side": list(found), "n": [n for n, _ in found.values()], "products": [total.tobytes() for _, total in found.values()]}

    def added(batches):
        found: dict[int, tuple[int, np.ndarray]] = {}
        held, rows = [], 0

        def take() -> list[pa.RecordBatch]:
            """Adds up the windows of the rows held; what later ones begin with stays."""
            table = pa.Table.from_batches(held)
            codes = table.column(0).combine_chunks()
            codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).dictionary_encode(null_encoding="encode").indices.to_numpy()
            t, sides = table.column(1).to_numpy(), table.column(2).to_numpy()
            values = np.stack([table.column(3 + k).to_numpy() for k in range(wide)], axis=1)
            last = len(table) - size + 1
            if last <= 0:
                return held
            good = np.flatnonzero((codes[:last] == codes[size - 1 :]) & (sides[:last] == sides[size - 1 :]) & (t[:last] % stride == 0))
            windows = np.lib.stride_tricks.sliding_window_view(values, size, axis=0)
            for k in np.unique(sides[good]).tolist():
                starts = good[sides[good] == k]
                for chunk in np.array_split(starts, -(-len(starts) // CUT)):
                    z = np.hstack([windows[chunk].swapaxes(1, 2).reshape(len(chunk), -1), np.ones((len(chunk), 1))])
                    n, total = found.get(k, (0, 0.0))
                    found[k] = n + len(z), total + z.T @ z
            return table.slice(last).combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CUT:
                held = take()
                rows = sum(b.num_rows for b in held)
        if held:
            take()
        yield from sent(found)

    def together(batches):
        found: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for k, m, raw in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                n, total = found.get(k, (0, 0.0))
                found[k] = n + m, total + np.frombuffer(raw).reshape(cells, cells)
        yield from sent(found)

    rows = df.select(*spec.keys, (F.lit(0) if side is None else side).cast("int").alias("__side"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in spec.features])
    parts = arrow_map(rows.repartition(spec.sample).sortWithinPartitions(*spec.keys), added, schema)
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in arrow_map(parts.repartition(8), together, schema).collect():  # a matrix for each task, then 8
        n, total = out.get(r["side"], (0, 0.0))
        out[r["side"]] = n + r["n"], total + np.frombuffer(r["products"]).reshape(cells, cells)
    return out


def linear_forecast_score(train: DataFrame, test: DataFrame, spec: SeriesSpec, window: int = 30, horizon: int = 10) -> float:
    """0.6 exp(-nrmse) + 0.4 (corr + 1) / 2 of a ridge map from windows to what follows (a linear forecaster has no more to it), fitted and judged on all windows. The map needs sums of products alone."""
    none = (0, np.zeros(()))
    return score_of_products(*(window_products(d, spec, window, horizon).get(0, none) for d in (train, test)), window * len(spec.features), horizon * len(spec.features))


def score_of_products(fitted: tuple[int, np.ndarray], judged: tuple[int, np.ndarray], p: int, q: int) -> float:
    """linear_forecast_score from both tables' window_products: p cells of a window, q of what follows."""
    (n, a), (m, b) = fitted, judged
    if n < 5 or m < 2:
        return 0.0
    x, y, one = slice(0, p), slice(p, p + q), p + q
    mean, middle = a[x, one] / n, a[y, one] / n
    spread = np.sqrt(np.maximum(np.diag(a)[x] / n - mean**2, 0)) + 1e-8
    cov = (a[x, x] - n * np.outer(mean, mean)) / np.outer(spread, spread)
    coef = np.linalg.solve(cov + np.eye(p), (a[x, y] - n * np.outer(mean, middle)) / spread[:, None])
    # prediction = (x - mean) / spread @ coef + middle = [x, 1] @ line
    line = np.vstack([coef / spread[:, None], middle - mean / spread @ coef])
    rows = np.r_[np.arange(p), one]
    xx, xy, yy = b[np.ix_(rows, rows)], b[rows, y], np.diag(b)[y]
    cells = m * q
    sp, sv = (b[one, rows] @ line).sum(), b[one, y].sum()
    spp, spv, svv = (line * (xx @ line)).sum(), (line * xy).sum(), yy.sum()
    var_p, var_v = max(spp / cells - (sp / cells) ** 2, 0.0), max(svv / cells - (sv / cells) ** 2, 0.0)
    both = spv / cells - sp / cells * (sv / cells)
    nrmse = np.sqrt(max(spp - 2 * spv + svv, 0.0) / cells) / (np.sqrt(var_v) + 1e-8)
    corr = both / np.sqrt(var_p * var_v) if var_p > 0 and var_v > 0 else 0.0
    return float(0.6 * np.exp(-nrmse) + 0.4 * (np.clip(corr, -1, 1) + 1) / 2)


@dataclass
class Environment:
    """The state of one cleaning run. performance: score of a table for the task (default: linear forecasting on the last 30 % of time)."""

    dirty: DataFrame
    spec: SeriesSpec
    rules: constraints.Constraints
    detectors: list[str] = field(default_factory=lambda: ["ZScore"])
    performance: Callable[[DataFrame], float] | None = None
    most_steps: int = 20
    train_share: float = 0.7

    def __post_init__(self):
        shared_dir(self.dirty.sparkSession)
        self.dirty = self.dirty.checkpoint()
        self.performance = self.performance or self._forecast
        self._start: tuple = (None,)
        self.reset()

    def _forecast(self, df: DataFrame) -> float:
        """Windows of both sides of the cut (the least t with train_share of a sample's rows up to it) from one pass."""
        cut = F.greatest(F.ceil(F.lit(self.train_share) * F.count("*").over(self.spec.whole)), F.lit(1)) - 1
        place = F.row_number().over(self.spec.ordered) - 1
        got = window_products(df, self.spec, side=(place > cut).cast("int"))
        none, wide = (0, np.zeros(())), len(self.spec.features)
        return score_of_products(got.get(0, none), got.get(1, none), 30 * wide, 10 * wide)

    def reset(self) -> None:
        """Back to the dirty table, which is measured once."""
        self.now, self.step, self.history = self.dirty, 0, []
        how = (self.performance, tuple(self.detectors), repr(self.rules))
        if self._start[0] != how:
            self._measure()
            self._start = how, self.full, self.rates, self.performance(self.full), self._known
        _, self.full, self.rates, self.last, self._known = self._start
        self.first = self.last

    def _measure(self) -> None:
        """The rates of `now`, its filled table, written once for all that reads it, and nothing known as yet of its shape."""
        self._known: dict = {}
        missing_rate = self._missing(self.now)
        self.full = self._filled(self.now).checkpoint() if missing_rate else self.now
        self.rates = self.issue_rates(self.now, missing_rate, self.full)

    def _filled(self, df: DataFrame) -> DataFrame:
        return missing.impute_linear(df, self.spec)

    def _missing(self, df: DataFrame) -> float:
        cells = [F.avg(F.col(c).isNull().cast("double")) for c in self.spec.features]
        return df.agg((sum(cells[1:], cells[0]) / len(cells)).alias("m")).first()["m"] or 0.0

    def issue_rates(self, df: DataFrame, missing_rate: float | None = None, full: DataFrame | None = None) -> dict[str, float]:
        """Missing, outlier and violation rates, and those by kind, over all samples (samples without any count as 0)."""
        spec = self.spec
        miss = self._missing(df) if missing_rate is None else missing_rate
        full = self._filled(df) if full is None else full
        found = detect.flag(detect.ensemble_scores(full, spec, self.detectors), spec)
        out = found.agg(F.avg(F.col("is_outlier").cast("double"))).first()[0] or 0.0
        kinds = constraints.mean_rates(full, spec, self.rules)
        return {"MISSING": miss, "OUTLIER": out, "CONSTRAINT": kinds.pop("all", 0.0), **{f"rate_{k}": v for k, v in kinds.items()}}

    def state_high(self) -> tuple:
        worst = max(("MISSING", "OUTLIER", "CONSTRAINT"), key=lambda k: self.rates[k])
        last = self.history[-1][0] if self.history else "-"
        return worst, round(self.last, 1), round(self.step / self.most_steps, 1), last

    def state_low(self, macro: str) -> tuple:
        """Skewness and kurtosis (means over features), and the rate of the kind that is treated."""
        if "shape" not in self._known:
            self._known["shape"] = mean_shape(self.now, self.spec)
        return (macro, *(round(v, 0) for v in self._known["shape"]), round(self.rates[macro], 1))

    def apply(self, macro: str, low: str) -> DataFrame:
        if macro == "MISSING":
            return repair.MISSING_REPAIRS[low](self.now, self.spec)
        full = self.full
        return repair.OUTLIER_REPAIRS[low](full, self.spec) if macro == "OUTLIER" else constrained.CONSTRAINT_REPAIRS[low](full, self.spec, self.rules)

    def act(self, macro: str, low: str) -> tuple[float, float]:
        """(reward of the repair, reward of the choice): structure, size of the change, fall of the rate and the task's performance; then fall of all rates, and a price for a third turn of the same."""
        before, rates, was = self.now, dict(self.rates), self._structure()
        self.now = self.apply(macro, low).select(*before.columns).checkpoint()
        self.step += 1
        self._measure()
        perf = self.performance(self.full)
        j = before.alias("a").join(self.now.alias("b"), self.spec.keys)
        change = self._mean(j.agg(*[F.sqrt(F.avg((F.col(f"a.{f}") - F.col(f"b.{f}")) ** 2)) / F.greatest(F.stddev_pop(f"a.{f}"), F.lit(1e-8)) for f in self.spec.features]).first())
        now = self._structure()
        gain = (now - was) / max(abs(now), abs(was), 1e-6)
        low_reward = 0.2 * gain - 0.2 * min(change, 1.0) + 0.2 * (rates[macro] - self.rates[macro]) + 0.4 * (perf - self.last)
        drop = sum(rates[k] - self.rates[k] for k in MACRO[:3])
        self.history.append((macro, low))
        again = len(self.history) >= 3 and len(set(self.history[-3:])) == 1
        self.last = perf
        return float(low_reward), float(0.4 * low_reward + 0.5 * drop - 0.1 / self.most_steps - 5.0 * again)

    def _mean(self, values) -> float:
        return sum(float(v or 0.0) for v in values) / len(self.spec.features)

    def _structure(self) -> float:
        """How smooth the table is: 0 at best."""
        if "structure" not in self._known:
            w = self.spec.ordered
            near = lambda f: (F.coalesce(F.lag(f).over(w), F.lit(0.0)) + F.col(f) + F.coalesce(F.lead(f).over(w), F.lit(0.0))) / 3
            steps = self.now.select(*[F.abs(F.col(f) - near(f)).alias(f) for f in self.spec.features])
            self._known["structure"] = -self._mean(steps.agg(*[F.avg(f) / (F.stddev_pop(f) + 1e-8) for f in self.spec.features]).first())
        return self._known["structure"]


def mean_shape(df: DataFrame, spec: SeriesSpec) -> tuple[float, float]:
    """Skewness and kurtosis (means over features; undefined: 0), from central moments about means of a pass before: Spark's own of both are one expression too large to be compiled."""
    x = [sanitise(F.col(c).cast("double")) for c in spec.features]
    means = df.agg(*[F.avg(v) for v in x]).first()
    away = [v - float(m or 0.0) for v, m in zip(x, means, strict=True)]
    got = list(df.agg(*[F.avg(reduce(lambda a, b: a * b, [d] * k)) for d in away for k in (2, 3, 4)]).first())
    skew = kurtosis = 0.0
    for m2, m3, m4 in zip(got[::3], got[1::3], got[2::3], strict=True):
        if m2:
            skew, kurtosis = skew + m3 / m2**1.5, kurtosis + m4 / m2**2 - 3
    return skew / len(x), kurtosis / len(x)


class QTable:
    """Q values by state and action, with a seeded choice."""

    def __init__(self, seed: int, epsilon: float = 0.2, rate: float = 0.3, discount: float = 0.9):
        self.q: dict = defaultdict(dict)
        self.rng, self.epsilon, self.rate, self.discount = np.random.default_rng(seed), epsilon, rate, discount

    def choose(self, state: tuple, actions: list[str], greedy: bool = False, bonus: dict[str, float] | None = None) -> str:
        if not greedy and self.rng.random() < self.epsilon:
            return actions[int(self.rng.integers(len(actions)))]
        return max(actions, key=lambda a: (self.q[state].get(a, 0.0) + (bonus or {}).get(a, 0.0), -actions.index(a)))

    def learn(self, path: list[tuple]) -> None:
        """Backwards over (state, action, reward)."""
        ahead = 0.0
        for state, action, reward in reversed(path):
            old = self.q[state].get(action, 0.0)
            self.q[state][action] = old + self.rate * (reward + self.discount * ahead - old)
            ahead = max(self.q[state].values())

    def to_json(self) -> list:
        return [[list(s), a] for s, a in self.q.items()]

    def from_json(self, rows: list) -> QTable:
        self.q = defaultdict(dict, {tuple(s): dict(a) for s, a in rows})
        return self


@dataclass
class Result:
    best: DataFrame
    best_score: float
    best_actions: list[tuple[str, str]]
    last: DataFrame
    high: QTable
    low: QTable

    def agents(self) -> dict:
        return {"high": self.high.to_json(), "low": self.low.to_json()}


def _choose_macro(env: Environment, high: QTable, state: tuple, greedy: bool) -> str:
    """Missing values first; nothing to treat ends the run."""
    if env.rates["MISSING"] > 0.001:
        return "MISSING"
    if env.rates["OUTLIER"] + env.rates["CONSTRAINT"] < 1e-9 or env.step >= env.most_steps:
        return "FINISH"
    return high.choose(state, ["OUTLIER", "CONSTRAINT", "FINISH"], greedy, {k: env.rates[k] for k in ("OUTLIER", "CONSTRAINT")})


def run_episode(env: Environment, high: QTable, low: QTable, greedy: bool = False, actions: dict[str, list[str]] | None = None) -> tuple[list, list]:
    env.reset()
    top, bottom = [], []
    while env.step < env.most_steps:
        state = env.state_high()
        macro = _choose_macro(env, high, state, greedy)
        if macro == "FINISH":
            top.append((state, macro, 10 * (env.last - env.first)))
            break
        inner = env.state_low(macro)
        tried = {a: -0.1 * sum(h == (macro, a) for h in env.history) for a in (actions or LOW)[macro]}
        choice = low.choose(inner, (actions or LOW)[macro], greedy, tried)
        r_low, r_high = env.act(macro, choice)
        bottom.append((inner, choice, r_low))
        top.append((state, macro, r_high))
    return top, bottom


def train(env: Environment, episodes: int = 10, seed: int = 42, actions: dict[str, list[str]] | None = None, agents: dict | None = None) -> Result:
    """Q-learning over episodes, from saved agents on if there are some. Returns the best episode's table (by performance), and the last one's."""
    high, low = QTable(seed), QTable(seed + 1)
    if agents:
        high, low = high.from_json(agents["high"]), low.from_json(agents["low"])
    best: tuple = (-np.inf, env.dirty, [])
    for _ in range(episodes):
        top, bottom = run_episode(env, high, low, actions=actions)
        high.learn(top)
        low.learn(bottom)
        if env.last > best[0]:
            best = env.last, env.now, list(env.history)
    return Result(best[1], best[0], best[2], env.now, high, low)


def flat_episode(env: Environment, table: QTable, greedy: bool = False, actions: dict[str, list[str]] | None = None) -> list[tuple]:
    """An episode of one table over all pairs of what to treat and how, and the end."""
    env.reset()
    names = {f"{m}:{a}": (m, a) for m, every in (actions or LOW).items() for a in every}
    path = []
    while env.step < env.most_steps:
        state = env.state_high()
        open_ = [n for n, (m, _) in names.items() if (m == "MISSING") == (env.rates["MISSING"] > 0.001)]
        choice = table.choose(state, open_ if env.rates["MISSING"] > 0.001 else [*open_, "FINISH"], greedy)
        if choice == "FINISH":
            path.append((state, choice, 10 * (env.last - env.first)))
            break
        path.append((state, choice, sum(env.act(*names[choice]))))
    return path


def train_flat(env: Environment, episodes: int = 10, seed: int = 42, actions: dict[str, list[str]] | None = None, agent: list | None = None) -> QTable:
    table = QTable(seed).from_json(agent) if agent else QTable(seed)
    for _ in range(episodes):
        table.learn(flat_episode(env, table, actions=actions))
    return table


def apply_flat(env: Environment, agent: list, actions: dict[str, list[str]] | None = None) -> DataFrame:
    """One greedy episode of a saved flat agent."""
    flat_episode(env, QTable(0, epsilon=0).from_json(agent), True, actions)
    return env.now


def shape_features(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(sample, features): a vector of each sample's mean, deviation, skewness, kurtosis and mean step of each feature, standardised over samples (what is undefined is 0)."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    w = spec.ordered
    rows = df.withColumns({f"__d_{f}": F.abs(F.col(f) - F.lag(f).over(w)) for f in spec.features})
    stats = [F.coalesce(sanitise(fn(c)), F.lit(0.0)).alias(f"{k}_{f}") for f in spec.features for k, (fn, c) in enumerate([(F.avg, f), (F.stddev_pop, f), (F.skewness, f), (F.kurtosis, f), (F.avg, f"__d_{f}")])]
    table = rows.groupBy(spec.sample).agg(*stats)
    raw = VectorAssembler(inputCols=[c for c in table.columns if c != spec.sample], outputCol="__raw").transform(table)
    return StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(raw).transform(raw).select(spec.sample, "features")


def cluster_scores(points: DataFrame, most: int = 10, seed: int = 42) -> list[tuple[int, float, float, float]]:
    """(k, Calinski-Harabasz, silhouette, Davies-Bouldin) of k-means with 2 to `most` clusters over a column of features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import vector_to_array

    points = points.cache()
    n, out = points.count(), []
    for k in range(2, min(most, n - 1) + 1):
        model = KMeans(k=k, seed=seed).fit(points)
        got = model.transform(points)
        centres = np.array(model.clusterCenters())
        sizes = np.zeros(len(centres))
        spread = np.zeros(len(centres))

        own = F.element_at(F.from_json(F.lit(json.dumps(centres.tolist())), "array<array<double>>"), F.col("prediction") + 1)
        squares = F.zip_with(vector_to_array("features"), own, lambda a, b: (a - b) * (a - b))
        apart = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b))
        for r in got.groupBy("prediction").agg(F.count("*").alias("n"), F.avg(apart).alias("d")).collect():
            sizes[r["prediction"]], spread[r["prediction"]] = r["n"], r["d"]
        used = sizes > 0
        if used.sum() < 2:
            continue
        c, m, s = centres[used], sizes[used], spread[used]
        middle = (c * m[:, None]).sum(0) / n
        between, within = (m * ((c - middle) ** 2).sum(1)).sum(), model.summary.trainingCost
        gaps = np.linalg.norm(c[:, None] - c[None], axis=2)
        ratio = (s[:, None] + s[None]) / np.where(gaps > 0, gaps, np.inf)
        np.fill_diagonal(ratio, 0)
        calinski = between / max(within, 1e-12) * (n - len(c)) / (len(c) - 1)
        out.append((k, float(calinski), float(ClusteringEvaluator().evaluate(got)), float(ratio.max(axis=1).mean())))
    points.unpersist()
    return out


def choose_clusters(df: DataFrame, spec: SeriesSpec, most: int = 10, seed: int = 42) -> int:
    """The number of clusters of the greatest Calinski-Harabasz index; 1 with too few samples."""
    return max(cluster_scores(shape_features(df, spec), most, seed), key=lambda r: r[1], default=(1,))[0]


def cluster_performance(df: DataFrame, spec: SeriesSpec, k: int, seed: int = 42) -> float:
    """0.5 silhouette + 0.5 x 5 / (5 + Davies-Bouldin) of k clusters of samples: the measure of a clustering task."""
    found = [r for r in cluster_scores(shape_features(df, spec), k, seed) if r[0] == k]
    return 0.5 * found[0][2] + 0.5 * 5 / (5 + found[0][3]) if found else 0.0


def class_performance(df: DataFrame, classes: DataFrame, spec: SeriesSpec, seed: int = 42) -> float:
    """The mean of F1 and of the area under ROC (two classes; else of F1 alone) of a logistic regression over samples' shapes, on the samples with the least hash of each class (30 %). classes: sample, label from 0."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

    points = shape_features(df, spec).join(classes.select(spec.sample, F.col("label").cast("double").alias("label")), spec.sample)
    place = F.percent_rank().over(Window.partitionBy("label").orderBy(F.xxhash64(spec.sample, F.lit(seed)), spec.sample))
    points = points.withColumn("__test", place < 0.3)
    train_rows, test_rows = points.where("not __test"), points.where("__test")
    if train_rows.select("label").distinct().count() < 2:
        return 0.0
    got = LogisticRegression(regParam=0.01).fit(train_rows).transform(test_rows)
    f1 = MulticlassClassificationEvaluator(metricName="f1").evaluate(got)
    return float((f1 + BinaryClassificationEvaluator().evaluate(got)) / 2 if points.select("label").distinct().count() == 2 else f1)


def apply_agents(env: Environment, agents: dict, actions: dict[str, list[str]] | None = None) -> DataFrame:
    """One greedy episode of saved agents."""
    run_episode(env, QTable(0, epsilon=0).from_json(agents["high"]), QTable(0, epsilon=0).from_json(agents["low"]), True, actions)
    return env.now


def simplex(parts: int, step: float = 0.1, low: float = 0.1, high: float = 0.8) -> list[tuple[float, ...]]:
    """All weights of `parts` parts by step, each within [low, high], that sum to 1."""
    n, lo, hi = round(1 / step), round(low / step), round(high / step)
    grid: list[tuple[int, ...]] = [()]
    for _ in range(parts - 1):
        grid = [g + (i,) for g in grid for i in range(lo, hi + 1)]
    return sorted({tuple(round(i * step, 10) for i in (*g, n - sum(g))) for g in grid if lo <= n - sum(g) <= hi})


def candidate_score(performance: float, f1: float, rra: float, mse: float) -> float:
    return 0.5 * performance + 0.2 * f1 + 0.2 * rra + 0.1 / (1 + mse)


def dumps(result: Result) -> str:
    return json.dumps(result.agents())
