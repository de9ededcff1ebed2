"""Networks over windows of all series, trained data-parallel.

Windows are kept once, as blocks of consecutive rows with as many rows of the next block as a window needs, in a table of the shared folder that is partitioned by batch. A round reads one batch: each task differentiates the network on its windows and
sends one row, the sums of its losses and gradients; these are added up in two steps where there are many tasks, and the driver, which holds the weights and nothing of the data, takes a step of Adam. A lost executor costs the round's tasks on it.
What a round sees and the weights it starts from don't depend on how many tasks there are; only the order in which gradients are added does, which is a matter of the last places.

Scores and repairs are a map over the same blocks, joined with the rows by (sample, t). There is no dropout and no batch normalisation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.operators import tape
from seriesmend.operators.missing import impute_linear
from seriesmend.operators.tape import Node
from seriesmend.runtime import arrow_map, scratch
from seriesmend.spec import SeriesSpec, long_form

#: Rows of a block, and windows that are differentiated at once.
BLOCK, AT_ONCE = 512, 512
EPS = 1e-8
#: Tasks beyond which their gradients are added up by other tasks first.
FEW = 16


# ---- windows -------------------------------------------------------------------------------------------------------


@dataclass
class Blocks:
    """table: sample, begin (row of the block's first window), batch, values (rows x features, flat), in the shared folder. length: rows of a window. centre and spread: what was subtracted and divided by, if it is the same for all series."""

    table: DataFrame
    length: int
    features: int
    batches: int
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None

    @property
    def tasks(self) -> int:
        return len(self.table.inputFiles())

    @property
    def shape(self) -> tuple[int, int]:
        return self.length, self.features


def window_blocks(df: DataFrame, spec: SeriesSpec, length: int, scaling: str | None = None, batches: int = 1, fill: dict[str, float] | None = None, block: int = BLOCK) -> Blocks:
    """All windows of `length` consecutive rows of all series. scaling: "all" (mean 0 and deviation 1 over the table), "sample" (in each series), "range" (0 to 1 in each series), or none. Missing cells are filled linearly, or
    by fill. Series shorter than a window have none. A block is in the batch that its sample and place are hashed to."""
    block = max(block, length)
    rows = df.select(*spec.keys, *[F.coalesce(F.col(f).cast("double"), F.lit(fill[f])).alias(f) for f in spec.features]) if fill else impute_linear(df.select(*spec.keys, *spec.features), spec)
    centre = spread = None
    if scaling == "all":
        got = rows.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(spec.features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        centre, spread = (np.array([got[f"{n}{k}"] or 0.0 for k in range(len(spec.features))]) for n in "ms")
        spread = np.where(spread > 0, spread, 1.0)
        rows = rows.withColumns({c: (F.col(c) - float(m)) / float(s) for c, m, s in zip(spec.features, centre, spread, strict=True)})
    elif scaling in ("sample", "range"):
        w = spec.whole
        low = lambda c: F.avg(c).over(w) if scaling == "sample" else F.min(c).over(w)
        wide = lambda c: F.stddev_pop(c).over(w) if scaling == "sample" else F.max(c).over(w) - F.min(c).over(w)
        rows = rows.withColumns({c: (F.col(c) - low(c)) / (wide(c) + EPS) for c in spec.features})
    elif scaling is not None:
        raise ValueError(f"no such scaling: {scaling}")
    at = F.floor(F.col(spec.t) / block)
    both = F.when((F.col(spec.t) % block < length - 1) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    rows = rows.select(F.col(spec.sample).alias("sample"), F.col(spec.t).alias("t"), F.array(*spec.features).alias("x"), F.explode(both).alias("at"))
    blocks = rows.groupBy("sample", "at").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("rows")).where(F.size("rows") >= length)
    made = blocks.select("sample", F.get("rows", F.lit(0))["t"].alias("begin"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("values"), F.pmod(F.xxhash64("sample", "at"), F.lit(batches)).cast("int").alias("batch"))
    path = scratch(df.sparkSession, "window-blocks")
    made.write.partitionBy("batch").parquet(path)
    schema = T.StructType([*[f for f in made.schema if f.name != "batch"], T.StructField("batch", T.IntegerType())])
    return Blocks(df.sparkSession.read.schema(schema).parquet(path), length, len(spec.features), batches, centre, spread)


def _reuse_memory() -> None:
    """Lets the allocator keep what a chunk's arrays took for those of the next one: it gives nothing back to the system below the size of the largest block freed, and a third of a round went in getting it again."""
    np.empty(30 << 20, np.uint8)


def _windows(values: pa.ListScalar, shape: tuple[int, int]) -> np.ndarray:
    """(n, length, features) of one block's values."""
    return np.lib.stride_tricks.sliding_window_view(values.values.to_numpy().reshape(-1, shape[1]), shape[0], axis=0).swapaxes(1, 2)


def _grouped(batches, shape: tuple[int, int], columns: int):
    """(windows of several blocks, [(other columns of a block, its first and last window)]), of about AT_ONCE windows."""
    _reuse_memory()
    held, marks, n = [], [], 0
    for b in batches:
        for k in range(b.num_rows):
            x = _windows(b.column(columns)[k], shape)
            marks.append(([b.column(c)[k].as_py() for c in range(columns)], n, n + len(x)))
            held.append(x)
            n += len(x)
            if n >= AT_ONCE:
                yield np.concatenate(held), marks
                held, marks, n = [], [], 0
    if held:
        yield np.concatenate(held), marks


# ---- training ------------------------------------------------------------------------------------------------------


class Network:
    """What is trained. start: the first weights, by name; losses: for windows x of a batch, sums over them, each with the names of the weights that are to lessen it."""

    def start(self, rng: np.random.Generator, length: int, features: int) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def losses(self, p: dict[str, Node], x: np.ndarray, turn: int) -> list[tuple[Node, list[str]]]:
        raise NotImplementedError


@dataclass
class Trained:
    network: Network
    weights: dict[str, np.ndarray]
    #: mean losses of a window, round by round.
    history: list[list[float]] = field(default_factory=list)

    def nodes(self) -> dict[str, Node]:
        return {k: Node(v) for k, v in self.weights.items()}


def gradients(network: Network, weights: dict[str, np.ndarray], x: np.ndarray, turn: int) -> tuple[list[float], dict[str, np.ndarray]]:
    """(sums of the losses over windows x, their gradients)."""
    p = {k: Node(v) for k, v in weights.items()}
    sums, out = [], {k: np.zeros_like(v) for k, v in weights.items()}
    for loss, names in network.losses(p, x, turn):
        tape.backward(loss)
        sums.append(float(loss.value))
        for k in names:
            if p[k].grad is not None:
                out[k] = out[k] + p[k].grad
                p[k].grad = None
    return sums, out


_PARTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("losses", T.ArrayType(T.DoubleType())), T.StructField("sums", T.BinaryType())])


def _added(batches):
    n, losses, total = 0, None, None
    for b in batches:
        for m, s, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            v = np.frombuffer(raw)
            n, losses, total = n + m, np.array(s) if losses is None else losses + s, v.copy() if total is None else total + v
    if n:
        yield {"n": [n], "losses": [losses.tolist()], "sums": [total.tobytes()]}


def summed_gradients(blocks: Blocks, network: Network, weights: dict[str, np.ndarray], turn: int) -> tuple[int, np.ndarray, dict[str, np.ndarray]]:
    """(windows, sums of losses, sums of gradients) over the batch of a turn."""
    names, shape = list(weights), blocks.shape

    def work(batches):
        n, losses, total = 0, None, None
        for x, _ in _grouped(batches, shape, 0):
            s, g = gradients(network, weights, x, turn)
            v = np.concatenate([g[k].ravel() for k in names])
            n, losses, total = n + len(x), np.array(s) if losses is None else losses + s, v if total is None else total + v
        if n:
            yield {"n": [n], "losses": [losses.tolist()], "sums": [total.tobytes()]}

    part = blocks.table.where(F.col("batch") == turn % blocks.batches).select("values")
    rows = arrow_map(part, work, _PARTS)
    if blocks.tasks > FEW:
        rows = arrow_map(rows.repartition(math.isqrt(blocks.tasks)), _added, _PARTS)
    n, losses, total = 0, np.zeros(0), np.zeros(0)
    for r in rows.collect():  # a row for each task, or for the root of their number
        v, s = np.frombuffer(bytes(r["sums"])), np.array(r["losses"])
        n, losses, total = n + r["n"], s if not n else losses + s, v if not n else total + v
    out, at = {}, 0
    for k in names if n else []:
        out[k] = total[at : at + weights[k].size].reshape(weights[k].shape)
        at += weights[k].size
    return n, losses, out


class Adam:
    def __init__(self, rate: float, decay: float = 0.0):
        self.rate, self.decay, self.turn, self.m, self.v = rate, decay, 0, {}, {}

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.turn += 1
        out = {}
        for k, w in weights.items():
            g = grads[k] + self.decay * w
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            out[k] = w - self.rate * (self.m[k] / (1 - 0.9**self.turn)) / (np.sqrt(self.v[k] / (1 - 0.999**self.turn)) + 1e-8)
        return out


def train(blocks: Blocks, network: Network, rounds: int, rate: float = 0.01, seed: int = 1) -> Trained:
    """`rounds` steps of Adam, each over the mean gradient of one batch's windows. A batch without windows is passed over; with no windows at all the weights stay as they start."""
    weights = network.start(np.random.default_rng(seed), blocks.length, blocks.features)
    out, adam = Trained(network, weights), Adam(rate)
    for turn in range(rounds):
        n, losses, grads = summed_gradients(blocks, network, out.weights, turn)
        if n:
            out.history.append((losses / n).tolist())
            out.weights = adam.step(out.weights, {k: g / n for k, g in grads.items()})
    return out


# ---- what windows say of rows --------------------------------------------------------------------------------------


def window_scores(blocks: Blocks, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(sample, start, score) of every window; score: windows (n x length x features) -> n numbers."""
    schema = T.StructType([blocks.table.schema["sample"], T.StructField("start", T.LongType()), T.StructField("score", T.DoubleType())])
    shape = blocks.shape

    def run(batches):
        for x, marks in _grouped(batches, shape, 2):
            ids = [m[0][0] for m in marks for _ in range(m[2] - m[1])]
            starts = np.concatenate([m[0][1] + np.arange(m[2] - m[1]) for m in marks])
            yield {"sample": ids, "start": starts, "score": np.asarray(score(x), float)}

    return arrow_map(blocks.table.select("sample", "begin", "values"), run, schema)


def row_scores(df: DataFrame, spec: SeriesSpec, found: DataFrame, length: int, place: int | None = None) -> DataFrame:
    """The table with `score`: that of the window whose row `place` (default: the middle, length // 2) it is; rows before and after these take the nearest one's. Series without a window have 0."""
    place = length // 2 if place is None else place
    n = F.count("*").over(spec.whole)
    rows = df.drop("score").withColumn("__start", F.greatest(F.lit(0), F.least(F.col(spec.t) - place, n - length)))
    found = found.select(F.col("sample").alias("__sample"), F.col("start").alias("__at"), "score")
    joined = rows.join(found, F.col(spec.sample).eqNullSafe(F.col("__sample")) & (F.col("__start") == F.col("__at")), "left")
    return joined.withColumn("score", F.coalesce("score", F.lit(0.0))).drop("__start", "__sample", "__at")


def row_reconstructions(blocks: Blocks, rebuild: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(sample, t, rebuilt: array of features): the mean of what all windows over a row make of it. A block adds up its own windows, so that only rows between two blocks meet in the grouping."""
    schema = T.StructType([blocks.table.schema["sample"], T.StructField("t", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(f"s{k}", T.DoubleType()) for k in range(blocks.features)]])
    shape = length, features = blocks.shape

    def run(batches):
        for x, marks in _grouped(batches, shape, 2):
            y = rebuild(x)
            for (sample, begin), a, b in marks:
                size = b - a + length - 1
                total, n = np.zeros((size, features)), np.zeros(size, np.int64)
                for k in range(length):
                    total[k : k + b - a] += y[a:b, k]
                    n[k : k + b - a] += 1
                yield {"sample": [sample] * size, "t": begin + np.arange(size), "n": n, **{f"s{k}": total[:, k] for k in range(features)}}

    parts = arrow_map(blocks.table.select("sample", "begin", "values"), run, schema)
    mean = [F.sum(f"s{k}") / F.sum("n") for k in range(blocks.features)]
    return parts.groupBy("sample", "t").agg(F.array(*mean).alias("rebuilt"))


def repair_by_reconstruction(df: DataFrame, spec: SeriesSpec, length: int, make: Callable[[Blocks], Trained], contamination: float = 0.05, batches: int = 4) -> DataFrame:
    """Rows whose scaled reconstruction is furthest off (above the series' 1 - contamination quantile of mean squares) or that miss a cell get the reconstruction. Missing cells are the table's medians
    (approximate: within a ten-thousandth of the rows) for the network; in series shorter than a window they stay that. A series whose rows are all rebuilt alike keeps its rows."""
    middle = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in spec.features]).first()
    fill = {c: middle[c] if middle[c] is not None else 0.0 for c in spec.features}
    blocks = window_blocks(df, spec, length, "all", batches=batches, fill=fill)
    trained = make(blocks)
    found = row_reconstructions(blocks, lambda x: trained.network.rebuild(trained.nodes(), x).value).withColumnsRenamed({"sample": "__sample", "t": "__t", "rebuilt": "__rebuilt"})
    rows = df.join(found, F.col(spec.sample).eqNullSafe(F.col("__sample")) & (F.col(spec.t) == F.col("__t")), "left")
    scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) - float(m)) / float(s) for c, m, s in zip(spec.features, blocks.centre, blocks.spread, strict=True)]
    off = sum(((x - F.get("__rebuilt", F.lit(k))) ** 2 for k, x in enumerate(scaled)), F.lit(0.0)) / len(scaled)
    rows = rows.withColumn("__off", off).withColumn("__limit", F.percentile("__off", F.lit(1 - contamination)).over(spec.whole))
    missing: Column = F.lit(False)
    for c in spec.features:
        missing = missing | F.col(c).isNull()
    rows = rows.withColumn("__wrong", F.coalesce(F.col("__off") > F.col("__limit"), F.lit(False)) | missing)
    new = {c: F.when(F.col("__wrong"), F.coalesce(F.get("__rebuilt", F.lit(k)) * float(s) + float(m), F.col(c).cast("double"), F.lit(fill[c]))).otherwise(F.col(c).cast("double")) for k, (c, m, s) in enumerate(zip(spec.features, blocks.centre, blocks.spread, strict=True))}
    return rows.withColumns(new).drop("__sample", "__t", "__rebuilt", "__off", "__limit", "__wrong")


# ---- networks ------------------------------------------------------------------------------------------------------


def layer(rng: np.random.Generator, a: int, b: int) -> np.ndarray:
    """Weights of a linear layer from a to b numbers, the last row its constants."""
    return rng.uniform(-1, 1, (a + 1, b)) / math.sqrt(a)


def linear(x: Node, w: Node) -> Node:
    return tape.linear(x, w)


class AutoEncoder(Network):
    """Linear layers over a flat window through `hidden` to its last and back, with ReLU between them. unit: each window is first brought to 0 to 1 over all its cells."""

    def __init__(self, hidden: tuple[int, ...] = (64, 32), unit: bool = False):
        self.hidden, self.unit = hidden, unit

    def start(self, rng, length, features):
        sizes = [length * features, *self.hidden, *self.hidden[-2::-1], length * features]
        return {f"w{k}": layer(rng, a, b) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))}

    def flat(self, x: np.ndarray) -> np.ndarray:
        x = x.reshape(len(x), -1)
        if self.unit:
            low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
            x = (x - low) / np.where(high > low, high - low, 1)
        return x

    def passed(self, p: dict[str, Node], flat: np.ndarray) -> Node:
        y = Node(flat)
        for k in range(len(p)):
            y = linear(y, p[f"w{k}"])
            y = tape.relu(y) if k < len(p) - 1 else y
        return y

    def rebuild(self, p, x):
        return self.passed(p, self.flat(x)).reshape(*x.shape)

    def losses(self, p, x, turn):
        flat = self.flat(x)
        return [(tape.squares(self.passed(p, flat) - flat).sum() * (1 / flat.shape[1]), list(p))]

    def errors(self, p, x):
        """Distance of each window from what it is rebuilt as."""
        flat = self.flat(x)
        return np.sqrt(((self.passed(p, flat).value - flat) ** 2).sum(axis=1))


class Usad(Network):
    """Two auto-encoders that share their encoder: the first learns to rebuild windows and to get past the second, the second to rebuild windows and to tell what the first has rebuilt (after Audibert et al., KDD 2020). Windows are 0 to 1. The contest has half of the weight at first, and more after each `rounds`."""

    def __init__(self, hidden: int = 16, latent: int = 5, rounds: int = 40):
        self.hidden, self.latent, self.rounds = hidden, latent, rounds

    def start(self, rng, length, features):
        n, h, z = length * features, self.hidden, self.latent
        out = {f"e{k}": layer(rng, a, b) for k, (a, b) in enumerate(((n, h), (h, h), (h, z)))}
        return out | {f"{d}{k}": layer(rng, a, b) for d in "ab" for k, (a, b) in enumerate(((z, h), (h, h), (h, n)))}

    def through(self, p: dict[str, Node], kind: str, x: Node) -> Node:
        for k in range(3):
            x = linear(x, p[f"{kind}{k}"])
            x = tape.sigmoid(x) if kind != "e" and k == 2 else tape.relu(x)
        return x

    def parts(self, p, x):
        flat = x.reshape(len(x), -1)
        code = self.through(p, "e", Node(flat))
        first = self.through(p, "a", code)
        return flat, first, self.through(p, "b", code), self.through(p, "b", self.through(p, "e", first))

    def losses(self, p, x, turn):
        flat, first, second, both = self.parts(p, x)
        share = 1 / (2 + turn // self.rounds)
        off = lambda y: tape.squares(y - flat).sum() * (1 / flat.shape[1])
        names = lambda kinds: [k for k in p if k[0] in kinds]
        return [(off(first) * share + off(both) * (1 - share), names("ea")), (off(second) * share - off(both) * (1 - share), names("eb"))]

    def errors(self, p, x):
        flat, first, _, both = self.parts(p, x)
        return 0.1 * ((first.value - flat) ** 2).mean(axis=1) + 0.9 * ((both.value - flat) ** 2).mean(axis=1)


def autoencoder(df: DataFrame, spec: SeriesSpec, window: int | None = None, hidden: tuple[int, ...] = (64, 32), rounds: int = 30, rate: float = 0.005, seed: int = 1, batches: int = 4) -> DataFrame:
    """The table with `score`: the distance between each window (20 rows of one feature, single rows of several), brought to 0 to 1, and what an auto-encoder of all series' windows makes of it; windows stand for their middle row."""
    window = window or (20 if len(spec.features) == 1 else 1)
    blocks = window_blocks(df, spec, window, batches=batches)
    trained = train(blocks, AutoEncoder(hidden, unit=True), rounds, rate, seed)
    return row_scores(df, spec, window_scores(blocks, lambda x: trained.network.errors(trained.nodes(), x)), window)


def usad(df: DataFrame, spec: SeriesSpec, window: int = 5, rounds: int = 40, rate: float = 0.01, seed: int = 1, batches: int = 4) -> DataFrame:
    """The table with `score` by USAD over windows of series brought to 0 to 1; windows stand for their middle row."""
    blocks = window_blocks(df, spec, window, "range", batches=batches)
    trained = train(blocks, Usad(), rounds, rate, seed)
    return row_scores(df, spec, window_scores(blocks, lambda x: trained.network.errors(trained.nodes(), x)), window)


def window_mean_autoencoder(df: DataFrame, spec: SeriesSpec, window: int = 10, hidden: int = 32, rounds: int = 30, rate: float = 0.005, seed: int = 1, batches: int = 4) -> DataFrame:
    """The table with `score`: the greatest gap, over features, between the means of the `window` rows before a row and what an auto-encoder with one hidden layer makes of them. The first `window` rows have 0."""
    means = impute_linear(df.select(*spec.keys, *spec.features), spec)
    means = means.withColumns({c: F.avg(c).over(spec.rows(window, -1)) for c in spec.features}).where(F.col(spec.t) >= window).withColumn(spec.t, F.col(spec.t) - window)
    blocks = window_blocks(means, spec, 1, "all", batches=batches)
    trained = train(blocks, AutoEncoder((hidden,)), rounds, rate, seed)
    spread = blocks.spread
    found = window_scores(blocks, lambda x: (np.abs(trained.network.rebuild(trained.nodes(), x).value - x) * spread).max(axis=(1, 2)))
    found = found.withColumnsRenamed({"sample": "__sample", "start": "__at"})
    rows = df.drop("score").join(found, F.col(spec.sample).eqNullSafe(F.col("__sample")) & (F.col(spec.t) - window == F.col("__at")), "left")
    return rows.withColumn("score", F.coalesce("score", F.lit(0.0))).drop("__sample", "__at")


def cae_m_repair(df: DataFrame, spec: SeriesSpec, window: int = 10, latent: int = 8, rounds: int = 30, rate: float = 0.005, contamination: float = 0.05, seed: int = 1, batches: int = 4) -> DataFrame:
    """Rows that an auto-encoder of all series' windows rebuilds worst get what it makes of them (repair_by_reconstruction)."""
    return repair_by_reconstruction(df, spec, window, lambda blocks: train(blocks, AutoEncoder((128, latent)), rounds, rate, seed), contamination, batches)
