"""Recurrent and attention networks on the trainer of `networks`: forecasts, detectors and a repair."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.operators import tape
from seriesmend.operators.networks import Blocks, Network, Trained, _grouped, layer, linear, repair_by_reconstruction, row_scores, train, window_blocks, window_scores
from seriesmend.operators.tape import Node
from seriesmend.runtime import arrow_map
from seriesmend.spec import SeriesSpec

# ---- recurrent cells -----------------------------------------------------------------------------------------------


def cell_start(rng: np.random.Generator, name: str, inputs: int, hidden: int) -> dict[str, np.ndarray]:
    """Weights of a long short-term memory cell: of inputs and of its own output, for the input, forget, output gates and the new value; the forget gate starts open."""
    bound = 1 / math.sqrt(hidden)
    w = rng.uniform(-bound, bound, (inputs + hidden + 1, 4 * hidden))
    w[-1, hidden : 2 * hidden] += 1
    return {name: w}


def cell(x: Node, state: tuple[Node, Node], w: Node) -> tuple[Node, Node]:
    """(output, memory) after one more step."""
    h, c = state
    n = h.value.shape[1]
    z = linear(tape.joined([x, h], 1), w)
    gates = tape.sigmoid(z[:, : 3 * n])
    c = gates[:, n : 2 * n] * c + gates[:, :n] * tape.tanh(z[:, 3 * n :])
    return gates[:, 2 * n :] * tape.tanh(c), c


def _sigmoid_of_less(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.minimum(x, 700.0, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.divide(1.0, x, out=x)


def cells(x: Node, w: Node, state: tuple[Node, Node] | None = None, times: int = 0) -> tuple[Node, Node, Node]:
    """A cell over all steps of x (steps x inputs x rows), or `times` times over its only one, as one node of the tape: (outputs at each step (steps x hidden x rows), output and memory after the last).

    What `cell` says, with rows along the last axis, so that gates are whole stretches of memory; a tanh is twice a sigmoid of twice its argument, less 1, so that one exponential of each number makes all four."""
    inputs, hidden, rows = x.value.shape[1], w.value.shape[1] // 4, x.value.shape[2]
    steps, same = times or len(x.value), bool(times)
    turned, back_in, back_h = np.ascontiguousarray((w.value * -np.r_[np.ones(3 * hidden), np.full(hidden, 2.0)]).T), w.value[:inputs], w.value[inputs:-1]
    told = np.empty((steps, inputs + hidden + 1, rows))
    told[:, :inputs], told[:, -1] = x.value, 1.0
    told[0, inputs:-1] = 0.0 if state is None else state[0].value
    z, c, tc, out = np.empty((steps, 4 * hidden, rows)), np.empty((steps + 1, hidden, rows)), np.empty((steps, hidden, rows)), np.empty((steps + 1, hidden, rows))
    c[0] = 0.0 if state is None else state[1].value
    for k in range(steps):
        g = _sigmoid_of_less(np.matmul(turned, told[k], out=z[k]))
        g[3 * hidden :] *= 2.0
        g[3 * hidden :] -= 1.0
        np.multiply(g[hidden : 2 * hidden], c[k], out=c[k + 1])
        np.multiply(g[:hidden], g[3 * hidden :], out=tc[k])
        c[k + 1] += tc[k]
        np.multiply(c[k + 1], -2.0, out=tc[k])
        _sigmoid_of_less(tc[k])
        tc[k] *= 2.0
        tc[k] -= 1.0
        np.multiply(g[2 * hidden : 3 * hidden], tc[k], out=out[k])
        if k + 1 < steps:
            told[k + 1, inputs:-1] = out[k]
    out[steps] = c[steps]
    found: list = []

    def gradients(top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of x, w and the state, once for all of them."""
        if found and found[0] is top:
            return found[1]
        dz, dh, dc = np.empty_like(z), np.zeros((hidden, rows)), top[steps].copy()
        for k in range(steps - 1, -1, -1):
            dh += top[k]
            g, d = z[k], dz[k]
            i, f, o, u = (g[a * hidden : (a + 1) * hidden] for a in range(4))
            np.multiply(dh, tc[k], out=d[2 * hidden : 3 * hidden])
            own = tc[k] * tc[k]
            np.subtract(1.0, own, out=own)
            own *= o
            own *= dh
            dc += own
            np.multiply(dc, u, out=d[:hidden])
            np.multiply(dc, c[k], out=d[hidden : 2 * hidden])
            new = d[3 * hidden :]
            np.multiply(u, u, out=new)
            np.subtract(1.0, new, out=new)
            new *= i
            new *= dc
            slope = np.subtract(1.0, g[: 3 * hidden])
            slope *= g[: 3 * hidden]
            d[: 3 * hidden] *= slope
            dc *= f
            if k or state is not None:
                np.matmul(back_h, d, out=dh)
        dw = np.matmul(told, dz.swapaxes(1, 2)).sum(axis=0)
        dx = np.matmul(back_in, dz.sum(axis=0, keepdims=True) if same else dz) if x.parents else np.zeros(())
        found[:] = [top, (dx, dw, dh, dc)]
        return found[1]

    of = [x, w, *(state or ())]
    every = Node(out, tuple((n, lambda g, k=k: gradients(g)[k]) for k, n in enumerate(of) if k or x.parents))
    return every[:steps], every[steps - 1], every[steps]


def run(p: dict[str, Node], name: str, layers: int, x: Node, state: list[tuple[Node, Node]] | None = None, times: int = 0) -> tuple[Node, list[tuple[Node, Node]]]:
    """(outputs of the last of `layers` cells at each step, states after the last step), steps first and rows last; x and times as in `cells`."""
    after = []
    for k in range(layers):
        x, h, c = cells(x, p[f"{name}{k}"], state[k] if state else None, times)
        times = 0
        after.append((h, c))
    return x, after


def steps_of(x: np.ndarray) -> Node:
    """Windows with steps first and rows last."""
    return Node(x.transpose(1, 2, 0))


class Forecaster(Network):
    """What follows a window: cells over its rows, and a linear layer from the last output to `horizon` rows at once, as differences from the window's last row. Windows hold both."""

    def __init__(self, horizon: int, hidden: int = 32, layers: int = 1):
        self.horizon, self.hidden, self.layers = horizon, hidden, layers

    def start(self, rng, length, features):
        out = {}
        for k in range(self.layers):
            out |= cell_start(rng, f"c{k}", features if k == 0 else self.hidden, self.hidden)
        return out | {"out": layer(rng, self.hidden, self.horizon * features)}

    def forecast(self, p, x: np.ndarray) -> Node:
        """(n, horizon, features) for windows x of what is known."""
        _, state = run(p, "c", self.layers, steps_of(x))
        return linear(state[-1][0].swap(0, 1), p["out"]).reshape(len(x), self.horizon, x.shape[2]) + x[:, -1:, :]

    def losses(self, p, x, turn):
        known, after = x[:, : -self.horizon], x[:, -self.horizon :]
        return [(tape.squares(self.forecast(p, known) - after).sum() * (1 / (self.horizon * x.shape[2])), list(p))]


class EncoderForecaster(Forecaster):
    """Two stacks of cells: the second starts from the states of the first after the window, and gives a row a step, each from the row before it (the first from zeros)."""

    def __init__(self, horizon: int = 1, hidden: int = 20, layers: int = 2):
        super().__init__(horizon, hidden, layers)

    def start(self, rng, length, features):
        out = {}
        for name in "cd":
            for k in range(self.layers):
                out |= cell_start(rng, f"{name}{k}", features if k == 0 else self.hidden, self.hidden)
        return out | {"out": layer(rng, self.hidden, features)}

    def forecast(self, p, x):
        _, state = run(p, "c", self.layers, steps_of(x))
        row, rows = Node(np.zeros((len(x), x.shape[2]))), []
        for _ in range(self.horizon):
            _, state = run(p, "d", self.layers, row.swap(0, 1).reshape(1, x.shape[2], len(x)), state)
            row = linear(tape.relu(state[-1][0].swap(0, 1)), p["out"])
            rows.append(row.reshape(len(x), 1, x.shape[2]))
        return tape.joined(rows, 1)


class SequenceAutoEncoder(Network):
    """Cells over a window, whose last output is given at every step to cells with as many outputs as features; a linear layer over these is the window again."""

    def __init__(self, hidden: int = 64):
        self.hidden = hidden

    def start(self, rng, length, features):
        return cell_start(rng, "c0", features, self.hidden) | cell_start(rng, "d0", self.hidden, features) | {"out": layer(rng, features, features)}

    def rebuild(self, p, x):
        last = run(p, "c", 1, steps_of(x))[1][0][0]
        steps, _ = run(p, "d", 1, last.reshape(1, self.hidden, len(x)), times=x.shape[1])
        return linear(steps.swap(1, 2).swap(0, 1), p["out"])

    def losses(self, p, x, turn):
        return [(tape.squares(self.rebuild(p, x) - x).sum() * (1 / (x.shape[1] * x.shape[2])), list(p))]


# ---- forecasts -----------------------------------------------------------------------------------------------------


def fit_forecaster(df: DataFrame, spec: SeriesSpec, window: int = 30, horizon: int = 10, hidden: int = 32, layers: int = 1, rounds: int = 60, rate: float = 0.02, seed: int = 1, batches: int = 4) -> tuple[Trained, Blocks]:
    """A forecaster of all series, from windows brought to mean 0 and deviation 1 over the table."""
    blocks = window_blocks(df, spec, window + horizon, "all", batches=batches)
    return train(blocks, Forecaster(horizon, hidden, layers), rounds, rate, seed), blocks


def forecast_score(trained: Trained, of: Blocks, test: DataFrame, spec: SeriesSpec, stride: int = 5) -> float:
    """0.6 exp(-nrmse) + 0.4 (corr + 1) / 2 over every stride-th window of test, from sums that tasks send; 0 with fewer than two windows. test is scaled as what the network was trained on (of)."""
    scaled = test.select(*spec.keys, *[((F.col(c).cast("double") - float(m)) / float(s)).alias(c) for c, m, s in zip(spec.features, of.centre, of.spread, strict=True)])
    blocks = window_blocks(scaled, spec, of.length)
    names = ("n", "p", "v", "pp", "pv", "vv")
    schema, shape, horizon, centre, spread = T.StructType([T.StructField(c, T.DoubleType()) for c in names]), blocks.shape, trained.network.horizon, of.centre, of.spread

    def sums(batches):
        total = np.zeros(6)
        for x, marks in _grouped(batches, shape, 1):
            some = np.concatenate([(m[0][0] + np.arange(m[2] - m[1])) % stride == 0 for m in marks])
            x = x[some]
            if len(x):
                p = trained.network.forecast(trained.nodes(), x[:, :-horizon]).value * spread + centre
                v = x[:, -horizon:] * spread + centre
                total += [p.size, p.sum(), v.sum(), (p * p).sum(), (p * v).sum(), (v * v).sum()]
        yield {c: [t] for c, t in zip(names, total.tolist(), strict=True)}

    got = arrow_map(blocks.table.select("begin", "values"), sums, schema).agg(*[F.sum(c).alias(c) for c in names]).first()
    if not got["n"] or got["n"] < 2 * trained.network.horizon * len(spec.features):
        return 0.0
    n, p, v, pp, pv, vv = (got[c] for c in names)
    var_p, var_v = max(pp / n - (p / n) ** 2, 0.0), max(vv / n - (v / n) ** 2, 0.0)
    nrmse = math.sqrt(max(pp - 2 * pv + vv, 0.0) / n) / (math.sqrt(var_v) + 1e-8)
    corr = (pv / n - p / n * v / n) / math.sqrt(var_p * var_v) if var_p > 0 and var_v > 0 else 0.0
    return 0.6 * math.exp(-nrmse) + 0.4 * (corr + 1) / 2


def lstm_forecast_score(train_rows: DataFrame, test: DataFrame, spec: SeriesSpec, window: int = 30, horizon: int = 10, **how) -> float:
    """How well a recurrent forecaster that is trained on one table forecasts another."""
    return forecast_score(*fit_forecaster(train_rows, spec, window, horizon, **how), test, spec)


def lstm_detector(df: DataFrame, spec: SeriesSpec, window: int = 30, rounds: int = 40, rate: float = 0.02, seed: int = 1, batches: int = 4) -> DataFrame:
    """The table with `score`: the mean square by which a row misses its forecast from the `window` rows before it, in series of mean 0 and deviation 1. The first `window` rows take the first score; shorter series have 0."""
    blocks = window_blocks(df, spec, window + 1, "sample", batches=batches)
    trained = train(blocks, EncoderForecaster(), rounds, rate, seed)
    return row_scores(df, spec, window_scores(blocks, lambda x: ((trained.network.forecast(trained.nodes(), x[:, :-1]).value - x[:, -1:]) ** 2).mean(axis=(1, 2))), window + 1, window)


def lstm_sequence_repair(df: DataFrame, spec: SeriesSpec, window: int = 10, hidden: int = 32, rounds: int = 60, rate: float = 0.02, contamination: float = 0.05, seed: int = 1, batches: int = 4) -> DataFrame:
    """Rows that a recurrent auto-encoder of all series' windows rebuilds worst get what it makes of them (networks.repair_by_reconstruction)."""
    return repair_by_reconstruction(df, spec, window, lambda blocks: train(blocks, SequenceAutoEncoder(hidden), rounds, rate, seed), contamination, batches)


# ---- attention -----------------------------------------------------------------------------------------------------


def attention_start(rng: np.random.Generator, name: str, size: int) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": layer(rng, size, size) for k in ("q", "k", "v", "o")}


def attention(p: dict[str, Node], name: str, x: Node, memory: Node, heads: int, mask: Node | None = None) -> Node:
    """x (n, a, size) looks at memory (n, b, size), by `heads` parts of the size; mask is added to the logits (m, a, b: that of row i is i % m)."""
    q, k, v = linear(x, p[f"{name}.q"]), linear(memory, p[f"{name}.k"]), linear(memory, p[f"{name}.v"])
    return linear(tape.looked(q, k, v, heads, mask), p[f"{name}.o"])


class Catch(Network):
    """Channels' spectra, cut into patches of neighbouring frequencies, rebuilt from those of the other channels (after Wu et al., "CATCH", ICLR 2025). A channel's patch has real and imaginary parts of `patch` frequencies; in each patch the
    channels look at each other by attention whose mask is learned: a symmetric score of each pair of channels in each frequency range decides how much one may see of the other, and no channel sees itself, so that it has to be told from those it is
    correlated with. A window's loss is the mean square of its spectrum's residual, which by Parseval is that of its rows."""

    def __init__(self, patch: int = 4, size: int = 16, heads: int = 2):
        self.patch, self.size, self.heads = patch, size, heads

    def start(self, rng, length, features):
        patches = -(-(length // 2 + 1) // self.patch)
        out = {"in": layer(rng, 2 * self.patch, self.size), "place": 0.1 * rng.standard_normal((patches, features, self.size)), "mask": np.zeros((patches, features, features)), "back": layer(rng, self.size, 2 * self.patch)}
        return out | attention_start(rng, "att", self.size) | {"mix": layer(rng, self.size, 2 * self.size), "mixed": layer(rng, 2 * self.size, self.size)}

    def spectrum(self, x: np.ndarray) -> np.ndarray:
        """(n, patches, features, 2 x patch) of windows x, padded with zeros."""
        f = np.fft.rfft(x, axis=1, norm="ortho")
        short = -f.shape[1] % self.patch
        f = np.concatenate([f, np.zeros((len(x), short, x.shape[2]))], axis=1).reshape(len(x), -1, self.patch, x.shape[2]).swapaxes(2, 3)
        return np.concatenate([f.real, f.imag], axis=3)

    def passed(self, p, s: np.ndarray) -> Node:
        n, patches, features, wide = s.shape
        y = linear(Node(s), p["in"]).reshape(n, patches, features, self.size)
        own = p["place"]
        memory = (y + own).reshape(n * patches, features, self.size)
        asked = (own + np.zeros(y.value.shape)).reshape(n * patches, features, self.size)  # a channel asks by its name alone
        away = np.where(np.eye(features, dtype=bool), -1e9, 0.0) if features > 1 else np.zeros((1, 1))
        mask = p["mask"] + p["mask"].swap(1, 2) + away
        y = asked + attention(p, "att", asked, memory, self.heads, mask)
        y = y + linear(tape.relu(linear(y, p["mix"])), p["mixed"])
        return linear(y, p["back"]).reshape(n, patches, features, wide)

    def losses(self, p, x, turn):
        s = self.spectrum(x)
        return [(tape.squares(self.passed(p, s) - s).sum() * (1 / (x.shape[1] * x.shape[2])), list(p))]

    def errors(self, p, x):
        s = self.spectrum(x)
        return ((self.passed(p, s).value - s) ** 2).sum(axis=(1, 2, 3)) / (x.shape[1] * x.shape[2])


class Tranad(Network):
    """An encoder with attention over a window's rows, and two decoders that ask for its last row: the first without more, the second also told, row by row, how far the first was off (after Tuli et al., "TranAD", VLDB 2022). Windows are 0 to 1."""

    def __init__(self, size: int = 8, rounds: int = 20):
        self.size, self.rounds = size, rounds

    def start(self, rng, length, features):
        out = {"in": layer(rng, 2 * features, self.size), "ask": layer(rng, features, self.size), "out": layer(rng, self.size, features)}
        for name in ("enc", "one", "two"):
            out |= attention_start(rng, name, self.size) | {f"{name}.a": layer(rng, self.size, 16), f"{name}.b": layer(rng, 16, self.size)}
        return out

    def block(self, p, name, x, memory):
        x = x + attention(p, name, x, memory, 2)
        return x + linear(tape.relu(linear(x, p[f"{name}.a"])), p[f"{name}.b"])

    def parts(self, p, x: np.ndarray) -> tuple[Node, Node]:
        n, length, features = x.shape
        at = np.arange(length)[:, None] / 10_000 ** (np.arange(self.size) // 2 * 2 / self.size)
        place = np.where(np.arange(self.size) % 2, np.cos(at), np.sin(at))

        def passed(name: str, off: Node) -> Node:
            y = linear(tape.joined([Node(x), off], 2), p["in"]) + place
            memory = self.block(p, "enc", y, y)
            asked = linear(Node(x[:, -1:]), p["ask"])
            return tape.sigmoid(linear(self.block(p, name, asked, memory), p["out"]))

        first = passed("one", Node(np.zeros_like(x)))
        return first, passed("two", tape.squares(first - x))

    def losses(self, p, x, turn):
        share = 1 / (1 + turn // self.rounds)
        last = x[:, -1:]
        first, second = self.parts(p, x)
        loss = tape.squares(first - last).sum() * share + tape.squares(second - last).sum() * (1 - share)
        return [(loss * (1 / x.shape[2]), list(p))]

    def errors(self, p, x):
        return ((self.parts(p, x)[1].value - x[:, -1:]) ** 2).mean(axis=(1, 2))


def catch(df: DataFrame, spec: SeriesSpec, window: int = 32, rounds: int = 60, rate: float = 0.02, seed: int = 1, batches: int = 4) -> DataFrame:
    """The table with `score` by CATCH, over series of mean 0 and deviation 1; windows stand for their middle row. For several features: one alone has nothing to be told from."""
    blocks = window_blocks(df, spec, window, "sample", batches=batches)
    trained = train(blocks, Catch(), rounds, rate, seed)
    return row_scores(df, spec, window_scores(blocks, lambda x: trained.network.errors(trained.nodes(), x)), window)


def tranad(df: DataFrame, spec: SeriesSpec, window: int = 10, rounds: int = 60, rate: float = 0.01, seed: int = 1, batches: int = 4) -> DataFrame:
    """The table with `score` by TranAD, over series brought to 0 to 1: the mean square by which a row is off what the second decoder makes of the window that it ends."""
    blocks = window_blocks(df, spec, window, "range", batches=batches)
    trained = train(blocks, Tranad(), rounds, rate, seed)
    return row_scores(df, spec, window_scores(blocks, lambda x: trained.network.errors(trained.nodes(), x)), window, window - 1)
