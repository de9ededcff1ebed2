"""Support vector machines with Gaussian kernels, one for each series, by working sets.

A series' problem is solved over a working set of its rows, first some that are evenly spaced. Then every row of the series, where it lies, is held against the solution: those that break their optimality condition by more than the tolerance are what the set lacks, and the worst of them
go into it, beside the support vectors that it has. It ends when no row of any series breaks its condition, which is the optimum over all rows. Rows that aren't support vectors don't travel, and a task holds one working set at a time: the support vectors of a
series and what was added last. Series are solved side by side; how rows are dealt to tasks changes nothing but the order in which equal violations are taken.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.operators.networks import Blocks, _windows, row_scores, window_blocks
from seriesmend.runtime import arrow_map, discard, written
from seriesmend.spec import SeriesSpec, long_form, wide_form

#: Rows that a working set starts with and that a round adds to it, at least; rounds.
START, ADD, ROUNDS = 64, 64, 200
#: Rows of working sets that a task holds before it solves them, and numbers of kernels that are made at once; one working set may be larger.
HELD, NUMBERS = 8192, 1 << 19


def gaussian(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(far, 0))


@dataclass(frozen=True)
class Tube:
    """Regression: min 1/2 |f|^2 + 1/2 b^2 + cost sum max(0, |y - f(x) - b| - width). The constant is part of the kernel (+ 1), so that every coefficient moves alone."""

    cost: float = 1.0
    width: float = 0.1
    gamma: float = 1.0
    share = 0.0

    def broken(self, g: np.ndarray, beta: np.ndarray, n: float, level: float) -> np.ndarray:
        """By how much rows break their conditions; g: f - y."""
        up, down = g + self.width, g - self.width
        out = np.maximum(np.maximum(-up, down), 0)  # beta = 0
        out = np.where(beta > 0, np.where(beta >= self.cost, np.maximum(up, 0), np.abs(up)), out)
        return np.where(beta < 0, np.where(beta <= -self.cost, np.maximum(-down, 0), np.abs(down)), out)

    def solve(self, x: np.ndarray, y: np.ndarray, beta: np.ndarray, n: float, tolerance: float) -> tuple[np.ndarray, float]:
        """(coefficients, 0) by coordinate descent: always the one that breaks its condition most."""
        k = gaussian(x, x, self.gamma) + 1
        g = k @ beta - y
        for _ in range(10_000 + 200 * len(y)):
            off = self.broken(g, beta, n, 0.0)
            i = int(off.argmax())
            if off[i] <= tolerance:
                break
            z = beta[i] - g[i] / k[i, i]
            new = np.clip(np.sign(z) * max(abs(z) - self.width / k[i, i], 0.0), -self.cost, self.cost)
            g += k[:, i] * (new - beta[i])
            beta[i] = new
        return beta, 0.0

    def solve_many(self, sets: list[tuple], tolerance: float) -> list[tuple[np.ndarray, float]]:
        """solve() for each of sets (its arguments but the last): those of like size move side by side, every one its own coordinate."""
        out: list = [None] * len(sets)
        order = sorted(range(len(sets)), key=lambda k: -len(sets[k][1]))
        while order:
            most = len(sets[order[0]][1])
            some = order[: max(1, NUMBERS // max(1, most * most))]
            order = order[len(some) :]
            if len(some) == 1:
                out[some[0]] = self.solve(*sets[some[0]], tolerance)
                continue
            k, g, beta, sizes = np.zeros((len(some), most, most)), np.zeros((len(some), most)), np.zeros((len(some), most)), np.array([len(sets[i][1]) for i in some])
            for r, i in enumerate(some):
                x, y, b, _ = sets[i]
                k[r, : len(y), : len(y)] = one = gaussian(x, x, self.gamma) + 1
                g[r, : len(y)], beta[r, : len(y)] = one @ b - y, b
            self._move(k, g, beta, 10_000 + 200 * sizes, tolerance)
            for r, i in enumerate(some):
                out[i] = beta[r, : sizes[r]], 0.0
        return out

    def _move(self, k: np.ndarray, g: np.ndarray, beta: np.ndarray, limit: np.ndarray, tolerance: float) -> None:
        """Coordinate descent of several problems, in beta; columns beyond a problem's size have zeros in k and g, and never break a condition."""
        diagonal, live = np.maximum(np.einsum("sii->si", k), 1e-300), np.arange(len(k))
        mine, now, left = k, beta.copy(), limit.copy()
        while len(live):
            off = self.broken(g, now, 0.0, 0.0)
            at, rows = off.argmax(axis=1), np.arange(len(live))
            going = (off[rows, at] > tolerance) & (left > 0)
            if not going.all():
                beta[live[~going]] = now[~going]
                live, mine, g, now, left, diagonal, at = live[going], mine[going], g[going], now[going], left[going], diagonal[going], at[going]
                rows = np.arange(len(live))
            own, d = now[rows, at], diagonal[rows, at]
            z = own - g[rows, at] / d
            new = np.clip(np.sign(z) * np.maximum(np.abs(z) - self.width / d, 0.0), -self.cost, self.cost)
            g += mine[rows, at] * (new - own)[:, None]  # k is symmetric
            now[rows, at] = new
            left -= 1

    def value(self, x: np.ndarray, at: np.ndarray, beta: np.ndarray, level: float) -> np.ndarray:
        return gaussian(x, at, self.gamma) @ beta + beta.sum()

    def gap(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, beta: np.ndarray, level: float) -> np.ndarray:
        return self.value(x, at, beta, level) - y


@dataclass(frozen=True)
class OneClass:
    """min 1/2 |f|^2 - r + 1 / (nu n) sum max(0, r - f(x)): coefficients of 0 to 1 / (nu n) that add up to 1. At most a share nu of the rows lies below the level r, and at least that share are support vectors."""

    nu: float = 0.5
    gamma: float = 1.0

    @property
    def share(self) -> float:
        return self.nu

    def broken(self, g: np.ndarray, beta: np.ndarray, n: float, level: float) -> np.ndarray:
        """g: f."""
        most = 1 / (self.nu * n)
        out = np.where(beta < most * (1 - 1e-12), np.maximum(level - g, 0), 0)
        return np.maximum(out, np.where(beta > 0, np.maximum(g - level, 0), 0))

    def solve(self, x: np.ndarray, y: np.ndarray, beta: np.ndarray, n: float, tolerance: float) -> tuple[np.ndarray, float]:
        """(coefficients, level) by pairs: weight goes from the row of greatest value that has some to the one of least value that may have more."""
        most, k = 1 / (self.nu * n), gaussian(x, x, self.gamma)
        beta = np.clip(beta, 0, most)
        short = 1 - beta.sum()
        for i in range(len(beta)):  # what is missing of 1 goes to the first rows that have room
            if short <= 0:
                break
            step = min(short, most - beta[i])
            beta[i], short = beta[i] + step, short - step
        g = k @ beta
        for _ in range(10_000 + 200 * len(beta)):
            may, has = beta < most * (1 - 1e-12), beta > 1e-15
            if not may.any():
                break
            i, j = int(np.where(may, g, np.inf).argmin()), int(np.where(has, g, -np.inf).argmax())
            if g[j] - g[i] <= tolerance:
                break
            step = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), most - beta[i], beta[j])
            beta[i], beta[j] = beta[i] + step, beta[j] - step
            g += step * (k[:, i] - k[:, j])
        beta = np.where(beta > 1e-15, beta, 0.0)
        inside = (beta > 0) & (beta < most * (1 - 1e-12))
        if inside.any():
            return beta, float((g[inside].min() + g[inside].max()) / 2)
        low, high = g[beta > 0].max(), g[beta == 0].min() if (beta == 0).any() else g[beta > 0].max()
        return beta, float((low + high) / 2)

    def solve_many(self, sets: list[tuple], tolerance: float) -> list[tuple[np.ndarray, float]]:
        return [self.solve(*one, tolerance) for one in sets]

    def value(self, x: np.ndarray, at: np.ndarray, beta: np.ndarray, level: float) -> np.ndarray:
        return gaussian(x, at, self.gamma) @ beta

    def gap(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, beta: np.ndarray, level: float) -> np.ndarray:
        return self.value(x, at, beta, level)


Make = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _joined(blocks: Blocks, right: DataFrame) -> DataFrame:
    """The blocks with the one row of `right` (sample renamed to s) that their series has."""
    return blocks.table.select("sample", "begin", "values").join(right, F.col("sample").eqNullSafe(F.col("s"))).drop("s")


def fit(blocks: Blocks, machine: Tube | OneClass, make: Make, tolerance: float = 1e-3, rounds: int = ROUNDS) -> DataFrame:
    """(s: sample, n, at: flat support vectors, beta, level) of every series with windows; make: windows -> (inputs, values). RuntimeError if a row still breaks its condition after `rounds`."""
    kind, long, double = blocks.table.schema["sample"].dataType, T.LongType(), T.DoubleType()
    number = T.ArrayType(double)
    length, share, shape = blocks.length, machine.share, blocks.shape
    size = F.size("values") / blocks.features - (length - 1)
    counts = blocks.table.groupBy(F.col("sample").alias("s")).agg(F.sum(size).cast("long").alias("n"))
    working = T.StructType([T.StructField("s", kind), T.StructField("n", long), T.StructField("id", long), T.StructField("x", number), T.StructField("y", double), T.StructField("beta", double), T.StructField("off", double)])
    solved_schema = T.StructType([T.StructField("s", kind), T.StructField("n", long), T.StructField("ids", T.ArrayType(long)), T.StructField("at", number), T.StructField("ys", number), T.StructField("beta", number), T.StructField("level", double)])

    def together(parts: list[dict]) -> dict:
        """Rows of several series as one batch: a batch costs more than a short series' rows."""
        return {f.name: [v for p in parts for v in p[f.name]] for f in working}

    def chosen(batches):
        for b in batches:
            parts = []
            for k in range(b.num_rows):
                s, begin, n = (b.column(c)[k].as_py() for c in (0, 1, 3))
                step = max(1, int(n / (START + 1.5 * share * n)))
                ids = begin + np.arange(len(w := _windows(b.column(2)[k], shape)))
                some = ids % step == 0
                x, y = make(w[some])
                parts.append({"s": [s] * len(y), "n": [n] * len(y), "id": ids[some], "x": x.tolist(), "y": y, "beta": np.zeros(len(y)), "off": np.zeros(len(y))})
                if sum(len(p["y"]) for p in parts) >= HELD:
                    yield together(parts)
                    parts = []
            yield together(parts)

    def solutions(held: list[pa.RecordBatch], last: bool) -> tuple[dict | None, list[pa.RecordBatch]]:
        """(solutions of the series that are whole in rows sorted by series, rows that stay)."""
        rows = pa.Table.from_batches(held)
        codes = rows["s"].combine_chunks()
        codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.dictionary_encode(null_encoding="encode").indices.to_numpy()
        ends = [*(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), *([len(rows)] if last else [])]
        if not ends:
            return None, held
        spans = list(zip([0, *ends], ends, strict=False))
        ids, n, y, beta = (rows[c].to_numpy() for c in ("id", "n", "y", "beta"))
        x = rows["x"].combine_chunks()
        x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
        x = x.flatten().to_numpy().reshape(len(rows), -1)
        found = machine.solve_many([(x[a:b], y[a:b], beta[a:b].copy(), float(n[a])) for a, b in spans], tolerance / 2)
        some = [np.flatnonzero(v) for v, _ in found]
        out = {
            "s": rows["s"].take([a for a, _ in spans]), "n": n[[a for a, _ in spans]], "ids": [ids[a:b][k] for (a, b), k in zip(spans, some, strict=True)], "at": [x[a:b][k].ravel() for (a, b), k in zip(spans, some, strict=True)],
            "ys": [y[a:b][k] for (a, b), k in zip(spans, some, strict=True)], "beta": [v[k] for (v, _), k in zip(found, some, strict=True)], "level": [level for _, level in found],
        }
        return out, rows.slice(ends[-1]).combine_chunks().to_batches()

    def solve(batches):
        held: list[pa.RecordBatch] = []
        most = HELD
        for b in batches:
            held += [b] if b.num_rows else []
            if sum(len(h) for h in held) >= most:
                out, held = solutions(held, False)
                most = max(HELD, 2 * sum(len(h) for h in held))  # a long series is looked at again when it has doubled
                if out:
                    yield out
        if held:
            yield solutions(held, True)[0]

    def wrong(batches):
        for b in batches:
            parts = []
            for k in range(b.num_rows):
                s, begin, n, ids, at, beta, level = (b.column(c)[k].as_py() for c in (0, 1, 3, 4, 5, 6, 7))
                x, y = make(_windows(b.column(2)[k], shape))
                at = np.array(at, float).reshape(len(beta), -1) if beta else np.zeros((0, x.shape[1]))
                mine = begin + np.arange(len(y))
                off = machine.broken(machine.gap(x, y, at, np.array(beta, float), level), np.zeros(len(y)), n, level)
                bad = np.flatnonzero((off > tolerance) & ~np.isin(mine, np.array(ids, np.int64)))
                parts.append({"s": [s] * len(bad), "n": [n] * len(bad), "id": mine[bad], "x": x[bad].tolist(), "y": y[bad], "beta": np.zeros(len(bad)), "off": off[bad]})
                if sum(len(p["y"]) for p in parts) >= HELD:
                    yield together(parts)
                    parts = []
            yield together(parts)

    table = written(arrow_map(_joined(blocks, counts).select("sample", "begin", "values", "n"), chosen, working), "working-set")
    for _ in range(rounds):
        dealt = table.repartition("s").sortWithinPartitions("s", F.desc("off"), "id")
        solved = written(arrow_map(dealt, solve, solved_schema), "support-vectors")
        missing = arrow_map(_joined(blocks, solved.drop("ys")).select("sample", "begin", "values", "n", "ids", "at", "beta", "level"), wrong, working)
        worst = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("off"), "id"))
        missing = written(missing.withColumn("place", worst).where(F.col("place") <= F.greatest(F.lit(ADD), (F.col("n") * share / 4).cast("int"))).drop("place"), "violations")
        discard(table)
        if missing.isEmpty():
            discard(missing)
            return solved
        width = F.size("at") / F.size("beta")
        kept = solved.where(F.size("beta") > 0).select("s", "n", "ids", "at", "ys", "beta", width.cast("int").alias("w"), F.posexplode("ids").alias("k", "id"))
        kept = kept.select("s", "n", "id", F.slice("at", F.col("k") * F.col("w") + 1, F.col("w")).alias("x"), F.get("ys", F.col("k")).alias("y"), F.get("beta", F.col("k")).alias("beta"), F.lit(0.0).alias("off"))
        table = written(kept.unionByName(missing), "working-set")
        discard(solved, missing)
    raise RuntimeError(f"rows still break their conditions after {rounds} rounds")


def values_at(blocks: Blocks, machine: Tube | OneClass, make: Make, solved: DataFrame, out: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """(sample, start, score): out(value, level) of every window's series' solution."""
    schema, shape = T.StructType([blocks.table.schema["sample"], T.StructField("start", T.LongType()), T.StructField("score", T.DoubleType())]), blocks.shape

    def run(batches):
        for b in batches:
            ids, starts, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
            for k in range(b.num_rows):
                s, begin, at, beta, level = (b.column(c)[k].as_py() for c in (0, 1, 3, 4, 5))
                x, _ = make(_windows(b.column(2)[k], shape))
                at = np.array(at, float).reshape(len(beta), -1) if beta else np.zeros((0, x.shape[1]))
                ids += [s] * len(x)
                starts.append(begin + np.arange(len(x)))
                scores.append(out(machine.value(x, at, np.array(beta, float), level), level))
            yield {"sample": ids, "start": np.concatenate(starts), "score": np.concatenate(scores)}

    return arrow_map(_joined(blocks, solved.select("s", "at", "beta", "level")).select("sample", "begin", "values", "at", "beta", "level"), run, schema)


def unit_windows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows flat, each brought to 0 to 1 over its cells (0 where it is constant); no values."""
    x = w.reshape(len(w), -1)
    low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    return (x - low) / np.where(high > low, high - low, 1), np.zeros(len(x))


def one_class(df: DataFrame, spec: SeriesSpec, window: int = 20, nu: float = 0.5, tolerance: float = 1e-3) -> DataFrame:
    """The table with `score`: how far a window lies below the level of its series' one-class machine (kernel width 1 / cells of a window, over windows brought to 0 to 1); windows stand for their middle row. Series shorter than a window have 0. Working sets hold nu of a
    series' windows at least."""
    blocks = window_blocks(df, spec, window)
    machine = OneClass(nu, 1 / (window * len(spec.features)))
    return row_scores(df, spec, values_at(blocks, machine, unit_windows, fit(blocks, machine, unit_windows, tolerance), lambda v, level: level - v), window)


def _pair(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return w[:, 0, :1], w[:, 0, 1]


def tube_repair(df: DataFrame, spec: SeriesSpec, cost: float = 1.0, width: float = 0.1, tolerance: float = 1e-3) -> DataFrame:
    """Features as functions of time by support vector regression, over all rows: of the median of three rows, both brought to mean 0 and deviation 1 in the series. Missing cells count as filled linearly; series of fewer than two rows and constant ones stay as they are filled."""
    cells = long_form(_filled(df, spec), spec).withColumnsRenamed({spec.sample: "sample", spec.t: "t"})
    cells = cells.withColumn("sample", F.struct("sample", "col"))
    w = Window.partitionBy("sample")
    middle = F.percentile("value", F.lit(0.5)).over(w.orderBy("t").rowsBetween(-1, 1))
    cells = written(cells.withColumn("value", middle).withColumns({"m": F.avg("value").over(w), "s": F.stddev_pop("value").over(w), "n": F.count("*").over(w)}), "tube-cells")
    unit = F.sqrt((F.col("n") * F.col("n") - 1) / 12)
    points = cells.where("n > 1 AND s > 1e-12").select("sample", "t", ((F.col("t") - (F.col("n") - 1) / 2) / unit).alias("x"), ((F.col("value") - F.col("m")) / F.col("s")).alias("y"))
    points = points.withColumn("sample", F.to_json("sample"))
    blocks, machine = window_blocks(points, SeriesSpec(("x", "y"), "sample", "t"), 1), Tube(cost, width)
    found = values_at(blocks, machine, _pair, fit(blocks, machine, _pair, tolerance), lambda v, _: v).withColumnsRenamed({"sample": "name", "start": "at"})
    rows = cells.join(found, (F.to_json("sample") == F.col("name")) & (F.col("t") == F.col("at")), "left")
    new = rows.select(F.col("sample.sample").alias(spec.sample), F.col("sample.col").alias("col"), F.col("t").alias(spec.t), F.coalesce(F.col("score") * F.col("s") + F.col("m"), "value").alias("value"))
    wide = wide_form(new, spec).withColumnsRenamed({spec.sample: "__s", spec.t: "__t"})
    return df.drop(*spec.features).join(wide, F.col(spec.sample).eqNullSafe(F.col("__s")) & (F.col(spec.t) == F.col("__t"))).drop("__s", "__t")


def _filled(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    from seriesmend.operators.missing import impute_linear

    return impute_linear(df.select(*spec.keys, *spec.features), spec)
