"""Outliers by distance from a weighted set of shapes that batches of windows keep up to date (after Boniol, Paparrizos, Palpanas and Franklin, "SAND", VLDB 2021; shapes after Paparrizos and Gravano, "k-Shape", SIGMOD 2015).

Shapes are clusters under the shape-based distance 1 - max of the normalised cross-correlation over all shifts, which a task takes of its windows by FFT. What a cluster's shape is made of, the sum of products of its aligned windows, is added up where the windows are:
a task sends shapes x length x length numbers, whatever its rows, and the driver takes one eigenvector of each. These sums are the model's memory too: a new batch is clustered by itself, its clusters are matched with the shapes there are, and the sums of matching ones go on from the
old ones. So batches of a table and micro-batches of a stream go the same way.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmend.operators.networks import _PARTS, FEW, Blocks, _added, _grouped, row_scores, window_blocks, window_scores
from seriesmend.runtime import arrow_map
from seriesmend.spec import SeriesSpec


def standard(x: np.ndarray) -> np.ndarray:
    """Rows of mean 0 and deviation 1; constant rows are 0."""
    d = x - x.mean(axis=-1, keepdims=True)
    s = x.std(axis=-1, keepdims=True)
    return np.where(s > 1e-12, d / np.where(s > 1e-12, s, 1), 0.0)


def correlations(x: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(greatest normalised cross-correlation, the shift of x that has it) of each row of x (n x L) with each shape: n x shapes. Of equal ones the least shift; with a row of zeros the correlation is 0."""
    size = x.shape[1]
    wide = 1 << (2 * size - 1).bit_length()
    both = np.fft.irfft(np.fft.rfft(x, wide)[:, None] * np.conj(np.fft.rfft(shapes, wide))[None], wide)
    both = np.concatenate([both[..., wide - size + 1 :], both[..., :size]], axis=-1)
    at = both.argmax(axis=-1)
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(shapes, axis=1)[None]
    best = np.take_along_axis(both, at[..., None], axis=-1)[..., 0]
    return np.where(norm > 0, best / np.where(norm > 0, norm, 1), 0.0), at - (size - 1)


def aligned(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Each row moved back by its shift, zeros where it has nothing."""
    at = np.arange(x.shape[1])[None] + shift[:, None]
    inside = (at >= 0) & (at < x.shape[1])
    return np.where(inside, np.take_along_axis(x, np.where(inside, at, 0), axis=1), 0.0)


def shape_of(products: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The shape that is most correlated with the windows of these sums: the first eigenvector of their centred products, on the side of their sum."""
    q = np.eye(len(total)) - 1 / len(total)
    v = np.linalg.eigh(q @ products @ q)[1][:, -1]
    return standard(v if v @ total >= 0 else -v)


@dataclass
class Sums:
    """Of each cluster: windows, their distances added up, the sum of aligned windows and of their products."""

    n: np.ndarray
    far: np.ndarray
    total: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, k: int, size: int) -> Sums:
        rows = flat.reshape(k, 2 + size + size * size)
        return Sums(rows[:, 0], rows[:, 1], rows[:, 2 : 2 + size], rows[:, 2 + size :].reshape(k, size, size))


def cluster_sums(x: np.ndarray, label: np.ndarray, shapes: np.ndarray, shift: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Sums (flat) of windows x, which are in the clusters `label`."""
    k, size = shapes.shape
    out = np.zeros((k, 2 + size + size * size))
    moved = aligned(x, shift)
    for c in np.unique(label):
        mine = label == c
        y = moved[mine]
        out[c] = np.r_[mine.sum(), (1 - near[mine]).sum(), y.sum(0), (y.T @ y).ravel()]
    return out.ravel()


def _summed(blocks: Blocks, stride: int, shapes: np.ndarray, target: np.ndarray | None, seed: int, first: bool) -> Sums:
    """Sums over all windows that start at a multiple of stride. first: clusters by hash, not aligned; target: the nearest shape's windows are added, aligned to the shape target[nearest] and to its sums."""
    shape, goals = blocks.shape, shapes if target is None else target[0]
    k = len(goals)

    def work(batches):
        total, n = np.zeros(k * (2 + shape[0] + shape[0] ** 2)), 0
        for x, marks in _grouped(batches, shape, 2):
            starts = np.concatenate([m[0][1] + np.arange(m[2] - m[1]) for m in marks])
            some = starts % stride == 0
            x = standard(x[some, :, 0])
            if not len(x):
                continue
            if first:
                seeds = np.concatenate([np.full(m[2] - m[1], zlib.crc32(f"{seed}:{m[0][0]}".encode()), np.uint64) for m in marks])[some]
                mixed = (seeds + starts[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                label, shift, near = (mixed >> np.uint64(40)).astype(np.int64) % k, np.zeros(len(x), np.int64), np.zeros(len(x))
            else:
                near, shift = correlations(x, shapes)
                label = near.argmax(axis=1)
                near, shift = (np.take_along_axis(v, label[:, None], axis=1)[:, 0] for v in (near, shift))
                if target is not None:
                    label = target[1][label]
                    near, shift = correlations(x, goals)
                    near, shift = (np.take_along_axis(v, label[:, None], axis=1)[:, 0] for v in (near, shift))
            total += cluster_sums(x, label, goals, shift, near)
            n += len(x)
        if n:
            yield {"n": [n], "losses": [[]], "sums": [total.tobytes()]}

    rows = arrow_map(blocks.table.select("sample", "begin", "values"), work, _PARTS)
    if blocks.tasks > FEW:
        rows = arrow_map(rows.repartition(max(1, int(blocks.tasks**0.5))), _added, _PARTS)
    parts = [np.frombuffer(bytes(r["sums"])) for r in rows.collect()]
    return Sums.of(sum(parts) if parts else np.zeros(k * (2 + shape[0] + shape[0] ** 2)), k, shape[0])


def k_shape(blocks: Blocks, k: int = 6, stride: int = 1, rounds: int = 10, seed: int = 1) -> tuple[np.ndarray, Sums]:
    """(shapes, their last sums) of all windows by k-Shape: at most k, those that have windows. It ends where the distances added up lessen no more, or after `rounds`."""
    sums = _summed(blocks, stride, np.zeros((k, blocks.length)), None, seed, True)
    shapes, before = np.zeros((0, blocks.length)), np.inf
    for _ in range(rounds):
        some = sums.n > 0
        if not some.any():
            break
        shapes = np.array([shape_of(p, t) for p, t in zip(sums.products[some], sums.total[some], strict=True)])
        sums = _summed(blocks, stride, shapes, None, seed, False)
        if sums.far.sum() >= before * (1 - 1e-9):
            break
        before = sums.far.sum()
    some = sums.n > 0
    return shapes[some[: len(shapes)]] if len(shapes) else shapes, Sums(sums.n[some], sums.far[some], sums.total[some], sums.products[some])


@dataclass
class ShapeModel:
    """The weighted set of shapes after some batches. near: mean distance of a shape's windows; last: the batch that it last had windows in; weight: what it had in the last scores; mean, spread: of the scores so far."""

    length: int
    alpha: float = 0.5
    batch: int = 0
    shapes: list[list[float]] = field(default_factory=list)
    products: list[list[list[float]]] = field(default_factory=list)
    total: list[list[float]] = field(default_factory=list)
    n: list[float] = field(default_factory=list)
    near: list[float] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    mean: float | None = None
    spread: float = 1.0

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON below path, by batch."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={self.batch}")

    @staticmethod
    def load(spark: SparkSession, path: str, batch: int) -> ShapeModel:
        return ShapeModel(**json.loads(spark.read.parquet(f"{path}/batch={batch}").first()[0]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shape-based distances of rows of a and b."""
    return 1 - correlations(a, b)[0]


def absorb(model: ShapeModel, blocks: Blocks, k: int = 6, stride: int = 1, rounds: int = 10, seed: int = 1) -> ShapeModel:
    """The model after one more batch of windows: a cluster nearer to a shape than that shape's windows are in the mean goes into it, others become shapes. Weights are frequency^2 / distance from the other shapes, both brought to 1 to 2, less the longer a shape had
    no windows, and move by alpha from what they were."""
    shapes, sums = k_shape(blocks, k, stride, rounds, seed)
    new = ShapeModel(**asdict(model))
    new.batch += 1
    if len(shapes):
        old = np.array(model.shapes).reshape(-1, model.length)
        goals, to = [*old], []
        for c, shape in enumerate(shapes):
            d = distances(shape[None], old)[0] if len(old) else np.zeros(0)
            j = int(d.argmin()) if len(d) else -1
            if j >= 0 and d[j] < model.near[j]:
                to.append(j)
            else:
                to.append(len(goals))
                goals.append(shapes[c])
        sums = _summed(blocks, stride, shapes, (np.array(goals), np.array(to)), seed, False)
        for j in range(len(goals)):
            if j < len(old):
                if not sums.n[j]:
                    continue
                products, total, n = np.array(model.products[j]) + sums.products[j], np.array(model.total[j]) + sums.total[j], model.n[j] + sums.n[j]
                near = (model.n[j] * model.near[j] + sums.far[j]) / n
                values = (shape_of(products, total), products, total, n, near, new.batch)
            else:
                values = (goals[j], sums.products[j], sums.total[j], sums.n[j], sums.far[j] / max(sums.n[j], 1), new.batch)
            for name, v in zip(("shapes", "products", "total", "n", "near", "last"), values, strict=True):
                v = v.tolist() if isinstance(v, np.ndarray) else float(v) if name != "last" else v
                column = getattr(new, name)
                column[j:] = [v] if j == len(column) else [v, *column[j + 1 :]]
    all_shapes = np.array(new.shapes).reshape(-1, model.length)
    apart = distances(all_shapes, all_shapes).sum(axis=1) - np.diag(distances(all_shapes, all_shapes)) if len(all_shapes) else np.zeros(0)
    unit = lambda x: (x - x.min()) / (x.max() - x.min() + 1e-7) + 1 if len(x) else x
    fresh = unit(np.array(new.n)) ** 2 / unit(apart) / (1 + new.batch - np.array(new.last))
    kept = np.array([*model.weight, *fresh[len(model.weight) :]])
    new.weight = ((1 - model.alpha) * kept + model.alpha * fresh).tolist()
    return new


def shape_scores(model: ShapeModel, df: DataFrame, spec: SeriesSpec, pattern: int) -> tuple[DataFrame, ShapeModel]:
    """(the table with `score`, the model with its mean and spread moved): the weighted distance of the window of `pattern` rows from its nearest place in each shape, as a mean over windows up to the row, in deviations from the scores so far."""
    blocks = window_blocks(df, spec, pattern)
    shapes = np.array(model.shapes).reshape(-1, model.length)
    parts = standard(np.lib.stride_tricks.sliding_window_view(shapes, pattern, axis=1)) if len(shapes) else np.zeros((0, 1, pattern))
    weight = np.array(model.weight)

    def far(x):
        y = standard(x[:, :, 0])
        if not weight.sum():
            return np.zeros(len(y))
        best = np.stack([(y @ p.T).max(axis=1) for p in parts], axis=1)
        return np.sqrt(np.maximum(2 * (pattern - best), 0)) @ weight / weight.sum()

    rows = row_scores(df, spec, window_scores(blocks, far), pattern, 0)
    rows = rows.withColumn("score", F.avg("score").over(spec.rows(pattern - 1, 0)))
    got = rows.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    m, s = got["m"] or 0.0, got["s"] or 0.0
    new = ShapeModel(**asdict(model))
    new.mean = m if model.mean is None else (1 - model.alpha) * model.mean + model.alpha * m
    new.spread = s if model.mean is None else (1 - model.alpha) * model.spread + model.alpha * s
    return rows.withColumn("score", (F.col("score") - new.mean) / (new.spread if new.spread > 0 else 1.0)), new


def sand(df: DataFrame, spec: SeriesSpec, pattern: int = 8, length: int | None = None, k: int = 6, stride: int | None = None, rounds: int = 10, seed: int = 1) -> DataFrame:
    """The table with `score`, from one batch: shapes of `length` (4 x pattern) rows of the first feature, from windows at every stride-th row (1.5 x pattern). Missing values are filled linearly; series shorter than a pattern count with distance 0."""
    length = length or 4 * pattern
    one = SeriesSpec(spec.features[:1], spec.sample, spec.t, spec.timestamp)
    model = absorb(ShapeModel(length), window_blocks(df, one, length), k, stride or max(1, int(1.5 * pattern)), rounds, seed)
    return shape_scores(model, df, one, pattern)[0]


def sand_batches(batches: Iterable[DataFrame], spec: SeriesSpec, length: int, pattern: int, k: int = 6, stride: int = 1, rounds: int = 10, seed: int = 1, model: ShapeModel | None = None):
    """(scored batch, model) one after another: each batch is absorbed, then scored. Windows lie within a batch."""
    model = model or ShapeModel(length)
    one = SeriesSpec(spec.features[:1], spec.sample, spec.t, spec.timestamp)
    for df in batches:
        begins = df.withColumn(spec.t, F.col(spec.t) - F.min(spec.t).over(spec.whole))
        model = absorb(model, window_blocks(begins, one, length), k, stride, rounds, seed)
        scored, model = shape_scores(model, begins, one, pattern)
        first = df.groupBy(F.col(spec.sample).alias("__s")).agg(F.min(spec.t).alias("__first"))
        scored = scored.join(first, F.col(spec.sample).eqNullSafe(F.col("__s"))).withColumn(spec.t, F.col(spec.t) + F.col("__first")).drop("__s", "__first")
        yield scored, model


def sand_stream(stream: DataFrame, spec: SeriesSpec, path: str, length: int, pattern: int, **how):
    """A started query over a stream of batches of whole rows (sample, t, features): scores go to <path>/scores/batch=<id>, the model after each batch to <path>/models. A batch that is run again starts from the model before it and writes the same rows."""

    def step(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        model = ShapeModel.load(spark, f"{path}/models", batch) if batch else None
        for scored, after in sand_batches([df], spec, length, pattern, model=model, **how):
            scored.write.mode("overwrite").parquet(f"{path}/scores/batch={batch}")
            after.save(spark, f"{path}/models")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint")
