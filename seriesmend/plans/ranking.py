"""Choice of detectors by latent factors (after Zhao, Rossi and Akoglu, "Automatic Unsupervised Outlier Model Selection", NeurIPS 2021): each known data set has a few factors, each detector too, and their products are to rank detectors as their performances do; a forest tells a new set's factors
from its meta-features.

Data sets are rows of a table in the shared folder with their own factors: a round moves these where the rows are, and sums of the detectors' gradients reach the driver, which holds detectors x factors numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.operators import tape
from seriesmend.operators.networks import Adam
from seriesmend.operators.tape import Node
from seriesmend.runtime import arrow_map, discard, written


def rank_gain(u: Node, v: Node, scores: np.ndarray, steep: float) -> Node:
    """The sum, over data sets, of the smoothed normalised gain of ranking detectors by u @ v: (2^performance - 1) / log2(1 + rank) relative to the best order, a rank being 1 plus the sigmoids of how far others are ahead."""
    s = u @ v
    n, m = s.value.shape
    ahead = tape.sigmoid((s.reshape(n, 1, m) - s.reshape(n, m, 1)) * steep).sum(2) + 0.5  # among the others a detector meets itself with 1/2
    gain = 2.0**scores - 1
    best = (-np.sort(-gain, axis=1) / np.log2(2 + np.arange(m))).sum(axis=1)
    return (tape.over_log(ahead + 1.0) * (gain * math.log(2) / np.maximum(best, 1e-12)[:, None])).sum()


class Ranking:
    """Fitted to a table (features: array of numbers, scores: array of a performance of 0 to 1 for each of `models`). NaN and null features count as 0, missing performances as 0."""

    def __init__(self, models: list[str], factors: int = 4, rounds: int = 30, rate: float = 0.1, steep: float = 2.0, trees: int = 30, seed: int = 42):
        self.models, self.factors, self.rounds, self.rate, self.steep, self.trees, self.seed = models, factors, rounds, rate, steep, trees, seed
        self.v = np.zeros((factors, len(models)))
        self.forests: list[RandomForestRegressionModel] = []
        self.history: list[float] = []

    def fit(self, table: DataFrame) -> Ranking:
        clean = lambda c: F.transform(c, lambda x: F.coalesce(F.when(~F.isnan(x.cast("double")), x.cast("double")), F.lit(0.0)))
        rows = table.select(array_to_vector(clean("features")).alias("x"), clean("scores").alias("scores"))
        self.scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(rows)
        scaled = self.scaler.transform(rows)
        self.width = min(self.factors, len(scaled.first()["z"]))
        start = PCA(k=self.width, inputCol="z", outputCol="p").fit(scaled).transform(scaled)
        number = T.ArrayType(T.DoubleType())
        state = T.StructType([T.StructField("z", number), T.StructField("scores", number), T.StructField("u", number)])
        now = written(start.select(vector_to_array("z").alias("z"), "scores", vector_to_array("p").alias("u")), "ranking")
        self.v = np.random.default_rng(self.seed).normal(0, 0.1, (self.width, len(self.models)))
        adam, models, width, steep, rate = Adam(self.rate), len(self.models), self.width, self.steep, self.rate
        sums_schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("gain", T.DoubleType()), T.StructField("sums", T.BinaryType())])

        def read(b):
            return b.column(1).flatten().to_numpy().reshape(b.num_rows, models), b.column(2).flatten().to_numpy().reshape(b.num_rows, width)

        for _ in range(self.rounds):
            v = self.v

            def moved(batches, v=v):
                for b in batches:
                    if b.num_rows:
                        y, u = read(b)
                        at = Node(u)
                        tape.backward(rank_gain(at, Node(v), y, steep))
                        yield {"z": b.column(0), "scores": b.column(1), "u": (u + rate * at.grad).tolist()}

            def added(batches, v=v):
                n, gain, total = 0, 0.0, np.zeros_like(v)
                for b in batches:
                    if b.num_rows:
                        y, u = read(b)
                        at = Node(v)
                        top = rank_gain(Node(u), at, y, steep)
                        tape.backward(top)
                        n, gain, total = n + len(u), gain + float(top.value), total + at.grad
                yield {"n": [n], "gain": [gain], "sums": [total.tobytes()]}

            parts = arrow_map(now, added, sums_schema).collect()  # models x factors numbers for each task
            n = max(sum(r["n"] for r in parts), 1)
            self.history.append(sum(r["gain"] for r in parts) / n)
            now, used = written(arrow_map(now, moved, state), "ranking"), now
            discard(used)
            self.v = adam.step({"v": v}, {"v": -sum(np.frombuffer(bytes(r["sums"])) for r in parts).reshape(v.shape) / n})["v"]
        points = now.select(array_to_vector("z").alias("z"), *[F.get("u", F.lit(k)).alias(f"u{k}") for k in range(width)])
        self.forests = [RandomForestRegressor(featuresCol="z", labelCol=f"u{k}", predictionCol=f"f{k}", numTrees=self.trees, seed=self.seed).fit(points) for k in range(width)]
        return self

    def predict(self, table: DataFrame) -> DataFrame:
        """The table with `ranked`: the models' names, best first, by the factors that forests tell of its features."""
        rows = self.scaler.transform(table.withColumn("x", array_to_vector(F.transform("features", lambda x: F.coalesce(F.when(~F.isnan(x.cast("double")), x.cast("double")), F.lit(0.0))))))
        for forest in self.forests:
            rows = forest.transform(rows)
        told = [sum((F.col(f"f{k}") * float(self.v[k, m]) for k in range(self.width)), F.lit(0.0)) for m in range(len(self.models))]
        order = F.sort_array(F.array(*[F.struct((-s).alias("s"), F.lit(m).alias("m"), F.lit(name).alias("name")) for m, (s, name) in enumerate(zip(told, self.models, strict=True))]))
        return rows.withColumn("ranked", F.transform(order, lambda r: r["name"])).select(*table.columns, "ranked")
