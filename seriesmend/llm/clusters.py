"""Centroid clustering of integer vectors by exponion search (operator 11).

Vectors are turned into integers once and packed in the narrowest width that holds them; with its cluster and two bounds a vector is a row of a table in the shared folder, written anew in each round, so that
lost executors cost a retry and the rounds before are never computed again. A round knows for each vector an upper bound of the distance to its centroid and a lower bound of the distance to every other one, both moved by what the
centroids moved. Where the upper bound is below the lower one, or below half the way from the centroid to its nearest neighbour, the vector stays without a look at any centroid. Else its distance is taken anew, and
if that doesn't settle it only centroids in a ball around its current one are scanned: nearest and second nearest are within 2 x upper bound + the way to the nearest neighbour, which is a prefix of that centroid's sorted list. The radius
is inclusive and rounded up, so that centroids at equal distance are all seen; distances are exact integers and the smaller number wins.

The driver holds centroids and their exact sums alone (k x dimensions), workers the k x k list of distances besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.runtime import arrow_map, discard, written

#: Greatest number of centroids (workers hold k x k doubles), and greatest absolute component: squared distances of up to 64 x 2^56 are longs.
MOST_CENTROIDS, LARGEST = 4096, 1 << 27
#: Bytes of a component by width, and vectors that a worker takes at once.
WIDTHS, AT_ONCE = ("<i1", "<i2", "<i4"), 16_384
#: Doubles hold squared distances exactly up to this component (64 of them at least).
EXACT = 1 << 20
FAR = np.iinfo(np.int64).max


@dataclass
class Clustering:
    """assigned: vec_id, cluster, distance (squared) and packed vector of each vector that was kept; centroids: k x dimensions."""

    assigned: DataFrame
    centroids: np.ndarray

    def digests(self) -> list[str]:
        """Hex SHA-256 of each centroid's components as decimal integers joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]

    def with_inertia(self, spark: SparkSession) -> DataFrame:
        """assigned with cluster_inertia, inertia (distances summed over the cluster, over all) and centroid_sha256: k numbers go through the driver."""
        sums = {r["cluster"]: int(r["s"]) for r in self.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
        whole, names = sum(sums.values()), self.digests()
        found = spark.createDataFrame([(c, s, whole, names[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return self.assigned.drop("packed").join(F.broadcast(found), "cluster")


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b (or one row of b)."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT and a.shape[1] <= 1 << 11:
        d = a.astype(np.float64) - b
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = a.astype(np.int64) - b
    return (d * d).sum(axis=1)


def up(x: np.ndarray) -> np.ndarray:
    """Not below x, though roots and sums were rounded."""
    return x * (1 + 1e-12) + 1e-9


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-12) - 1e-9


class Search:
    """A round: its centroids, their sorted lists, and how far each came from the round before (moved)."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        ways = np.sqrt(np.array([squares(centroids, c) for c in centroids], np.float64).reshape(k, k))
        np.fill_diagonal(ways, -1)  # the first of its own list, also among equal ones
        self.order = np.argsort(ways, axis=1, kind="stable")[:, 1:]
        self.ways = np.take_along_axis(ways, self.order, axis=1)
        self.gap = self.ways[:, 0] if k > 1 else np.full(k, np.inf)
        self.moved = up(np.sqrt(squares(centroids, before).astype(np.float64))) if before is not None else np.zeros(k)
        far = np.argsort(self.moved, kind="stable")
        #: how far any other centroid moved at most
        self.others = np.full(k, self.moved[far[-1]] if k else 0.0)
        if k > 1:
            self.others[far[-1]] = self.moved[far[-2]]
        self.scanned = 0

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) in this round; scanned counts the distances it took."""
        cluster, upper, lower = cluster.copy(), up(upper + self.moved[cluster]), down(lower - self.others[cluster])
        safe = np.maximum(lower, down(self.gap / 2)[cluster])
        rows = np.flatnonzero(upper >= safe)
        exact = squares(x[rows], self.centroids[cluster[rows]])
        self.scanned += len(rows)
        upper[rows] = up(np.sqrt(exact.astype(np.float64)))
        stay = upper[rows] >= safe[rows]
        rows, exact = rows[stay], exact[stay]
        at = cluster[rows]
        for c in np.unique(at):
            mine = np.flatnonzero(at == c)
            inside = np.searchsorted(self.ways[c], up(2 * upper[rows[mine]] + self.gap[c]), "right")
            mine = mine[np.argsort(-inside, kind="stable")]
            inside = -np.sort(-inside, kind="stable")
            best, who, second = exact[mine], np.full(len(mine), c), np.full(len(mine), FAR)
            for m, j in enumerate(self.order[c, : inside[0]]):
                n = int(np.searchsorted(-inside, -m, "left"))  # balls with more than m centroids come first
                d = squares(x[rows[mine[:n]]], self.centroids[j])
                self.scanned += n
                better = (d < best[:n]) | ((d == best[:n]) & (j < who[:n]))
                second[:n] = np.where(better, best[:n], np.minimum(second[:n], d))
                best[:n], who[:n] = np.where(better, d, best[:n]), np.where(better, j, who[:n])
            cluster[rows[mine]] = who
            upper[rows[mine]] = up(np.sqrt(best.astype(np.float64)))
            lower[rows[mine]] = np.where(second == FAR, np.inf, down(np.sqrt(second.astype(np.float64))))
        return cluster, upper, lower


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of integers, each in the narrowest of WIDTHS that holds it."""
    top = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    out: list[bytes] = [b""] * len(x)
    least = 0
    for kind in WIDTHS:
        limit = 1 << (8 * np.dtype(kind).itemsize - 1)
        rows, least = np.flatnonzero((top >= least) & (top < limit)), limit
        raw, size = x[rows].astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
        for i, r in enumerate(rows.tolist()):
            out[r] = raw[i * size : i * size + size]
    return out


def unpack(column: pa.Array, dimensions: int) -> np.ndarray:
    rows = column.to_pylist()
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.empty((len(rows), dimensions), np.int64)
    for kind in WIDTHS:
        at = np.flatnonzero(sizes == dimensions * np.dtype(kind).itemsize)
        out[at] = np.frombuffer(b"".join([rows[i] for i in at.tolist()]), kind).reshape(-1, dimensions)
    return out


def integers(column: pa.Array, dimensions: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lists that have `dimensions` components, all of them finite; floor(scale x) of these)."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    keep = np.flatnonzero(sizes == dimensions)
    values = column.take(pa.array(keep)).flatten().cast(pa.float64())
    x = np.where(np.asarray(values.is_null()), np.nan, values.to_numpy(zero_copy_only=False)).astype(np.float64).reshape(len(keep), dimensions)
    good = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[good])
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component of {np.abs(x).max():g} is beyond {LARGEST}: its squared distances would be no longs")
    return keep[good], x.astype(np.int64)


def together(batches: Iterator[pa.RecordBatch], n: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches of n rows and more: small ones put together."""
    held, size = [], 0
    for b in batches:
        held, size = [*held, b], size + b.num_rows
        if size >= n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3, seed: int = 1) -> Clustering:
    """k-means over floor(scale x component), exact in integers: `rounds` times assign all and replace each centroid that has vectors by floor(sum / count), then assign once more.

    Kept are vectors of exactly `dimensions` components, none of them null, NaN or infinite; others (null vectors too) have no row in the result. Centroids start as the k kept vectors with the smallest hex SHA-256 of "<seed>:<id>", in that order; of
    equal hashes (repeated ids) the smaller packed vector comes first, null ids come last. Fewer kept vectors than k: as many centroids; none: an empty result. Equal distances: the smaller cluster number. Repeated rows count
    each. A component whose integer is beyond LARGEST is a ValueError, k over MOST_CENTROIDS too. Other columns, whatever their names, aren't read.
    """
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"k is 1 to {MOST_CENTROIDS}")
    kind = vectors.schema[id_col].dataType
    first = T.StructType([T.StructField("id", kind), T.StructField("packed", T.BinaryType())])
    state = T.StructType([*first, T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())])
    final = T.StructType([*first, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def packed(batches):
        for b in batches:
            rows, x = integers(b.column(1), dimensions, scale)
            yield {"id": b.column(0).take(pa.array(rows)), "packed": pack(x)}

    table = written(arrow_map(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), packed, first), "clusters-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    start = table.orderBy(name.asc_nulls_last(), "packed").limit(k).select("packed").collect()
    centroids = unpack(pa.array([r[0] for r in start], pa.binary()), dimensions)
    before = None
    for r in range(rounds + 1):
        table, used = written(_assigned(table, Search(centroids, before), dimensions, final if r == rounds else state), f"clusters-round-{r}"), table
        discard(used)
        if r < rounds:
            before, centroids = centroids, _means(table, centroids)
    return Clustering(table.withColumnRenamed("id", "vec_id"), centroids)


def _assigned(table: DataFrame, search: Search, dimensions: int, schema: T.StructType) -> DataFrame:
    """The table's vectors after a round. In the first one all start from centroid 0 without bounds, which makes their ball hold whatever can be nearest."""
    begun = "cluster" in table.columns

    def run(batches):
        for b in together(batches):
            x, n = unpack(b.column(1), dimensions), b.num_rows
            held = [b.column(i).to_numpy() for i in (2, 3, 4)] if begun else [np.zeros(n, np.int32), np.full(n, np.inf), np.full(n, -np.inf)]
            cluster, upper, lower = search.assign(x, *held)
            new = {"upper": upper, "lower": lower} if "upper" in schema.names else {"distance": squares(x, search.centroids[cluster])}
            yield {"id": b.column(0), "packed": b.column(1), "cluster": cluster.astype(np.int32), **new}

    return arrow_map(table, run, schema)


def _means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, exact; clusters without any keep their centroid. A task sends k x dimensions sums at most."""
    k, d = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for b in together(batches):
            x, c = unpack(b.column(1), d), b.column(0).to_numpy()
            order = np.argsort(c, kind="stable")
            found, begins = np.unique(c[order], return_index=True)
            total[found] += np.add.reduceat(x[order], begins, axis=0)
            count += np.bincount(c, minlength=k)
        some = np.flatnonzero(count)
        yield {"cluster": np.repeat(some, d), "place": np.tile(np.arange(d), len(some)), "total": total[some].ravel(), "n": np.repeat(count[some], d)}

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("cluster", "place", "total", "n")])
    parts = arrow_map(table.select("cluster", "packed"), sums, schema)
    new = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        new[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return new
