"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.llm.hamming import merge
from seriesmend.runtime import arrow_map, shared_dir

#: Edges (two longs each) that one task joins; a round of stars has some ten stages, which pays beyond that.
SMALL = 1 << 20


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node points to the least of the node and its neighbours."""
    both = _mirrored(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it point to the least of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of distinct edges of longs, by union-find over their arrays."""

    def run(batches):
        held = [np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)]) for b in batches]
        pairs = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        nodes, places = np.unique(pairs, return_inverse=True)
        u, v = places.reshape(2, -1)
        root = merge(np.arange(len(nodes)), u, v)
        yield {"node": nodes, "root": nodes[root]}

    kind = edges.schema["u"].dataType
    return arrow_map(edges.coalesce(1), run, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (u, v), two columns of one ordered type: root is the component's least node.

    Loops and repeated edges are allowed, edges with a null end are left out, and no edges give no rows. Only counts and checksums
    reach the driver. Up to SMALL edges of longs are one task's work; beyond that aggregates combine on the map side and each round's edges are checkpointed in the shared folder.
    """
    shared_dir(edges.sparkSession)
    now = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct().checkpoint()
    before = _digest(now)
    if before[0] <= SMALL and now.schema["u"].dataType == now.schema["v"].dataType == T.LongType():
        return _in_one_task(now)
    for _ in range(most_rounds):
        now = _small(_large(now)).checkpoint()
        after = _digest(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        before = after
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
