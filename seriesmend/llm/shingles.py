"""Texts whose word shingles are alike (Jaccard similarity), found by bands of minima and all verified: what the near-duplicate stage adds to SimHash.

A text's sketch has BANDS keys, each made of ROWS minima of its shingles' hashes. Two texts of similarity s share a key with probability
1 - (1 - s^ROWS)^BANDS: 0.997 at 0.8, over 0.9999 from 0.85 on. Whatever shares a key is verified on the shingles themselves, all pairs of a key but those
that are one group already; a key of many texts is dealt into pairs of chunks. No link counts unverified, and a link that fails hides no other.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.llm.hamming import merge
from seriesmend.runtime import arrow_map, worker_object

BANDS, ROWS, SEED = 24, 7, 42
#: Texts and shingles in a chunk of a key.
CHUNK_TEXTS, CHUNK_SHINGLES = 512, 1 << 20
#: Hashes and columns looked at at once.
BLOCK = 2048
_draw = np.random.default_rng(SEED)
TIMES, PLUS = (_draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
MIXED = _draw.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each shingle of `words` words joined by spaces, repeats included; a shorter text is one shingle, one without words has none.

    Words are runs of anything but ASCII white space, A-Z lower-cased.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    n = len(parts) - words + 1
    h64 = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([h64(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    return np.array([h64(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes; none of an empty one."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for lo in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[lo : lo + BLOCK, None] * TIMES + PLUS).min(axis=0), out=least)
    least ^= least >> np.uint64(32)
    key = (least.reshape(BANDS, ROWS) * MIXED).sum(axis=1, dtype=np.uint64)
    return key ^ (key >> np.uint64(29))


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets (sorted hashes) of at least that Jaccard similarity, by exact counts of what they share."""
    n = np.array([len(s) for s in sets])
    m = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
    count = np.diff(np.r_[heads, len(values)])
    often = count > 1  # shingles of one set alone are in no intersection
    rows, cols = owner[np.repeat(often, count)], np.repeat(np.arange(often.sum()), count[often])
    common = np.zeros((m, m), np.float32)
    for lo in range(0, int(often.sum()), BLOCK):
        a, b = np.searchsorted(cols, [lo, lo + BLOCK])
        part = np.zeros((m, min(BLOCK, int(often.sum()) - lo)), np.float32)
        part[rows[a:b], cols[a:b] - lo] = 1
        common += part @ part.T
    u, v = np.nonzero(np.triu(common >= similarity * (n[:, None] + n[None] - common), 1))
    return u, v


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs (u, v) whose sets are alike. sets: ent, n, shingles (sorted hashes as bytes), one row for each ent."""
    size = sets.select("ent", "n")
    # sets whose sizes are too unlike can't be that similar: they go before the sets are joined
    sized = pairs.join(size.toDF("u", "nu"), "u").join(size.toDF("v", "nv"), "v").where(F.least("nu", "nv") >= F.lit(similarity) * F.greatest("nu", "nv")).select("u", "v")
    held = sets.select("ent", "shingles")
    both = sized.join(held.toDF("u", "x"), "u").join(held.toDF("v", "y"), "v").select("u", "v", "x", "y")

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= similarity * (len(p) + len(q) - shared))
            yield {"u": b.column(0).to_numpy()[keep], "v": b.column(1).to_numpy()[keep]}

    return arrow_map(both, check, T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))


def links_between(keys: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): labels of keys (key, ent, n, label) joined by alike sets that share a key: at most a pair for each ent of a key (or pair of chunks).

    Keys of one label have nothing to join. Keys of the same ents are looked at once.
    """
    facts = keys.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"), F.min("label").alias("a"), F.max("label").alias("b"), F.bit_xor("ent").alias("all"), F.sum(F.xxhash64("ent").cast("decimal(38,0)")).alias("sum"))
    live = facts.where("a <> b").groupBy("texts", "all", "sum").agg(F.min("key").alias("key"), F.first("shingles").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("texts") / CHUNK_TEXTS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    rows = keys.join(live.select("key", chunks.alias("m")), "key").withColumn("c", F.pmod(F.xxhash64("ent"), F.col("m")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "ent", "label")
    at = ["key", "i", "j"]
    dealt = rows.join(sets.select("ent", "shingles"), "ent").select(*at, "ent", "label", "shingles").repartition(*at).sortWithinPartitions(*at, "ent")

    def links(batches):
        worker_object("none", 0)
        at_key, labels, held = None, [], []

        def solve() -> dict:
            u, v = alike(held, similarity)
            classes, place = np.unique(np.array(labels), return_inverse=True)
            root = merge(np.arange(len(classes)), place[u], place[v])
            moved = np.flatnonzero(root != np.arange(len(root)))
            return {"u": classes[moved], "v": classes[root[moved]]}

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)]
            for key, i, j, label, shingles in zip(*cols, strict=True):
                if (key, i, j) != at_key:
                    if len(held) > 1:
                        yield solve()
                    at_key, labels, held = (key, i, j), [], []
                labels.append(label)
                held.append(np.frombuffer(shingles, np.uint64))
        if len(held) > 1:
            yield solve()

    return arrow_map(dealt, links, T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))
