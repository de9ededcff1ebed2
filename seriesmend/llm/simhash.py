"""SimHash near-duplicates with a Gray-order hierarchical index (operator 4).

Fingerprints are made where the texts are read. Only distinct ones go on: a group of exact copies is one row, whatever its size.

Links are found exactly. Two fingerprints at most r bits apart agree on at least k of r + k blocks of bits, so each is sent to one
segment for every choice of k blocks, keyed by those bits; ``blocks_for`` raises k with the number of fingerprints, which keeps segments
small at any size. A segment of over SEGMENT rows is dealt into chunks and each pair of chunks becomes a segment of
its own, so that no task gets an unbounded group. In each segment the Gray-order index finds links, of which a spanning forest is
emitted, never all pairs; star-contraction rounds join the forests.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.llm.components import components
from seriesmend.llm.hamming import forest
from seriesmend.llm.shingles import SEED, band_keys, links_between, shingle_hashes, verified
from seriesmend.runtime import arrow_map, columns_of, discard, unused, worker_object, written

WORDS, RADIUS = 4, 4
#: Mean rows of a segment that are aimed at, rows of a chunk, and rows that a task looks at at once.
AIM, SEGMENT, AT_HAND = 512, 2048, 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes."""
    if len(hashes) <= 1:
        return int(hashes[0]) if len(hashes) else 0
    raw, ones = hashes.astype("<u8", copy=False), np.zeros(64, np.int64)
    for lo in range(0, len(raw), 4096):
        ones += np.unpackbits(raw[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned SimHash of a text; 0 without words. Shingles count as often as they occur; a bit is 1 if it is set in over half of their XXH64."""
    return majority(shingle_hashes(text, words, seed))


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """docs with the fingerprint of each text as a signed long. docs must not have a column of that name."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    at = docs.columns.index(text_col)

    def run(batches):
        worker_object("none", 0)
        for b in batches:
            fp = np.array([fingerprint(x, words, seed) for x in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield {**{c: b.column(i) for i, c in enumerate(b.schema.names)}, name: fp}

    return arrow_map(docs, run, schema)


def blocks_for(n: int, radius: int, aim: int = AIM) -> tuple[list[tuple[int, int]], int]:
    """(blocks as (first bit, bits), k of them in a key) for n fingerprints."""
    k = 1
    while n / 2 ** (64 * k / (radius + k)) > aim and comb(radius + k + 1, k + 1) <= 330:
        k += 1
    cuts = [round(i * 64 / (radius + k)) for i in range(radius + k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], k


def segment_keys(fp: Column, blocks: list[tuple[int, int]], k: int) -> Column:
    """Array of (choice, value): for each choice of k blocks, the bits of fp in them."""
    masks = [sum(((1 << n) - 1) << a for a, n in chosen) for chosen in combinations(blocks, k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)])


def link_forest(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): fingerprint pairs that connect what all links of at most radius bits connect, and no more. prints: distinct, in column fp."""
    blocks, k = blocks_for(prints.count(), radius)
    rows = prints.select("fp", F.explode(segment_keys(F.col("fp"), blocks, k)).alias("key")).select("fp", "key.choice", "key.value")
    large = rows.groupBy("choice", "value").count().where(F.col("count") > SEGMENT).select("choice", "value", F.ceil(F.col("count") / SEGMENT).cast("int").alias("m"))
    rows = rows.join(large, ["choice", "value"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("choice", "value", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    key = ["choice", "value", "i", "j"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def links(batches):
        worker_object("none", 0)
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray) -> dict:
            heads = np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]
            u, v = forest(np.cumsum(heads), rows[:, 4].copy().view(np.uint64), radius)
            return {"u": u.view(np.int64), "v": v.view(np.int64)}

        for b in batches:
            held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1))
            if sum(map(len, held)) >= AT_HAND:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
                cut = last[-1] + 1 if len(last) else 0  # the last segment may go on
                if cut:
                    yield solve(rows[:cut])
                held = [rows[cut:]]
        if held and sum(map(len, held)):
            yield solve(np.concatenate(held))

    return arrow_map(dealt, links, schema)


def component_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for distinct fingerprints: the least fingerprint that links reach."""
    found = components(link_forest(prints, radius))
    return prints.select("fp").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links of at most radius bits reach).

    Null, empty and blank texts have fingerprint 0, which links like any other. Null ids stay, and don't count for component_id unless
    a component has no other (then it is null). Repeated rows stay, ties are the same row's values, an empty table gives an empty one,
    and other columns, whatever their names, aren't read.
    """
    rows = written(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words=words, seed=seed).select("doc_id", "fp"), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of = written(component_of(least, radius).join(least, "fp"), "fingerprint-roots")
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, row: str, text_col: str, words: int, seed: int) -> DataFrame:
    """(row, ent, fp, n, keys) of docs: row's value; a name of the text's shingles (equal shingles, equal names); fingerprint; number of distinct shingles; band keys."""
    schema = T.StructType([T.StructField("row", docs.schema[row].dataType), *[T.StructField(c, T.LongType()) for c in ("ent", "fp", "n")], T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        worker_object("none", 0)
        for b in batches:
            ents, prints, sizes, keys = [], [], [], []
            for text in b.column(1).to_pylist():
                hashes = shingle_hashes(text, words, seed)
                distinct = np.unique(hashes)
                prints.append(majority(hashes))
                ents.append(xxhash.xxh64_intdigest(distinct.tobytes() + prints[-1].to_bytes(8, "little"), seed))
                sizes.append(len(distinct))
                keys.append(band_keys(distinct).view(np.int64))
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield {"row": b.column(0), "ent": signed(ents), "fp": signed(prints), "n": sizes, "keys": keys}

    return arrow_map(docs.select(row, text_col), run, schema)


def shingle_sets(docs: DataFrame, ent: str, text_col: str, words: int, seed: int) -> DataFrame:
    """(ent, n, shingles): each row's distinct shingle hashes, sorted, as bytes."""
    schema = T.StructType([T.StructField("ent", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches):
        for b in batches:
            found = [np.unique(shingle_hashes(x, words, seed)) for x in b.column(1).to_pylist()]
            yield {"ent": b.column(0), "n": [len(x) for x in found], "shingles": [x.tobytes() for x in found]}

    return arrow_map(docs.select(ent, text_col), run, schema)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = RADIUS, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """The rows of docs without near-duplicates: of each group, one row of the smallest id (nulls last) stays, with all its columns.

    Texts are linked if their distinct shingles of `words` words have a Jaccard similarity of at least `similarity`, and a group is what links reach. Candidates are
    fingerprints of at most radius bits apart (operator 4) and texts that share a key of minima (see shingles); all are verified. Rows of one id: the one with the least hash of its columns
    (maps aside) stays; of equal rows one. Null, empty and blank texts are one group. An empty table gives an empty one; other columns' names don't matter.
    """
    row, mine, copies, ent = (unused(docs, x) for x in ("near_row", "near_kept", "near_copies", "near_ent"))
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    # with the id beside it, so that a hash's collisions stay within an id
    known = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("hash"))
    rows = docs.withColumn(row, known)
    seen = written(sketches(rows, row, text_col, words, seed), "sketches")
    ents = written(seen.groupBy("ent").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "texts")
    # links of fingerprints, and of the texts of one fingerprint, as links of texts
    least = ents.groupBy("fp").agg(F.min("ent").alias("least"))
    near = link_forest(least, radius)
    near = near.join(least.toDF("u", "lu"), "u").join(least.toDF("v", "lv"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    near = written(near.union(ents.join(least, "fp").where("ent <> least").select("ent", "least")), "near-links")
    keys = ents.select("ent", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key")
    keys = written(keys.join(shared, "key", "left_semi"), "shared-keys")
    wanted = near.select(F.col("u").alias("ent")).union(near.select("v")).union(keys.select("ent")).distinct()
    texts = rows.join(ents.join(wanted, "ent", "left_semi").select(F.col("row").alias(mine), F.col("ent").alias(ent)), F.col(row) == F.col(mine)).select(ent, text_col)
    sets = written(shingle_sets(texts, ent, text_col, words, seed).dropDuplicates(["ent"]), "shingle-sets")
    of = components(verified(near, sets, similarity)).select(F.col("node").alias("ent"), F.col("root").alias("label"))
    of = written(ents.select("ent").join(of, "ent", "left").select("ent", F.coalesce("label", "ent").alias("label")), "labels")
    top = components(links_between(keys.join(of, "ent"), sets, similarity)).select(F.col("node").alias("label"), F.col("root").alias("top"))
    groups = ents.select("ent", "row").join(of, "ent").join(top, "label", "left").groupBy(F.coalesce("top", "label").alias("top")).agg(F.min("row").alias(mine))
    keep = written(groups.select(mine).join(seen.groupBy(F.col("row").alias(mine)).agg(F.count("*").alias(copies)), mine), "kept-rows")
    discard(seen, ents, near, keys, sets, of)
    kept = rows.join(keep, F.col(row) == F.col(mine))
    once, more = kept.where(F.col(copies) == 1), kept.where(F.col(copies) > 1).dropDuplicates([mine])
    return once.select(*columns_of(docs)).unionByName(more.select(*columns_of(docs)))
