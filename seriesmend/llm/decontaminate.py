"""Benchmark decontamination by one Aho-Corasick automaton over normalised items (operator 7).

Every item gives its windows of `window` consecutive words (a shorter item is one window). All windows make one automaton, which
scans each normalised text once; a match's place is mapped to words and, for spans, to characters of the original text. Documents are read
once and not shuffled. The automaton goes to the workers in a broadcast variable, for which the items' size is checked; items beyond
``MOST_BYTES`` are dealt into blocks below it, each scans the documents, and the blocks' hits are united by document content.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.llm.words import joined, spaces, word_places
from seriesmend.runtime import arrow_map, worker_object

WINDOW = 10
#: UTF-8 bytes of items in one automaton, which needs some 50 times as much in a worker.
MOST_BYTES = 4 << 20


def windows(items: list[tuple], window: int) -> dict[bytes, list[int]]:
    """Window (with a space on either side) -> places of its items in the list."""
    found: dict[bytes, list[int]] = {}
    for k, (_, text) in enumerate(items):
        words = joined(text)[0].split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            of = found.setdefault(b" %b " % b" ".join(words[i : i + window]), [])
            if not of or of[-1] != k:
                of.append(k)
    return found


class Scanner:
    def __init__(self, items: list[tuple], window: int):
        self.ids = [x for x, _ in items]
        self.machine = ahocorasick.Automaton()
        for text, of in windows(items, window).items():
            self.machine.add_word(text.decode("latin-1"), (len(text), text.count(b" ") - 1, of))
        self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(words of the text, runs (first, one past the last) of hit words, ids of the items whose windows occur)."""
        line, n = joined(text)
        if not n or not len(self.machine):
            return n, [], set()
        found = list(self.machine.iter(line.decode("latin-1")))
        if not found:
            return n, [], set()
        ends = np.array([e for e, _ in found])
        first = np.searchsorted(spaces(line), ends - np.array([v[0] for _, v in found]) + 1)
        runs: list[list[int]] = []
        for a, b in sorted(zip(first.tolist(), (first + np.array([v[1] for _, v in found])).tolist(), strict=True)):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        return n, [tuple(r) for r in runs], {self.ids[k] for _, v in found for k in v[2]}


def scanner(items, window: int) -> Scanner:
    """The worker's scanner for a broadcast list of items."""
    return worker_object("scanner", (items.value[0], window), lambda: Scanner(items.value[1], window))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int) -> list[list[tuple]]:
    """The items as (id string, text) in blocks of at most most_bytes, or one item. Null texts have no words and are left out."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), text_col).distinct()
    size, n = rows.agg(F.sum(F.octet_length(text_col)), F.count("*")).first()
    blocks: list[list[tuple]] = [[]]
    k = max(1, -(-(size or 0) // most_bytes))
    if k == 1:
        return [[tuple(r) for r in rows.collect()]] if n else [[]]
    for part in range(k):  # about most_bytes of items come to the driver at a time
        blocks.append([tuple(r) for r in rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(k)) == part).collect()])
    return [b for b in blocks if b]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES, keep: bool = False, spans: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 (of the item ids
    with occurring windows, sorted as strings, comma-joined), contaminated (n_hit > 0); with spans also spans: array of (start, end) in characters
    of the original text. keep=True: the rows of docs that aren't contaminated, with their own columns only.

    Null and empty texts have no words; null ids stay; repeated rows are judged each; items without words or with a null text never occur, those with a null id
    count as hits without being named; an empty benchmark leaves all clean, an empty table gives an empty one. Other columns, whatever their names,
    aren't read.
    """
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, item_col, item_text_col, most_bytes)
    if len(blocks) > 1:
        return _by_blocks(docs, blocks, id_col, text_col, window, keep, spans)
    items = spark.sparkContext.broadcast(_named(blocks[0]))
    at = docs.columns.index(text_col)
    if keep:
        def clean(batches):
            for b in batches:
                good = [not scanner(items, window).scan(x)[1] for x in b.column(at).to_pylist()]
                yield {c: x for c, x in zip(b.schema.names, b.filter(pa.array(good, pa.bool_())).columns, strict=True)}

        return arrow_map(docs, clean, docs.schema)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))

    def judge(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in fields[1:]}
            for text in b.column(1).to_pylist():
                n, runs, hit = scanner(items, window).scan(text)
                _row(out, text, n, runs, hit, spans)
            yield {"doc_id": b.column(0), **out}

    return arrow_map(docs.select(id_col, text_col), judge, T.StructType(fields))


def _named(block: list[tuple]) -> tuple[str, list[tuple]]:
    """A digest of a block and the block in a fixed order."""
    block = sorted(block, key=lambda r: (r[0] or "", r[1]))
    return hashlib.sha256(repr(block).encode()).hexdigest(), block


def _row(out: dict[str, list], text: str | None, n: int, runs: list, hit: set, spans: bool) -> None:
    hits = sum(b - a for a, b in runs)
    for name, value in (("n_words", n), ("n_hit", hits), ("n_items", len(hit)), ("items_sha256", hashlib.sha256(",".join(sorted(x for x in hit if x is not None)).encode()).hexdigest()), ("contaminated", hits > 0)):
        out[name].append(value)
    if spans:
        if runs:
            start, end = word_places(text or "")
        out["spans"].append([{"start": int(start[a]), "end": int(end[b - 1])} for a, b in runs])


def _by_blocks(docs: DataFrame, blocks: list[list[tuple]], id_col: str, text_col: str, window: int, keep: bool, spans: bool) -> DataFrame:
    """The same with several blocks of items. Hits of a text are gathered by its SHA-256, which the texts themselves don't follow."""
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    hit_type = T.StructType([T.StructField("key", T.StringType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))])
    found = None
    for block in blocks:
        items = docs.sparkSession.sparkContext.broadcast(_named(block))

        def hits(batches, items=items):
            for b in batches:
                out: dict[str, list] = {"key": [], "runs": [], "items": []}
                for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    _, runs, hit = scanner(items, window).scan(text)
                    if runs:
                        for name, value in (("key", k), ("runs", [list(r) for r in runs]), ("items", sorted(hit, key=lambda x: x or ""))):
                            out[name].append(value)
                yield out

        part = arrow_map(docs.select(key.alias("key"), text_col), hits, hit_type).distinct()
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    if keep:
        return docs.join(found, key == found["key"], "left_anti")
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))

    def judge(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in fields[1:]}
            for text, runs, hit in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, e in sorted(runs or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([a, e])
                _row(out, text, joined(text)[1], merged, set(hit or []), spans)
            yield {"doc_id": b.column(0), **out}

    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), key.alias("key"))
    return arrow_map(slim.join(found, "key", "left").select("__id", "__text", "runs", "items"), judge, T.StructType(fields))
