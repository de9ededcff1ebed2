"""Token counts by a map-side two-tier lookup (operator 6).

The texts are never shuffled and neither are their pre-tokens. Tier one is a compact broadcast table of frequent pre-tokens
and their numbers of tokens (a string and an array of int32); each Python worker opens it as a hash table. Tier two is the worker's own
cache: what the table misses is encoded by the library in batches and kept, up to ``CACHE`` entries.

Why counts may be summed: a SentencePiece BPE vocabulary none of whose pieces has a word-start mark after another
character never merges across the start of a run of marks, so that a text's tokens are those of its pre-tokens (a run of marks and what
follows up to the next one). ``PieceCounter`` checks that of the vocabulary, tries it on PROBE against the library, and encodes whole texts where it doesn't hold.

The table is filled from a bounded sample of texts (``sample_rows``). It saves time only: no count depends on it.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.llm.vocab import default_path
from seriesmend.runtime import arrow_map, worker_object

MARK = "▁"
#: Entries and length of a pre-token in a worker's cache; beyond CACHE entries it starts anew.
CACHE, LONGEST = 400_000, 48
SAMPLE_ROWS, SAMPLE_CHARS, TABLE_SIZE = 2_000, 1 << 15, 1 << 16
#: Texts on which counts by pre-tokens must be the library's: white space of all kinds, marks, what a normalizer may change, special strings.
PROBE = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\ta\nb\r\nc", "a\u3000b\u00a0c\u2003d", "Å 　", "▁a ▁▁ b▁", "ﬁne ① ½ ｆｕｌｌ", "x\u0301 é e\u0301", "<s> </s> <unk> <0x0A>", "日本語 テスト", "🙂 🙂🙂", "a\x00b\x1cc\x85d", "it's 1,000.5%!? -- \"q\"", "w" * 300]


class PieceCounter:
    """Counts the tokens of texts as SentencePiece does, through a cache of pre-tokens."""

    def __init__(self, path: str, table: dict[str, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.frequent = dict(table or {})
        self.cache = dict(self.frequent)
        self.splits = self.splits and self.count(PROBE) == self.lengths(PROBE)
        self.cache = dict(self.frequent)

    def lengths(self, tokens: list[str]) -> list[int]:
        """Tokens of each pre-token, which goes without its first mark. One that is empty is a lone mark at the end of a text."""
        return [len(x) for x in self.model.encode(tokens, num_threads=1)]

    def learn(self, missing: set[str]) -> dict[str, int]:
        """The lengths of all that is in the cache and of missing, of which the cache keeps what isn't long."""
        new = list(missing)
        got = dict(zip(new, self.lengths(new), strict=True))
        known = self.cache
        if len(known) > CACHE:
            self.cache = dict(self.frequent)
        self.cache.update((k, v) for k, v in got.items() if len(k) <= LONGEST)
        return ChainMap(got, known) if known is not self.cache or any(len(k) > LONGEST for k in got) else known

    @staticmethod
    def split(text: str) -> list[str]:
        """Pre-tokens, each without its first mark."""
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" in parts:  # runs of spaces belong to what follows them
            parts = [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
        return parts

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self.lengths(texts)
        split = [self.split(x) if x else [] for x in texts]
        known = self.cache
        missing = {p for parts in split for p in parts if p not in known}
        missing.discard("")
        if missing:
            known = self.learn(missing)
        return [sum([known[p] if p else 1 for p in parts]) for parts in split]  # 1: a lone mark


def counter(path: str, table) -> PieceCounter:
    """The worker's counter; it outlives tasks."""

    def make() -> PieceCounter:
        blob, lengths = table.value
        words = blob.decode().split("\n") if blob else []
        return PieceCounter(path, dict(zip(words, lengths.tolist(), strict=True)))

    return worker_object("pieces", path, make)


def frequent_table(docs: DataFrame, text_col: str, path: str, sample_rows: int, size: int) -> tuple:
    """(pre-tokens, one a line; their lengths) of the most frequent pre-tokens of at most sample_rows texts (SAMPLE_CHARS of each). Its size is bounded by
    size x LONGEST characters."""
    rows = docs.select(F.left(F.col(text_col), F.lit(SAMPLE_CHARS))).where(F.col(text_col).isNotNull()).take(sample_rows)
    seen: Counter = Counter()
    for (text,) in rows:
        seen.update(p for p in PieceCounter.split(text) if p and len(p) <= LONGEST and "\n" not in p)
        if len(seen) > 20 * size:
            seen = Counter(dict(seen.most_common(10 * size)))
    model = PieceCounter(path)
    words = [w for w, _ in seen.most_common(size)]
    return "\n".join(words).encode(), np.array(model.lengths(words) if words else [], np.int32)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096,
                 sample_rows: int = SAMPLE_ROWS, table_size: int = TABLE_SIZE) -> DataFrame:
    """One row for each row of docs: doc_id (id_col), n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens. Null ids stay null; repeated rows are counted each; ties don't matter, since no
    row depends on another; an empty table gives an empty one. Other columns, whatever their names, aren't read. Very long
    texts are counted whole: pre-tokens over LONGEST characters aren't cached, but encoded.
    """
    path = model_path or default_path("piece_bpe_32k.model")
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_table(docs, text_col, path, sample_rows, table_size))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches):
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = np.array(counter(path, table).count(texts), np.int64)
            yield {"doc_id": b.column(0), "n_bytes": pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0), "n_tokens": n, "over_limit": n > limit}

    return arrow_map(docs.select(id_col, text_col), count, schema)
