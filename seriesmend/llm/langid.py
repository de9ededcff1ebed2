"""Language identification by averaged hashed subword embeddings with a linear softmax (operator 1).

A text is lower-cased, whatever isn't a letter becomes a space between words, and every run of 1 to 4 characters inside a word (with
its edges) is hashed to one of BUCKETS rows of an embedding table. The mean of the rows goes through a linear softmax. Both are
trained here by stochastic gradient descent in numpy, on a bounded sample of labelled rows: at most ``max_rows``, in equal shares
for each language. A part of the sample is left out of training; on it the softmax gets its temperature and the least score and least share of known
subwords at which a prediction is accepted (calibrated rejection).

Since the mean and the softmax's map are linear, workers get their product: a row of logits for each bucket. Texts are read whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.runtime import arrow_map, worker_object

BUCKETS, WIDTH, LONGEST = 1 << 17, 16, 4
MAX_ROWS = 3000
#: The model that goes to the workers has a number for each bucket and language.
MOST_LANGUAGES = 256
#: Share of calibration items with a right answer that may be rejected.
REJECTED = 0.001
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def _letters() -> np.ndarray:
    return worker_object("letters", 0, lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def normal(text: str | None) -> np.ndarray:
    """Code points of the words with a space before, between and after them; none without a letter."""
    a = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[a]
    if not letter.any():
        return np.zeros(0, np.uint32)
    a = np.where(letter, a, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first separator after a word
    a = a[keep]
    return np.concatenate([[np.uint32(32)], a, [np.uint32(32)] if a[-1] != 32 else np.zeros(0, np.uint32)]).astype(np.uint32)


def subwords(a: np.ndarray) -> np.ndarray:
    """Buckets of all subwords of what normal() gave."""
    found = []
    inner = a != 32
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    h = a * MULTIPLIERS[0]
    found.append((h[inner] * MULTIPLIERS[3]) >> shift)
    good = None
    for n in range(2, LONGEST + 1):
        if len(a) < n:
            break
        h = (h[:-1] ^ (a[n - 1 :] + np.uint32(n))) * MULTIPLIERS[n - 1]
        h ^= h >> np.uint32(15)
        good = np.ones(len(h), bool) if n == 2 else good[:-1] & inner[n - 2 : -1]
        found.append((h[good] * MULTIPLIERS[3]) >> shift)
    return np.concatenate(found)


def some_words(a: np.ndarray, seed: int) -> np.ndarray:
    """A run of 3 to 40 words, the same each time for one seed."""
    gaps = np.flatnonzero(a == 32)
    rng = np.random.default_rng(seed)
    n = min(len(gaps) - 1, int(rng.integers(3, 41)))
    i = int(rng.integers(0, len(gaps) - n))
    return a[gaps[i] : gaps[i + n] + 1]


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # a row for each bucket
    bias: np.ndarray
    known: np.ndarray  # buckets seen in training
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def scores(self, hashed: np.ndarray) -> np.ndarray:
        # by distinct bucket, so that a long text needs no row for each of its subwords
        ids, n = (hashed, None) if len(hashed) < BUCKETS // 8 else np.unique(hashed, return_counts=True)
        mean = self.logits[ids].mean(axis=0) if n is None else (n @ self.logits[ids]) / len(hashed)
        z = (mean + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); und, 0 and not accepted without a letter or without languages."""
        a = normal(text)
        if not len(a) or not self.languages:
            return "und", 0.0, False
        hashed = subwords(a)
        p = self.scores(hashed)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.least_score and self.known[hashed].mean() >= self.least_known)


def train(items: list[tuple[str, np.ndarray, np.ndarray]], held: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """SGD over (language, buckets, counts) items; temperature and rejection bounds from those held back."""
    languages = sorted({x for x, _, _ in items})
    rng = np.random.default_rng(seed)
    known = np.zeros(BUCKETS, bool)
    c = len(languages)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, c), np.float32), np.zeros(c, np.float32)
    rows = [(languages.index(x), ids, (n / n.sum()).astype(np.float32), n) for x, ids, n in items]
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, ids, share, _ = rows[k]
            known[ids] = True
            lr = rate * (1 - step / steps)
            part = table[ids]
            v = share @ part
            z = v @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = out @ g
            out -= lr * np.outer(v, g)
            bias -= 0.02 * lr * g
            # a subword's step grows with the root of its share, so that rare ones move too
            table[ids] = part - lr * np.sqrt(share)[:, None] * back
            step += 1
    model = LanguageModel(languages, (table @ out).astype(np.float32), bias, known)
    held = [x for x in held if x[0] in languages]
    if held and c > 1:
        z = np.array([(n / n.sum()) @ model.logits[ids] + bias for _, ids, n in held])
        y = np.array([languages.index(x) for x, _, _ in held])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        s = z / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True)
        right = p.argmax(axis=1) == y
        if right.any():
            model.least_score = min(0.5, float(np.quantile(p.max(axis=1)[right], REJECTED)))
            share = np.array([(n * known[ids]).sum() / n.sum() for _, ids, n in held])
            model.least_known = max(0.0, float(np.quantile(share[right], REJECTED)) - 0.25)
    return model


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending buckets and their counts, in a quarter of the bytes: differences of buckets, deflated."""
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), counts]).astype("<i4").tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = np.frombuffer(zlib.decompress(raw), "<i4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), counts


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, isn't 2."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, seed: int = 7) -> LanguageModel:
    """A model from at most max_rows of the rows of docs with a text and a language, in equal shares for each language, chosen by a hash of id and text. ValueError beyond MOST_LANGUAGES."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in docs.select(F.col(text_col).isNotNull().alias("t"), F.col(lang_col).alias("lang")).where("t and lang is not null").groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(BUCKETS, bool))
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would be too large to send")
    share = max(2, max_rows // len(counts))
    chance = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (share + 3 * share**0.5) / n)))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.withColumn("draw", draw).where(F.col("draw") < chance[F.col("lang")])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("draw", T.DoubleType()), T.StructField("part", T.IntegerType()), T.StructField("subwords", T.BinaryType())])

    def features(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            for lang, d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                a = normal(text)
                for part, x in enumerate((a, some_words(a, zlib.crc32(text.encode()))) if len(a) else ()):
                    ids, n = np.unique(subwords(x), return_counts=True)
                    for name, value in (("lang", lang), ("draw", d), ("part", part), ("subwords", packed(ids, n))):
                        out[name].append(value)
            yield out

    got: dict[str, list] = {}
    for r in arrow_map(sample.select("lang", "draw", "text"), features, schema).collect():  # at most about 2 x max_rows rows
        got.setdefault(r["lang"], []).append((r["draw"], r["part"], bytes(r["subwords"])))
    items, held = [], []
    for lang in sorted(got):
        found = sorted(got[lang], key=lambda r: r[:2])[: 2 * share]
        for k, (_, _, raw) in enumerate(found):
            (held if k // 2 % 5 == 4 else items).append((lang, *unpacked(raw)))
    return train(items, held, seed=seed) if items else LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(BUCKETS, bool))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score (0 to 1), accepted. keep=True: the rows of docs that are accepted, with their own columns.

    Null texts and those without a letter are und with score 0 and not accepted; null ids stay; repeated rows are judged each; an empty table gives an empty one. A model
    without languages (nothing to learn from) says und. Other columns, whatever their names, aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a number for each language
    if keep:
        import pyarrow as pa

        at = docs.columns.index(text_col)

        def good(batches):
            for b in batches:
                kept = b.filter(pa.array([shared.value.predict(x)[2] for x in b.column(at).to_pylist()], pa.bool_()))
                yield dict(zip(b.schema.names, kept.columns, strict=True))

        return arrow_map(docs, good, docs.schema)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def judge(batches):
        for b in batches:
            rows = [shared.value.predict(x) for x in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "accepted": [r[2] for r in rows]}

    return arrow_map(docs.select(id_col, text_col), judge, schema)
