"""Runs of words that repeat with a period, by power-of-two naming (operator 13).

Level k of Karp, Miller and Rosenberg's naming gives equal blocks of 2^k words of a text equal numbers: level 0 numbers the words, a pair of names half a block apart is a name of the next level, and pairs are numbered in their sorted order. A name that
only one place of its text has can meet no other, nor can any block that holds it; such places drop out, so that plain prose has hardly any name left after a few levels, and all texts of a batch are named at once.

A run of period q and length L has w[i] = w[i + q] along L - q places, at least max(2 q, LEAST - q). Such a stretch holds a whole block of 2^k words on a grid of step 2^k (k by q alone), so each period looks at one place in 2^k; where the blocks at i and
i + q have one name, the stretch is extended to both sides by longest common extensions over descending levels. Nothing is hashed or sorted by suffixes, and every pair of places is decided by names alone.

Batches are of bounded size; a text longer than that is one by itself and takes 4 bytes for each word and level that still has names, 4 n log2(n / 3) at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.runtime import arrow_map

#: A run has this many words and periods at least.
LEAST, TIMES = 24, 3
#: Words of texts that are named at once.
AT_ONCE = 400_000
NONE = -1


def grid_level(least: int) -> int:
    """The level of the lowest grid: its blocks lie in every stretch of period 1 to 2^(level + 1) - 1."""
    k = 0
    while 2 ** (k + 2) - 1 <= min(max(2 * q, least - q) for q in range(1, 2 ** (k + 2))):
        k += 1
    return k


class Names:
    """Levels of names over texts that follow one another, the longest first, each with a place of its own behind it."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """words: equal numbers for equal words of a text, other ones for those of other texts; sizes: words of each text, descending."""
        self.sizes = sizes
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        line = np.full(int(sizes.sum()) + len(sizes), NONE, np.int64)
        inside = np.ones(len(line), bool)
        inside[self.starts + sizes] = False
        line[inside] = words
        self.levels = [self._numbered(line)]

    @staticmethod
    def _numbered(keys: np.ndarray) -> np.ndarray:
        """Numbers of keys in their order; NONE stays, and where a key stands once."""
        some = np.flatnonzero(keys >= 0)
        out = np.full(len(keys), NONE, np.int32)
        order = np.argsort(keys[some], kind="stable")
        ranked = keys[some][order]
        new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        often = np.bincount(number, minlength=1)[number] > 1 if len(number) else new
        out[some[order[often]]] = number[often]
        return out

    def grow(self) -> bool:
        """The next level, for texts that can hold a run with a period of that many words; False where no name is left."""
        k = len(self.levels)
        texts = int(np.searchsorted(-self.sizes, -TIMES * 2 ** (k - 1), "right"))  # half of it: the lowest grid has smaller periods too
        end = int((self.sizes[:texts] + 1).sum())
        half, below = 2 ** (k - 1), self.levels[-1]
        end = min(end, len(below))
        left, right = below[:end], np.full(end, NONE, np.int32)
        right[: max(0, end - half)] = below[half:end]
        both = (left >= 0) & (right >= 0)
        keys = np.where(both, left.astype(np.int64) * (int(below.max(initial=0)) + 1) + right, NONE)
        self.levels.append(self._numbered(keys))
        return bool((self.levels[-1] >= 0).any())

    def same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the blocks at i and j have one name; not beyond the level's places."""
        names = self.levels[level]
        if not len(names):
            return np.zeros(len(i), bool)
        ok = (i >= 0) & (j >= 0) & (i < len(names)) & (j < len(names))
        a, b = names[np.where(ok, i, 0)], names[np.where(ok, j, 0)]
        return ok & (a >= 0) & (a == b)

    def extent(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """How many words from i and j on (way 1), or before them (way -1), are the same, by descending levels."""
        got = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            size, live = 2**level, np.arange(len(i))
            while len(live):
                at = got[live] if way > 0 else -got[live] - size
                live = live[self.same(level, i[live] + at, j[live] + at)]
                got[live] += size
        return got

    def candidates(self, level: int, lowest: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places on the level's grid, periods) whose blocks are the same while those a step before aren't."""
        names, step = self.levels[level], 2**level
        grid = np.arange(0, len(names), step)
        grid = grid[names[grid] >= 0]
        first = 1 if lowest else step
        width = 2 * step - first
        padded = np.r_[names, np.full(2 * step, NONE, np.int32)]
        view = sliding_window_view(padded, width)
        at, period = [], []
        for part in np.array_split(grid, max(1, -(-len(grid) * width // (8 << 20)))):
            row, column = np.nonzero(view[part + first] == names[part][:, None])
            i, q = part[row], column + first
            begins = ~self.same(level, i - step, i - step + q)
            at.append(i[begins])
            period.append(q[begins])
        return np.concatenate(at), np.concatenate(period)


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of the texts (sizes descending), in order of text, start and period."""
    names = Names(words, sizes)
    lowest = grid_level(least)
    found = []
    while len(names.levels) <= lowest and names.grow():
        pass
    level = lowest
    while len(names.levels) > level:
        i, q = names.candidates(level, level == lowest)
        found.append((i, q))
        level += 1
        if not names.grow():
            break
    if not found or not sum(len(i) for i, _ in found):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    i, q = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    start = i - names.extent(i, i + q, -1)
    length = i + names.extent(i, i + q, 1) + q - start
    good = length >= np.maximum(least, TIMES * q)
    start, length, q = start[good], length[good], q[good]
    order = np.lexsort((q, length, start))  # of one stretch the smallest period comes first; the others are its multiples
    start, length, q = start[order], length[order], q[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, q = start[new], length[new], q[new]
    text = np.searchsorted(names.starts, start, "right") - 1
    start = start - names.starts[text]
    order = np.lexsort((q, start, text))
    return text[order], start[order], length[order], q[order]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text's words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((t for t in range(len(texts)) if len(texts[t]) >= least), key=lambda t: -len(texts[t]))
    if not order:
        return out
    sizes = np.array([len(texts[t]) for t in order], np.int64)
    flat = pa.array([w for t in order for w in texts[t]], pa.binary()).dictionary_encode()
    words = np.repeat(np.arange(len(order)), sizes) * len(flat.dictionary) + flat.indices.to_numpy()
    for t, s, n, q in zip(*(x.tolist() for x in find_runs(words, sizes, least)), strict=True):
        out[order[t]].append((s, n, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without what any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, runs (array of start, length, period by start, then period), collapsed (text of the words that no run holds after its first period, joined by single spaces).

    Words are what stands between ASCII white space. A run is a stretch of consecutive words of smallest period q, at least max(least, 3 q) long, that no neighbouring word extends. Null and empty texts have no words, no runs and an empty text. Null ids stay
    null; repeated rows are judged each; an empty table gives an empty one; no row depends on another. Texts are taken whole. Other columns, whatever their names, aren't read. rewrite(id, words), if given, says which words a row has instead of its text's.
    """
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def search(batches):
        for b in batches:
            texts = [(x or "").encode().split() for x in b.column(1).to_pylist()]
            if rewrite is not None:
                texts = [rewrite(i, words) for i, words in zip(b.column(0).to_pylist(), texts, strict=True)]
            size, begin = 0, 0
            for k, words in enumerate(texts):
                size += len(words)
                if size >= AT_ONCE or k == len(texts) - 1:
                    part = texts[begin : k + 1]
                    runs = runs_of(part, least)
                    yield {
                        "doc_id": b.column(0).slice(begin, len(part)), "n_words": list(map(len, part)), "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in each] for each in runs],
                        "collapsed": pa.array([collapsed(w, r) for w, r in zip(part, runs, strict=True)], pa.binary()),
                    }
                    size, begin = 0, k + 1

    return arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string")), search, schema)
