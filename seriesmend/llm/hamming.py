"""Gray-order hierarchical index over 64-bit fingerprints, and the links it finds within segments (numpy).

Fingerprints are sorted by Gray rank, so that neighbours differ in few bits. Runs of FAN rows make leaves, runs of FAN leaves their
parents, up to a root for each segment. A node holds the bits that all rows below share: which (mask) and how they are set
(pattern). What a parent shares isn't held again: a node's own mask leaves it out, and a query adds a node's differences to those
of its ancestors. Once the sum is over the radius, the whole group below is pruned. Groups that end before the query's own place, or that already
are in the query's component as a whole, are left out too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
FAN = 8
#: Queries searched at once; a segment has at most a few thousand rows, so that pairs at hand stay a few million.
AT_ONCE = 256


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the reflected Gray code."""
    x = x.astype(U, copy=True)
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> U(k)
    return x


@dataclass
class Level:
    start: np.ndarray  # first child (first row at the leaves' level)
    end: np.ndarray
    mask: np.ndarray  # bits shared below, without those of the parent
    pattern: np.ndarray
    last: np.ndarray  # one past the last row below
    first: np.ndarray


class GrayIndex:
    """Levels from the roots (one for each segment) down to the leaves; rows are sorted by segment, then Gray rank."""

    def __init__(self, segments: np.ndarray, prints: np.ndarray):
        self.prints = prints
        n = len(prints)
        above = np.full(n, ~U(0)), prints  # each row shares all bits with itself
        seg, lo, hi = segments, np.arange(n), np.arange(n) + 1
        levels: list[tuple] = []
        while True:
            heads = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            done = bool(levels) and len(heads) == len(seg)
            if done:
                break
            within = np.arange(len(seg)) - np.repeat(heads, np.diff(np.r_[heads, len(seg)]))
            start = np.flatnonzero(within % FAN == 0)
            end = np.r_[start[1:], len(seg)]
            mask, pattern = above
            one, other = np.bitwise_and.reduceat(pattern, start), np.bitwise_or.reduceat(pattern, start)
            shared = np.bitwise_and.reduceat(mask, start) & ~(one ^ other)
            levels.append((start, end, shared, one & shared, hi[end - 1], lo[start]))
            above, seg, lo, hi = (shared, one & shared), seg[start], lo[start], hi[end - 1]
        self.roots = seg
        self.levels: list[Level] = []
        outer = None
        for start, end, shared, pattern, last, first in reversed(levels):
            own = shared if outer is None else shared & ~np.repeat(outer[0], outer[1])
            self.levels.append(Level(start, end, own, pattern, last, first))
            outer = shared, end - start
        self.row_mask = ~np.repeat(outer[0], outer[1]) if outer else np.zeros(0, U)

    def search(self, rows: np.ndarray, root_of: np.ndarray, radius: int, label: np.ndarray | None = None, span: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query row, later row of its segment) at most radius bits apart. label and span (least and greatest label of each level's
        nodes): groups wholly under the query's label are pruned."""
        q, node = rows, root_of[rows]
        acc = np.zeros(len(q), np.int64)
        prints = self.prints
        for k, lv in enumerate(self.levels):
            acc = acc + np.bitwise_count((prints[q] ^ lv.pattern[node]) & lv.mask[node])
            keep = (acc <= radius) & (lv.last[node] > q + 1)
            if span is not None:
                low, high = span[k]
                keep &= ~((low[node] == high[node]) & (low[node] == label[q]))
            q, node, acc = q[keep], node[keep], acc[keep]
            size = lv.end[node] - lv.start[node]
            child = np.repeat(lv.start[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            q, acc, node = np.repeat(q, size), np.repeat(acc, size), child
        acc = acc + np.bitwise_count((prints[q] ^ prints[node]) & self.row_mask[node])
        keep = (acc <= radius) & (node > q)
        return q[keep], node[keep]

    def spans(self, label: np.ndarray) -> list:
        out = []
        for lv in self.levels:
            heads = lv.first
            out.append((np.minimum.reduceat(label, heads), np.maximum.reduceat(label, heads)))
        return out


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the classes of a and b, pair by pair; root: each row's least row, and again on return."""
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(segments: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint pairs that connect whatever is within radius bits inside a segment: at most a pair for each row."""
    order = np.lexsort((gray_rank(prints), segments))
    segments, prints = segments[order], prints[order]
    index = GrayIndex(segments, prints)
    root_of = np.cumsum(np.r_[True, segments[1:] != segments[:-1]]) - 1
    root = np.arange(len(prints))
    sizes = np.bincount(root_of)[root_of]
    small = np.flatnonzero(sizes <= 64)
    for lo in range(0, len(small), 16 * AT_ONCE):
        root = merge(root, *index.search(small[lo : lo + 16 * AT_ONCE], root_of, radius))
    large = np.flatnonzero(sizes > 64)
    for lo in range(0, len(large), AT_ONCE):
        root = merge(root, *index.search(large[lo : lo + AT_ONCE], root_of, radius, root, index.spans(root)))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return prints[moved], prints[root[moved]]
