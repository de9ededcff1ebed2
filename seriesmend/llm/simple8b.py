"""Simple-8b word-aligned integer coding, vectorised (numpy), and the shard images that hold coded token ids.

A 64-bit word has a selector in its top 4 bits and 60 bits of payload. Selector s > 0 says that the payload holds COUNTS[s] ids of WIDTHS[s]
bits, the first in the lowest bits. Selector 0 is the escape: the payload is the place of one id of over 60 bits in a
list of exceptions. Ids are coded in blocks of BLOCK; no word crosses from one block to the next, and the place of each
block's first word is kept, so that any block is decoded by itself and all of a block's words at once. A block's last word may hold
fewer ids than its selector says; the rest is zero.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# The layout of a word by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK = 4096
MAGIC = b"SM8B"
U = np.uint64


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, place of each block's first word and the end, exceptions) of unsigned ids."""
    ids = np.ascontiguousarray(ids, U)
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, U), np.zeros(1, np.int64), np.zeros(0, U)
    ends = np.minimum(np.arange(1, blocks + 1, dtype=np.int64) * block, n)
    choice = _choices(ids, blocks, block)
    # all blocks go from word to word at once
    place, steps = np.arange(blocks, dtype=np.int64) * block, []
    while (place < ends).any():
        steps.append(place)
        place = np.minimum(place + COUNTS[choice[np.minimum(place, n - 1)]], ends)
    by_block = np.stack(steps, axis=1)
    starts = by_block[by_block < ends[:, None]]
    ends = ends[starts // block]
    chosen = choice[starts]
    words = chosen.astype(U) << U(60)
    exceptions = np.zeros(0, U)
    for s in np.unique(chosen):
        where = np.flatnonzero(chosen == s)
        first, last = starts[where], ends[where]
        if s == 0:
            exceptions = ids[first]
            words[where] |= np.arange(len(where), dtype=U)
            continue
        for k in range(int(COUNTS[s]) if WIDTHS[s] else 0):
            held = first + k < last
            words[where[held]] |= ids[first[held] + k] << U(k * int(WIDTHS[s]))
    offsets = np.r_[0, np.cumsum((by_block < np.minimum(np.arange(1, blocks + 1) * block, n)[:, None]).sum(axis=1))]
    return words, offsets.astype(np.int64), exceptions


def _choices(ids: np.ndarray, blocks: int, block: int) -> np.ndarray:
    """For each place the selector that holds the most ids from there on; beyond a block's end all fits."""
    widths = np.zeros((blocks, block + int(COUNTS.max())), np.uint8)
    flat = np.zeros(blocks * block, np.uint8)
    top = int(ids.max()).bit_length()
    for bit in range(top):  # bits of each id
        flat[: len(ids)] += ids >= U(1 << bit)
    widths[:, :block] = flat.reshape(blocks, block)
    best = np.zeros((blocks, block), np.uint8)  # 0: an escape
    most, size = widths, 1  # the greatest width among the next `size` ids
    for s in range(15, 0, -1):
        count = int(COUNTS[s])
        while size < count:
            step = min(size, count - size)
            most = np.maximum(most[:, : most.shape[1] - step], most[:, step:])
            size += step
        fits = most[:, :block] <= WIDTHS[s]
        if s < 15 and not fits.any():
            break
        np.copyto(best, np.uint8(s), where=fits)
    return best.reshape(-1)[: len(ids)]


def decode(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n: int, block: int = BLOCK, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default) of n coded ids."""
    last = len(offsets) - 1 if last is None else last
    lo, hi = min(n, first * block), min(n, last * block)
    words = words[offsets[first] : offsets[last]]
    out = np.zeros(hi - lo, U)
    if not len(words):
        return out
    chosen = (words >> U(60)).astype(np.int64)
    counts = COUNTS[chosen]
    run = np.cumsum(counts) - counts
    heads = offsets[first:last] - offsets[first]
    of = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
    start = run - run[heads][of] + of * block
    end = np.minimum((of + 1) * block, hi - lo)
    payload = words & U((1 << 60) - 1)
    for s in np.unique(chosen):
        where = np.flatnonzero(chosen == s)
        if s == 0:
            out[start[where]] = exceptions[payload[where].astype(np.int64)]
            continue
        mask = U((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s]) if WIDTHS[s] else 0):
            held = where[start[where] + k < end[where]]
            out[start[held] + k] = (payload[held] >> U(k * int(WIDTHS[s]))) & mask
    return out


@dataclass
class Shard:
    """Documents (ids or None) with the numbers of their token ids, and all their token ids one after another."""

    doc_ids: list
    counts: np.ndarray
    ids: np.ndarray


HEADER = struct.Struct("<4sIQQQQQI")


def pack(shard: Shard, block: int = BLOCK) -> bytes:
    """A shard's file image: header, block places, exceptions, documents (null flags, ids, counts), words."""
    words, offsets, exceptions = encode(shard.ids, block)
    null = np.array([x is None for x in shard.doc_ids], np.uint8)
    docs = np.array([x or 0 for x in shard.doc_ids], "<i8")
    body = b"".join([offsets.astype("<i8").tobytes(), exceptions.astype("<u8").tobytes(), null.tobytes(), docs.tobytes(), np.asarray(shard.counts, "<i8").tobytes(), words.astype("<u8").tobytes()])
    return HEADER.pack(MAGIC, block, len(shard.ids), len(docs), len(words), len(offsets), len(exceptions), zlib.crc32(body)) + body


def unpack(image: bytes) -> Shard:
    """The shard of a file image; ValueError if it is damaged."""
    magic, block, n, n_docs, n_words, n_offsets, n_exceptions, crc = HEADER.unpack_from(image)
    if magic != MAGIC or zlib.crc32(memoryview(image)[HEADER.size :]) != crc:
        raise ValueError("not a whole shard image")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(image, kind, count, at)
        at += x.nbytes
        return x

    offsets, exceptions, null, docs, counts, words = take("<i8", n_offsets), take("<u8", n_exceptions), take("u1", n_docs), take("<i8", n_docs), take("<i8", n_docs), take("<u8", n_words)
    return Shard([None if z else d for z, d in zip(null.tolist(), docs.tolist(), strict=True)], counts, decode(words, offsets, exceptions, n, block))
