"""Normalised words of texts, as bytes: A-Z lower-cased, and all that isn't a-z, 0-9 or beyond ASCII separates."""

from __future__ import annotations

import numpy as np

#: What each UTF-8 byte becomes. Bytes from 128 up belong to characters beyond ASCII and stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def marked(text: str | None) -> bytes:
    """UTF-8 of the text with separators as spaces; the same length, so that places are those of the text's bytes."""
    return (text or "").encode().translate(TABLE)


def joined(text: str | None) -> tuple[bytes, int]:
    """(words with a space before, between and after them, or b"" if there are none; how many)."""
    words = marked(text).split()
    return (b" %b " % b" ".join(words) if words else b""), len(words)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word in the text, in characters."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(marked(text), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that start before each byte
    return chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]


def spaces(line: bytes) -> np.ndarray:
    """Places of the spaces in what joined() gave; the n-th (from 0) stands before word n."""
    return np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
