"""License scans: exact phrases, and short notices within a bounded number of edits (operator 9).

Texts are normalised to words with single spaces. A notice that may have k edits (character insertions, deletions, substitutions)
is split into k + 1 pieces; by the pigeonhole principle any match holds one piece unchanged, so the places of the pieces (exact
seeds) bound all candidates. Only there the `regex` library matches the whole notice with at most k errors, and its span is reported.
Phrases that must be exact are found as words among words.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.llm.words import joined, spaces, word_places
from seriesmend.runtime import arrow_map

#: Exact phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, as words; (label, notice, most edits).
NOTICES = [
    ("apache", "licensed under the apache license version 2 0", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    ("cc", "licensed under cc by", 2),
    ("cc", "creative commons attribution", 3),
    ("gpl", "licensed under the gnu general public license version", 4),
    ("gpl", "this program is free software you can redistribute it and or modify it", 6),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("mit", "released under the mit license", 3),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("spdx", "spdx license identifier", 2),
]


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """(place, piece) of edits + 1 pieces of about equal length that make up the notice."""
    raw = notice.encode()
    cuts = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class NoticeScanner:
    def __init__(self, phrases: dict[str, str], notices: list[tuple]):
        self.phrases = [(b" %b " % p.encode(), p.count(" ") + 1, label) for p, label in phrases.items()]
        self.notices = [(label, len(n.encode()), k, pieces(n, k), regex.compile(rb"(?be)(?<= )(?:%b){e<=%d}(?= )" % (regex.escape(n.encode(), literal_spaces=True), k))) for label, n, k in notices]

    def base(self, line: bytes) -> list[tuple[int, int, str]]:
        """(place in the line, words, label) of every exact phrase, in order."""
        found = []
        for phrase, n, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, n, label))
                at = line.find(phrase, at + 1)
        return sorted(found)

    def fuzzy(self, line: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of notices within their bounds, which don't overlap for one notice: the one of fewest edits is taken first, of equal ones the first, then what lies beside it is searched.

        Each seed has a window of its own, as long as the notice and its edits; seeds that say the same of where the notice starts share it. A window is searched again only where a match that was taken cuts into it, so that work grows with the seeds."""
        found = []
        for label, size, most, seeds, pattern in self.notices:
            starts: set[int] = set()
            for at, seed in seeds:
                place = line.find(seed)
                while place >= 0:
                    starts.add(place - at)
                    place = line.find(seed, place + 1)
            heap: list[tuple[int, int, int, int, int]] = []

            def look(a: int, b: int, pattern=pattern, heap=heap) -> None:
                m = pattern.search(line, a, b)
                if m:
                    heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

            for s in sorted(starts):
                look(max(0, s - most - 1), min(len(line), s + size + most + 1))
            begins: list[int] = []
            ends: list[int] = []
            while heap:
                edits, start, end, a, b = heapq.heappop(heap)
                k = bisect.bisect_right(ends, start)  # the first taken match that ends behind the start
                if k == len(begins) or begins[k] >= end:
                    begins.insert(k, start)
                    ends.insert(k, end)
                    found.append((start, end, label, edits))
                    continue
                # what taken matches leave of the window
                k = bisect.bisect_right(ends, a)
                while k < len(begins) and begins[k] < b:
                    if begins[k] > a:
                        look(a, begins[k])
                    a = max(a, ends[k])
                    k += 1
                if a < b:
                    look(a, b)
        return sorted(found)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: list[tuple] | None = None, spans: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base (places of exact phrases), first_word, last_word (least and greatest
    word at which one starts, else null), base_labels, labels (with those of fuzzy notices; sorted, comma-joined), score (1 for an exact phrase, else the best share of
    a notice's characters that is unedited, 0 if nothing was found) and, with spans, spans: (label, start, end, edits) in characters of the text.

    Null and empty texts have no words and empty labels. Null ids stay, repeated rows are scanned each, an empty table gives an empty one. Other columns, whatever
    their names, aren't read. Texts are scanned whole, however long.
    """
    scanner = NoticeScanner(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(n, k) for n, k in (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()))]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))))

    def row(text: str | None) -> tuple:
        line, n = joined(text)
        base, fuzzy = scanner.base(line), scanner.fuzzy(line)
        if not base and not fuzzy:
            return n, 0, None, None, "", "", 0.0, []
        gaps = spaces(line)
        word = lambda at: int(np.searchsorted(gaps, at))  # noqa: E731  the word that starts after the gap at `at`
        starts = [word(at) for at, _, _ in base]
        own = {x for _, _, x in base}
        score = 1.0 if base else max(1 - e / (b - a) for a, b, _, e in fuzzy)
        first, last = word_places(text or "")
        found = [(word(at), word(at) + k - 1, label, 0) for at, k, label in base] + [(word(a - 1), int(np.searchsorted(gaps, b)) - 1, label, e) for a, b, label, e in fuzzy]
        return n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for _, _, x, _ in fuzzy})), score, [{"label": label, "start": int(first[a]), "end": int(last[b]), "edits": e} for a, b, label, e in sorted(found)]

    def scan(batches):
        for b in batches:
            rows = [row(x) for x in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), **{f.name: [r[k] for r in rows] for k, f in enumerate(fields[1:])}}

    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), scan, T.StructType(fields))
