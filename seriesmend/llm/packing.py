"""Packing token sequences by concatenate and cut (operator 12).

All documents, each with an end id, are one long line of ids that is cut every `size` ids; every sequence but the last is full. Texts are encoded where they are read and written there, a row for each document with the ids that its partition
has before it. The first pass adds up each partition's tokens; prefix sums over these totals (one number for each partition) give partitions, and so documents, their global places. The second pass cuts: what a task reads in one
stretch makes whole windows there, and of a window that goes beyond the stretch each task gives a boundary record. Only these, two at most for a stretch, are shuffled, by window. Ids themselves never are.

The order of the line is that of the table's partitions and of the rows in them, fixed once the encoded table is written: other splits of the same rows give another line, equally tight.
"""

from __future__ import annotations

import os
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.llm.token_files import BYTE_LEVEL, _binary, _bytes, _gathered
from seriesmend.llm.vocab import default_path
from seriesmend.runtime import arrow_map, worker_object, written

SIZE, END_ID = 1024, 0
#: Entries in each of the two generations of a worker's cache, bytes of a piece in it, bytes of texts that are encoded at once.
CACHE, LONGEST, AT_ONCE = 150_000, 48, 4 << 20
#: Texts on which pieces must give the library's ids.
PROBE = [
    "", " ", "a b", "  a", " a\n b ", "a  b   c", "x\n\n  y\n", "a \n b\t c", "it's  1\t2!", "we'VE I'll'd 's 'tis '' a'", "É a\r\n", "naïve Straße ŉ ſ İ ª ² x́", "Word, word; (WORD) [word]... \"Word\"!? -- a.b,c",
    "1,000.5% #tag @me A1b2 __x__", "日本語 テスト。 　x\x85y\x1cz 　 z  w", "🙂🙂! a🙂. 🙂", "<|x|> <x> <| |>", "antidisestablishmentarianism" * 4, "\0 a\0b. \x1f c", "   ", "a   ", "a.  b", "--'s x",
]


class ByteEncoder:
    """Encodes texts as the tokenizers library does with a byte-level vocabulary, through a cache of pieces.

    The splitting pattern of such vocabularies never joins what stands before a space that no white space follows with what comes after; a line end or tab before something else is a token by itself; and an ASCII or Latin-1 letter or ASCII digit isn't joined with ASCII
    punctuation behind it. Texts are cut there, all at once in their buffer, and Python handles distinct pieces only; those of letters alone go straight to the library's model. PROBE tries that against the library; where it fails, and for texts that hold a special
    string, the library encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.tokens = self.model.model.tokenize
        self.special = sorted({t.content for t in self.model.get_added_tokens_decoder().values()})
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.by_pieces = True
        self.by_pieces = self.encode(pa.array(PROBE, pa.string())).to_pylist() == self.ids(PROBE)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.kind."""
        return [np.array(e.ids, self.kind).tobytes() for k in range(0, len(texts), 1000) for e in self.model.encode_batch_fast(texts[k : k + 1000], add_special_tokens=False)]

    def fresh(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that no cache has. Letters, with a space before them or not, are a single pre-token: they go to the model in the byte-level alphabet."""
        out: list[bytes | None] = []
        for p in pieces:
            letters = p[1:] if p[:1] == b" " else p
            alone = letters.isalpha() or (text := letters.decode()).isalpha() and max(text) < "\u0250"
            out.append(array(self.kind.char, [t.id for t in self.tokens(p.decode("latin-1").translate(BYTE_LEVEL))]).tobytes() if alone else None)
        rest = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(rest, self.ids([pieces[i].decode() for i in rest]), strict=True):
            out[i] = v
        return out

    def known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces. What the younger generation lacks comes into it; it grows old at CACHE entries."""
        found = list(map(self.cache.get, pieces))
        missing = [i for i, v in enumerate(found) if v is None]
        fresh = []
        for i in missing:
            found[i] = self.older.get(pieces[i])
            if found[i] is None:
                fresh.append(i)
        for i, v in zip(fresh, self.fresh([pieces[i] for i in fresh]), strict=True):
            found[i] = v
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        self.cache.update((pieces[i], found[i]) for i in missing if len(pieces[i]) <= LONGEST)
        return found

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text (null: none) as bytes, with `end` after them."""
        texts = pc.fill_null(texts, "")
        size, tail = self.kind.itemsize, b"" if end is None else self.kind.type(end).tobytes()
        odd = np.full(len(texts), not self.by_pieces)
        for mark in self.special:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        split = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts) if odd.any() else texts
        raw, places = _bytes(split)
        raw, places = raw[places[0] : places[-1]], places - places[0]
        ids, ends = self._pieces(raw, places)
        whole = dict(zip(np.flatnonzero(odd).tolist(), self.ids(texts.filter(pa.array(odd)).to_pylist()), strict=True)) if odd.any() else {}
        more = np.fromiter((len(whole.get(i, b"")) for i in range(len(texts))), np.int64, len(texts)) // size if whole else np.zeros(len(texts), np.int64)
        more = more + (end is not None)
        if not more.any():
            return _binary(ids, ends)
        extra = b"".join([whole.get(i, b"") + tail for i in range(len(texts))]) if whole else tail * len(texts)
        new = ends + np.r_[0, np.cumsum(more)]
        out, added = np.empty(new[-1], self.kind), np.zeros(new[-1], bool)
        at = np.repeat(new[1:] - more, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        added[at] = True
        out[at], out[~added] = np.frombuffer(extra, self.kind), ids
        return _binary(out, new)

    def _pieces(self, raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after another, the places where each text's ids start and the end)."""
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(len(places), np.int64)
        cut = np.zeros(len(raw) + 1, bool)
        kinds = KINDS[raw]
        latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)) + 1
        kinds[latin] = 1  # the last byte of a Latin-1 letter
        cut[: len(raw) - 1] = SPACE[raw[:-1]] & (kinds[1:] > 0)
        cut[1 : len(raw)] |= LINE[raw[:-1]] & (kinds[1:] > 0)
        ends = places[places > 0] - 1
        cut[ends[SPACE[raw[ends]]]] = False  # what follows this space is another text
        cut[1 : len(raw)] |= (kinds[1:] == 2) & (kinds[:-1] == 1)
        cut[places] = True
        starts = np.flatnonzero(cut)
        coded = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        held = self.known(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, held), np.int64, len(held)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(held), self.kind)
        ids, ends = _gathered(pool, np.cumsum(lengths) - lengths, lengths, coded.indices.to_numpy())
        return ids, ends[np.searchsorted(starts, places)]


#: 1: ASCII letters and digits, 2: other printable ASCII, 3: first bytes of characters none of which is white space, 0: the rest.
KINDS = np.array([(1 if chr(c).isalnum() else 2) if 32 < c < 127 else 3 if 0xC3 <= c <= 0xF4 and c not in (0xE1, 0xE2, 0xE3) else 0 for c in range(256)], np.uint8)
#: Line ends and tabs, and these and the space.
LINE = np.isin(np.arange(256), list(b"\t\n\v\f\r"))
SPACE = LINE | (np.arange(256) == 32)


def encoder(path: str) -> ByteEncoder:
    """The worker's encoder; it outlives tasks."""
    return worker_object("pieces of bytes", path, lambda: ByteEncoder(path))


@dataclass
class Window:
    """What a task has of one sequence: ids from `offset` on, and the pieces in them."""

    sequence: int
    offset: int
    ids: list[np.ndarray] = field(default_factory=list)
    pieces: list[tuple] = field(default_factory=list)
    n: int = 0

    def row(self, size: int) -> dict:
        docs, starts, lengths, offsets, tokens = ([p[k] for p in self.pieces] for k in range(5))
        whole = self.offset == 0 and self.n == size
        return {"sequence_id": self.sequence, "offset": self.offset, "n_tokens": self.n, "whole": whole, "ids": b"".join([x.tobytes() for x in self.ids]), "doc_id": docs, "start": starts, "length": lengths, "at": offsets, "doc_tokens": tokens}


def _rows(rows: list[dict], names: list[str]) -> dict:
    return {c: [r[c] for r in rows] for c in names}


def pack_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    """Sequences of at most `size` tokens that hold every text's ids and end_id, without padding but in the last: sequence_id (0, 1, ...), n_tokens, padded_to (n_tokens if that is a power of two, else size), ids (little-endian unsigned
    integers of 16 bits, 32 for vocabularies of over 65,536), and in order of their place the pieces: doc_id, start (the document's ids before it), length, at (place in the sequence), doc_tokens (ids of the whole document), which are arrays of one length.

    Null and empty texts have the end id alone. Null ids stay null; repeated rows are documents of their own; an empty table gives no sequences. Other columns, whatever their names, aren't read. A long text goes through as many
    sequences as it needs. No row depends on a tie: the line is in the order in which the encoded table was written.
    """
    spark = docs.sparkSession
    source, kind = tokenizer_path or default_path("byte_bpe_50k.json"), docs.schema[id_col].dataType
    long = T.LongType()
    coded_schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", long), T.StructField("doc_id", kind), T.StructField("n", long), T.StructField("ids", T.BinaryType())])
    window_schema = T.StructType([
        T.StructField("sequence_id", long), T.StructField("offset", long), T.StructField("n_tokens", long), T.StructField("whole", T.BooleanType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_id", T.ArrayType(kind)), *[T.StructField(c, T.ArrayType(long)) for c in ("start", "length", "at", "doc_tokens")],
    ])

    def encode(batches):
        before, held, room = 0, [], 0

        def coded() -> dict:
            nonlocal before
            parts, ids, texts = (pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in (0, 1, 2))
            got = encoder(source).encode(texts, end_id)
            n = pc.binary_length(got).to_numpy().astype(np.int64) // encoder(source).kind.itemsize
            ends = before + np.cumsum(n)
            before = int(ends[-1])
            return {"part": parts, "before": ends - n, "doc_id": ids, "n": n, "ids": got}

        for b in batches:
            held, room = [*held, b], room + b.nbytes
            if room >= AT_ONCE:
                yield coded()
                held, room = [], 0
        if sum(b.num_rows for b in held):
            yield coded()

    texts = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = written(arrow_map(texts, encode, coded_schema), "packing-ids")
    # first pass: one total for each partition, and the sum of those before it
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect())
    begins = np.cumsum([0, *[n for _, n in totals]])
    bases = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, begins, strict=False)], "part int, base long")
    # 12 bytes for each partition of the input; a broadcast join keeps the order of rows
    placed = table.join(F.broadcast(bases), "part").select((F.col("before") + F.col("base")).alias("place"), "doc_id", "n", "ids")

    def cut(batches):
        open_, ends_at, done = None, -1, []
        for b in batches:
            width = encoder_width(b.column(3), b.column(2))
            for place, doc, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                line = np.frombuffer(ids, width)
                if place != ends_at and open_ is not None:  # another stretch
                    done.append(open_.row(size))
                    open_ = None
                start = 0
                while start < n:
                    sequence, at = divmod(place + start, size)
                    take = min(size - at, n - start)
                    if open_ is None:
                        open_ = Window(sequence, at)
                    open_.ids.append(line[start : start + take])
                    open_.pieces.append((doc, start, take, at, n))
                    open_.n += take
                    start += take
                    if at + take == size:
                        done.append(open_.row(size))
                        open_ = None
                    if len(done) >= 1000:
                        yield _rows(done, window_schema.names)
                        done = []
                ends_at = place + n
        if open_ is not None:
            done.append(open_.row(size))
        if done:
            yield _rows(done, window_schema.names)

    windows = written(arrow_map(placed, cut, window_schema), "packing-windows")

    def join(batches):
        """Boundary records of a window come sorted, one after another; a window has `size` of them at most."""
        held: list[dict] = []

        def joined() -> dict:
            first = held[0]
            return first | {"n_tokens": sum(r["n_tokens"] for r in held), "ids": b"".join(r["ids"] for r in held)} | {c: [x for r in held for x in r[c]] for c in ("doc_id", "start", "length", "at", "doc_tokens")}

        done = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["sequence_id"] != r["sequence_id"]:
                    done.append(joined())
                    held = []
                held.append(r)
            if len(done) >= 1000:
                yield _rows(done, window_schema.names)
                done = []
        if held:
            done.append(joined())
        if done:
            yield _rows(done, window_schema.names)

    edges = windows.where(~F.col("whole")).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    every = windows.where("whole").unionByName(arrow_map(edges, join, window_schema))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return every.select("sequence_id", "n_tokens", F.when(power, F.col("n_tokens")).otherwise(size).alias("padded_to"), "ids", "doc_id", "start", "length", "at", "doc_tokens")


def encoder_width(ids: pa.Array, n: pa.Array) -> np.dtype:
    """The integers' type, from the bytes of a batch (each document has its end id at least)."""
    size = int(pc.sum(pc.binary_length(ids)).as_py()) // int(pc.sum(n).as_py())
    return np.dtype("<u2" if size == 2 else "<u4")


def piece_digests(sequences: DataFrame) -> DataFrame:
    """A row for each piece of pack_sequences(): doc_id, start, length, ids_crc32 (of its ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset, padded_to; read from the sequences' ids."""
    long = T.LongType()
    kind = sequences.schema["doc_id"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to")]])

    def run(batches):
        for b in batches:
            c = {f: b.column(i) for i, f in enumerate(b.schema.names)}
            if not b.num_rows:
                continue
            flat = {f: c[f].flatten() for f in ("doc_id", "start", "length", "at", "doc_tokens")}
            each = pc.list_value_length(c["at"]).to_numpy()
            width = encoder_width(c["ids"], c["n_tokens"])
            ids = np.frombuffer(b"".join(c["ids"].to_pylist()), width).astype("<u4")
            raw = memoryview(ids.tobytes())
            tokens = c["n_tokens"].to_numpy()
            begins = np.repeat(np.cumsum(tokens) - tokens, each) + flat["at"].to_numpy()
            ends = begins + flat["length"].to_numpy()
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield {
                "doc_id": flat["doc_id"], "start": flat["start"], "length": flat["length"], "ids_crc32": crc, "doc_tokens": flat["doc_tokens"],
                "sequence_id": np.repeat(c["sequence_id"].to_numpy(), each), "offset": flat["at"], "padded_to": np.repeat(c["padded_to"].to_numpy(), each),
            }

    return arrow_map(sequences, run, schema)
