"""Token-ID output in Simple-8b shard files, in order of document ids (operator 10).

Texts are encoded where they are read; only their ids are shuffled, once, to shards that cover ranges of doc_id. Range bounds
come from quantiles of the id column (a scan of that column alone), so that encoding never runs twice. A task streams
its sorted range into files of at most SHARD_IDS ids or one document each, and a manifest names them. Rows are in a total order, so that a
retried task writes the same files again; a file is moved to its name once it is whole. Readers take files of the manifest alone.
"""

from __future__ import annotations

import os
import string
import uuid
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.llm import simple8b
from seriesmend.llm.vocab import default_path
from seriesmend.runtime import arrow_map, scratch, worker_object

#: Entries in each of the two generations of a worker's cache, bytes of a word in it, bytes of texts that are encoded at once.
CACHE, LONGEST, AT_ONCE = 150_000, 64, 4 << 20
#: Ids in a shard file; a document is never split, so one of more ids has a file of its own. Bytes of input in a range of ids.
SHARD_IDS, RANGE_BYTES = 500_000, 32 << 20
END_ID = 1
#: The byte-level alphabet: printable Latin-1 characters stand for their byte, those from U+0100 for the other bytes in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: What a vocabulary must agree on before texts are taken apart: cases, marks, white space, letters with marks, long words.
PROBE = [
    "", " ", "a b", " a\n b ", "The CAT sat.", "it's  1\t2!", "IT'S He'll we'VE o'clock 'tis", "É a\r\n", "naïve Straße ŉ ſ İ Σας ﬁ ª ² x\u0301", "Word, word; (WORD) [word]... \"Word\"!? -- a.b,c",
    "1,000.5% #tag @me A1b2 __x__ '' a'", "日本語 テスト。 \u3000x\x85y\x1cz", "🙂🙂! a🙂.", "<|x|> <x> </s> <| |>", "antidisestablishmentarianism" * 4, "\0 a\0b.",
]


class WordEncoder:
    """Encodes texts as the tokenizers library does, through a cache of words' stems.

    Where a vocabulary's pre-tokens never hold white space and its normalizer works within words, a text's ids are those of what stands between ASCII white space; where
    it lower-cases, A-Z may go first; and a run of ASCII punctuation at a word's end, after an ASCII letter or digit, is a pre-token of its own. Which of these hold is tried on PROBE, against
    the library: with lower case, without, or not at all. Texts in which a special string of the vocabulary could be meant are left to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.special = sorted({t.content.lower() for t in self.model.get_added_tokens_decoder().values()})
        self.tokens = self.model.model.tokenize
        self.cache: dict[bytes, np.ndarray] = {}
        self.older: dict[bytes, np.ndarray] = {}
        want = self.ids(PROBE)
        self.by_words = True
        for self.lower in (True, False):
            if self.encode(pa.array(PROBE, pa.string())).to_pylist() == want:
                break
            self.cache, self.older = {}, {}
        else:
            self.by_words = False

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.kind."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def stem_ids(self, stem: bytes) -> bytes:
        """The ids of a stem. One of lower-case Latin letters in composed form is a single pre-token that the normalizer leaves as it is, so that it goes straight to the library's model, in the byte-level alphabet."""
        if stem.isalpha() and stem.islower():
            return array(self.kind.char, [t.id for t in self.tokens(stem.decode())]).tobytes()
        text = stem.decode()
        if text.isalpha() and max(text) < "\u0250" and text == text.lower() and is_normalized("NFC", text):
            return array(self.kind.char, [t.id for t in self.tokens(stem.decode("latin-1").translate(BYTE_LEVEL))]).tobytes()
        return self.ids([text])[0]

    def known(self, stems: list[bytes]) -> list[bytes]:
        """The ids of stems. What the younger generation lacks comes into it; it grows old at CACHE entries."""
        found = list(map(self.cache.get, stems))
        keep = {}
        for i, v in enumerate(found):
            if v is None:
                stem = stems[i]
                v = found[i] = self.older.get(stem) or self.stem_ids(stem)
                if len(stem) <= LONGEST:
                    keep[stem] = v
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        self.cache.update(keep)
        return found

    def encode(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text (null: none) as bytes, with `end` after them. Words are split, taken apart and numbered by Arrow, so that Python handles distinct stems only."""
        texts = pc.fill_null(texts, "")
        size, tail = self.kind.itemsize, b"" if end is None else self.kind.type(end).tobytes()
        if not self.by_words:
            return pa.array([x + tail for x in self.ids(texts.to_pylist())], pa.binary())
        lowered = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), bool)
        for mark in self.special:
            odd |= pc.match_substring(lowered, mark).to_numpy(zero_copy_only=False)
        split = lowered if self.lower else texts
        if odd.any():
            split = pc.if_else(pa.array(odd), pa.scalar("", split.type), split)
        lists = pc.ascii_split_whitespace(split)
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        pool, lengths = self._words(coded.dictionary)
        starts = np.cumsum(lengths) - lengths
        ids, ends = _gathered(pool, starts, lengths, coded.indices.to_numpy())
        cuts = ends[bounds - bounds[0]]
        if not odd.any() and end is None:
            return _binary(ids, cuts)
        # texts that the library takes as a whole, and the end ids, go where they belong
        whole = dict(zip(np.flatnonzero(odd).tolist(), self.ids(texts.filter(pa.array(odd)).to_pylist()), strict=True))
        extra = b"".join([whole.get(i, b"") + tail for i in range(len(texts))]) if whole else tail * len(texts)
        more = np.array([len(whole.get(i, b"")) for i in range(len(texts))], np.int64) // size if whole else np.zeros(len(texts), np.int64)
        more = more + (end is not None)
        new = cuts + np.r_[0, np.cumsum(more)]
        out, added = np.empty(new[-1], self.kind), np.zeros(new[-1], bool)
        at = np.repeat(new[1:] - more, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        added[at] = True
        out[at], out[~added] = np.frombuffer(extra, self.kind), ids
        return _binary(out, new)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words one after another, ids in each): those of its stem, then of its punctuation."""
        bare = pc.ascii_rtrim(words, characters=string.punctuation)
        raw, ends = _bytes(bare)
        last = raw[np.maximum(ends[1:] - 1, 0)] if len(raw) else np.zeros(len(bare), np.uint8)
        cut = (ends[1:] > ends[:-1]) & ALNUM[last]  # else the word is its own stem
        stems = pc.if_else(pa.array(cut), bare, words)
        raw, ends = _bytes(words)
        n = np.diff(_bytes(stems)[1])
        begun, size = ends[:-1] + n, np.diff(ends) - n
        marks = raw[np.repeat(begun - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        tails = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(marks)]).dictionary_encode()
        stems = stems.dictionary_encode()
        held = [*self.known(stems.dictionary.cast(pa.binary()).to_pylist()), *self.known(tails.dictionary.cast(pa.binary()).to_pylist())]
        lengths = np.fromiter(map(len, held), np.int64, len(held)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(held), self.kind)
        parts = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(stems.dictionary)], axis=1).ravel()
        ids, _ = _gathered(pool, np.cumsum(lengths) - lengths, lengths, parts)
        return ids, lengths[parts].reshape(-1, 2).sum(axis=1)


ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, places of the strings' starts and the end)."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    return (np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] else np.zeros(0, np.uint8)), ends.astype(np.int64)


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces `at` of a pool one after another, the places where they start and the end)."""
    each = lengths[at]
    ends = np.r_[0, np.cumsum(each)]
    return (pool[np.repeat(starts[at] - ends[:-1], each) + np.arange(ends[-1])] if ends[-1] else pool[:0]), ends


def _binary(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    places = (cuts * ids.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; it outlives tasks."""
    return worker_object("words", path, lambda: WordEncoder(path))


def bounds(docs: DataFrame, id_col: str, n: int) -> list[int]:
    """At most n - 1 ids that split the rows into ranges of about the same number."""
    (cut,) = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], 10_000)).first() if n > 1 else (None,)
    return sorted(set(cut or []))


def range_count(docs: DataFrame) -> int:
    """Ranges of about RANGE_BYTES of input, one for each shuffle partition at least. The plan's size is an estimate that can be far off above joins, hence the bound."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(-(-size // RANGE_BYTES), 64 * least))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID,
                      shard_ids: int = SHARD_IDS, path: str | None = None) -> str:
    """Encode every text, append end_id, and write <path>/files/<range>-<part>.s8b and a manifest below path (default: in the shared folder); the path.

    The folder must be one that pyarrow can open from the executors. Rows are in ascending order of id_col as a long; null ids come first. Rows of one id are in order of their ids' bytes, so that
    repeated rows stay, one after another. Null and empty texts have the end id alone. An empty table gives an empty manifest. Other
    columns aren't read. Columns of the manifest: range, part (order), file, n_ids, n_docs, crc32.
    """
    spark = docs.sparkSession
    source = tokenizer_path or default_path("word_bpe_49k.json")
    path = path or scratch(spark, "token-files")
    n = range_count(docs)
    cuts = np.array(bounds(docs, id_col, n), np.int64)
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches):
        held, size = [], 0

        def coded() -> dict:
            ids, texts = (pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in (0, 1))
            keys = pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy()
            return {"range": np.searchsorted(cuts, keys), "doc_id": ids, "ids": encoder(source).encode(texts, end_id)}

        for b in batches:
            held, size = [*held, b], size + b.nbytes
            if size >= AT_ONCE:
                yield coded()
                held, size = [], 0
        if held:
            yield coded()

    coded = arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), encode, schema)
    dealt = coded.repartitionById(n, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "ids")
    made = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_ids", "n_docs", "crc32")]])

    def shards(batches):
        kind = encoder(source).kind
        store, base = _store(f"{path}/files")
        store.create_dir(base)
        at, part, docs, counts, ids, size = None, 0, [], [], [], 0

        def file() -> dict:
            image = simple8b.pack(simple8b.Shard(docs, np.concatenate(counts), np.concatenate(ids)))
            name = f"{at:06d}-{part:06d}.s8b"
            unfinished = f"{base}/.{name}-{uuid.uuid4().hex}"  # another attempt may run elsewhere at the same time
            with store.open_output_stream(unfinished) as out:
                out.write(image)
            store.move(unfinished, f"{base}/{name}")
            return {"range": [at], "part": [part], "file": [name], "n_ids": [size], "n_docs": [len(docs)], "crc32": [zlib.crc32(image)]}

        for b in batches:
            ranges, keys = b.column(0).to_numpy(), b.column(1)
            column = b.column(2)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // kind.itemsize
            every = np.frombuffer(column.buffers()[2], kind, ends[-1])
            lo = 0
            while lo < len(ranges):
                if docs and (ranges[lo] != at or size >= shard_ids):
                    yield file()
                    part, docs, counts, ids, size = part + 1 if ranges[lo] == at else 0, [], [], [], 0
                at = int(ranges[lo])
                # as many documents as are of this range and come before the file is full
                full = int(np.searchsorted(ends[lo:], ends[lo] + shard_ids - size))
                hi = min(lo + max(full, 1), int(np.searchsorted(ranges, at, side="right")))
                docs = [*docs, *keys.slice(lo, hi - lo).to_pylist()]
                counts.append(np.diff(ends[lo : hi + 1]).astype(np.int64))
                ids.append(every[ends[lo] : ends[hi]].copy())
                size, lo = size + int(ends[hi] - ends[lo]), hi
        if docs:
            yield file()

    arrow_map(dealt, shards, made).write.parquet(f"{path}/manifest")
    return path


def manifest(spark, path: str) -> DataFrame:
    """The manifest of token files, with base: the ids of all files before each. One number for each range reaches the driver."""
    files = spark.read.parquet(f"{path}/manifest")
    before, starts = 0, []
    for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect():
        starts.append((r["range"], before))
        before += r["n"]
    ranges = spark.createDataFrame(starts, "range int, begins long")
    within = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(F.broadcast(ranges), "range").withColumn("base", F.col("base") + F.col("begins")).drop("begins")


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, read back from the files; ValueError in a task that finds a damaged one."""
    listed = manifest(spark, path).select("file", "n_ids", "n_docs", F.col("crc32").alias("crc"), "base")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def decode(batches):
        store, base = _store(f"{path}/files")
        for b in batches:
            for name, n_ids, n_docs, whole, begins in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                with store.open_input_stream(f"{base}/{name}") as f:
                    image = f.read()
                x = simple8b.unpack(image)
                if zlib.crc32(image) != whole or len(x.ids) != n_ids or len(x.doc_ids) != n_docs:
                    raise ValueError(f"{name} isn't what the manifest says")
                ends = np.cumsum(x.counts)
                raw = memoryview(x.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), x.counts.tolist(), strict=True)]
                yield {"doc_id": x.doc_ids, "start": begins + ends - x.counts, "n_tokens": x.counts, "ids_crc32": crc}

    files = listed.count()
    tasks = min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files // 64)))
    return arrow_map(listed.repartition(max(tasks, 1), "file"), decode, schema)  # a number, else the manifest's few bytes would be one task's
