"""Media columns by content-defined payload chunking (operator 8).

A text's payload (UTF-8, padded with spaces to a positive multiple of 192) is stored as 8-bit samples. A gear hash that rolls over its
bytes cuts it into chunks where the top bits of the hash are zero, so that equal passages give equal chunks wherever they stand. The
stored form of a medium is its header and ordered chunk list followed by its chunks; of equal chunks one copy is kept, chosen by a join of
chunk digests with each digest's owner. Reading back joins the chunk lists with the chunk store, puts the chunks in order, and checks
every chunk and the whole payload by their digests (128 bits of SHA-256).

Bytes travel compressed and as seldom as they can: once to the store, which is bucketed by digest and so isn't shuffled again, and once more to
their medium for those of several chunks. Equal payloads are one medium. A chunk that a large share of the media hold would be one task's
work in that join, so the HOT most common ones (at most HOT x MOST bytes) are broadcast instead.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.runtime import arrow_map, scratch, written

UNIT = 192
#: Bytes of a chunk: least, mean (a power of two) beyond that, most.
LEAST, MEAN, MOST = 1024, 4096, 16384
#: Chunks that are broadcast, and digests of which tasks know the owner, if over OFTEN media hold them.
HOT, OWNED, OFTEN = 256, 50_000, 1000
#: Digests that a task remembers in order not to send a chunk twice.
REMEMBERED = 200_000
#: Payload bytes of a bucket of the store.
BUCKET = 16 << 20
#: Distinct texts and chunks from which the compression dictionary is made, its bytes, and the level. They change what is stored, and with it media_bytes and media_sha256, but by what rows there are alone.
SAMPLE_ROWS, SAMPLE_CHUNKS, DICTIONARY, LEVEL = 1500, 2500, 1 << 16, 9
HEADER = struct.Struct("<4sII")
GEAR = np.array([xxhash.xxh32_intdigest(bytes([c]), 9) for c in range(256)], np.uint32)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def digest_of(data: bytes) -> bytes:
    """The first 16 bytes of SHA-256: the name of a chunk or a medium."""
    return hashlib.sha256(data).digest()[:16]


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks. The hash at a byte covers the 32 bytes up to it: h = 2 h + GEAR[byte], modulo 2^32."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # after each turn h covers 2 k bytes
        h[k:] += h[:-k] << np.uint32(k)
    places = np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + 1
    ends, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(places, at + LEAST)
        at = min(n, at + MOST, int(places[i]) if i < len(places) else n)
        ends.append(at)
    return ends if at == n else [*ends, n]


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def stored_form(size: int, found: list[tuple[bytes, int, bytes]]) -> bytes:
    """A medium as it lies in the store: header (mark, payload bytes, chunks), its list (digest, bytes, stored bytes of each chunk), then the stored chunks (digest, bytes, packed) in order."""
    return b"".join([HEADER.pack(b"CDC2", size, len(found)), *[d + struct.pack("<II", n, len(c)) for d, n, c in found], *[c for _, _, c in found]])


def feature(payload: bytes) -> str:
    """Mean, deviation and zero crossings (about the mean) of the samples."""
    x = np.frombuffer(payload, np.uint8)
    n, s, q = len(x), int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    above = x.astype(np.int64) * n > s
    return f"mean={s / n:.4f};std={max(0, q / n - (s / n) ** 2) ** 0.5:.4f};cross={int((above[1:] != above[:-1]).sum())}"


def _lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media, chunks): the ordered chunk list of each row; media is the payload's digest."""
    piece = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("size", T.IntegerType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("chunks", T.ArrayType(piece))])

    def run(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema.fields[1:]}
            for text in b.column(1).to_pylist():
                p = payload_of(text)
                for name, value in (("n_bytes", len((text or "").encode())), ("payload_bytes", len(p)), ("media", digest_of(p)), ("chunks", [{"digest": digest_of(c), "size": len(c)} for c in chunks(p)])):
                    out[name].append(value)
            yield {"doc_id": b.column(0), **out}

    return arrow_map(docs.select(id_col, text_col), run, schema)


def dictionary_of(docs: DataFrame, text_col: str) -> bytes:
    """A zstd dictionary from whole chunks, chosen by hashes alone, so that no order or split of the rows changes it: the SAMPLE_CHUNKS of least digest among the chunks of the SAMPLE_ROWS distinct texts of least hash. Empty where they are too few."""
    import zstandard

    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash")).where(F.col(text_col).isNotNull())
    least = [r[0] for r in texts.select("hash").distinct().orderBy("hash").limit(SAMPLE_ROWS).collect()]
    chosen = texts.where(F.col("hash").isin(least)).groupBy("hash").agg(F.min("text").alias("text"))
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("chunk", T.BinaryType())])

    def cut(batches):
        for b in batches:
            found = [c for t in b.column(0).to_pylist() for c in chunks(payload_of(t))]
            yield {"digest": [digest_of(c) for c in found], "chunk": found}

    rows = arrow_map(chosen.select("text"), cut, schema).dropDuplicates(["digest"]).orderBy("digest").limit(SAMPLE_CHUNKS).collect()  # SAMPLE_CHUNKS of MOST bytes
    samples = [bytes(r["chunk"]) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes() if len(samples) >= 100 else b""
    except zstandard.ZstdError:
        return b""


def _zstd(dictionary: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _bytes(docs: DataFrame, text_col: str, dictionary: bytes, owners: dict[bytes, bytes]) -> DataFrame:
    """(digest, media, packed): chunks of all payloads, compressed; a medium that a task has sent isn't sent again. Frequent chunks (owners: digest to owner) go with
    their owner alone, so that they don't meet in one task as often as they occur."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("media", T.BinaryType()), T.StructField("packed", T.BinaryType())])

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True, write_dict_id=False, **_zstd(dictionary)).compress
        sent: set[bytes] = set()
        for b in batches:
            out: dict[str, list] = {"digest": [], "media": [], "packed": []}
            for text in b.column(0).to_pylist():
                p = payload_of(text)
                media = digest_of(p)
                if media in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(media)
                for c in chunks(p):
                    digest = digest_of(c)
                    if owners.get(digest, media) == media:
                        for name, value in (("digest", digest), ("media", media), ("packed", pack(c))):
                            out[name].append(value)
            yield out

    return arrow_map(docs.select(text_col), run, schema)


def _single(rows: DataFrame) -> DataFrame:
    """Rows sorted by digest, the first of each digest: repeated rows of a table have the same owner."""

    def run(batches):
        last = None
        for b in batches:
            digest, packed = b.column(0).to_pylist(), b.column(1).to_pylist()
            new = [d != e for d, e in zip(digest, [last, *digest[:-1]], strict=True)]
            last = digest[-1] if digest else last
            yield {"digest": [d for d, k in zip(digest, new, strict=True) if k], "packed": [p for p, k in zip(packed, new, strict=True) if k]}

    return arrow_map(rows.select("digest", "packed"), run, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("packed", T.BinaryType())]))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Write the chunk lists and the chunk store in the shared folder; (lists, chunk store, digests with their number of media, the store's dictionary as one row)."""
    spark = docs.sparkSession
    dictionary = dictionary_of(docs, text_col)
    kept = written(spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary"), "chunk-dictionary")
    lists = written(_lists(docs, id_col, text_col), "chunk-lists")
    media = lists.select("media", "chunks").dropDuplicates(["media"])
    digests = written(media.select("media", F.explode(F.array_distinct("chunks.digest")).alias("digest")).groupBy("digest").agg(F.min("media").alias("owner"), F.count("*").alias("n")), "digests")
    size = lists.agg(F.sum("payload_bytes")).first()[0] or 0
    n = max(8, -(-size // BUCKET))
    often = digests.where(F.col("n") > OFTEN).orderBy(F.desc("n"), "digest").limit(OWNED).select("digest", "owner").collect()
    sent = _bytes(docs, text_col, dictionary, {bytes(r["digest"]): bytes(r["owner"]) for r in often})
    with_owner = sent.repartition(n, "digest").join(digests.select("digest", "owner").repartition(n, "digest").hint("merge"), "digest").where("media = owner")
    path, table = scratch(spark, "chunk-store"), "chunk_store_" + uuid.uuid4().hex[:12]
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # the bytes' shuffle files go once the store is written
    try:
        _single(with_owner.sortWithinPartitions("digest")).write.bucketBy(n, "digest").sortBy("digest").option("path", path).option("compression", "none").saveAsTable(table)
    finally:
        spark.conf.set(clean, before)
    stored = spark.table(table)  # its plan has the files and their buckets; the catalog needn't keep the name
    spark.sql(f"DROP TABLE {table}")
    return lists, stored, digests, kept


def read_back(lists: DataFrame, chunk_store: DataFrame, digests: DataFrame, kept: DataFrame) -> DataFrame:
    """(media, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every medium, from the stored chunks. A chunk or payload that isn't what its
    digest says raises ValueError."""
    dictionary = bytes(kept.first()[0])
    media = lists.select("media", "chunks").dropDuplicates(["media"])
    rows = media.select("media", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "chunk")).select("media", "n", "seq", "chunk.digest")
    hot = digests.where(F.col("n") > OFTEN).orderBy(F.desc("n"), "digest").limit(HOT).select("digest")
    hot = written(hot.join(chunk_store, "digest"), "hot-chunks")  # at most HOT chunks of MOST bytes
    text, number = T.StringType(), T.LongType()
    schema = T.StructType([T.StructField("media", T.BinaryType()), T.StructField("payload_sha256", text), T.StructField("tail_crc32", number), T.StructField("media_bytes", number), T.StructField("media_sha256", text), T.StructField("feature", text)])

    def assemble(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(**_zstd(dictionary)).decompress
        held: list[tuple[bytes, bytes, bytes]] = []
        now, want, rows = None, 0, []

        def take() -> None:
            if len(held) != want:
                raise ValueError(f"medium {now.hex()}: {len(held)} of {want} chunks")
            payload = b"".join(c for _, c, _ in held)
            if digest_of(payload) != now:
                raise ValueError(f"medium {now.hex()}: its chunks give another payload")
            form = stored_form(len(payload), [(d, len(c), packed) for d, c, packed in held])
            rows.append((now, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload)))

        for b in batches:
            for m, n, digest, packed in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if held and m != now:
                    take()
                    held = []
                chunk = unpack(packed)
                if digest_of(chunk) != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                now, want = m, n
                held.append((digest, chunk, packed))
            yield {f.name: [r[k] for r in rows] for k, f in enumerate(schema.fields)}
            rows = []
        if held:
            take()
            yield {f.name: [r[k] for r in rows] for k, f in enumerate(schema.fields)}

    few = F.broadcast(hot)
    cold_rows, hot_rows = rows.join(few, "digest", "left_anti"), rows.join(few.select("digest"), "digest", "left_semi")

    def fetched(which: str) -> DataFrame:
        return cold_rows.where(which).join(chunk_store, "digest").select("media", "n", "seq", "digest", "packed").union(hot_rows.where(which).join(few, "digest").select("media", "n", "seq", "digest", "packed"))

    one = fetched("n = 1").select("media", "n", "digest", "packed")
    several = fetched("n > 1").repartition("media").sortWithinPartitions("media", "seq").select("media", "n", "digest", "packed")
    return arrow_map(one, assemble, schema).union(arrow_map(several, assemble, schema))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), payload_bytes, and what is read back from the store: payload_sha256, tail_crc32 (of the last 16 bytes),
    media_bytes, media_sha256 (of the stored form), feature.

    Null and empty texts have a payload of 192 spaces; null ids stay; repeated rows and equal texts share one medium and have equal values; an empty table gives
    an empty one; other columns, whatever their names, aren't read. A payload is held whole by one task, its chunks never exceed MOST bytes.
    """
    lists, *stored = store(docs, id_col, text_col)
    media = read_back(lists, *stored)
    return lists.select("doc_id", "n_bytes", "payload_bytes", "media").join(media, "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
