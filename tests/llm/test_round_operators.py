"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesmend.llm import clusters, langid, licenses, media, mixing, packing, periodic, queries
from seriesmend.llm.vocab import default_path
from seriesmend.llm.words import joined

from .helpers import TEXTS, odd_docs, rows

# ---- 11 ------------------------------------------------------------------------------------------------------------


def plain_clusters(vectors, k=16, rounds=3, seed=1, scale=64.0, dimensions=64):
    """(rows of id, cluster, distance; centroids) with Python's integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~"
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), clusters.pack(np.array([r[1]]))[0]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def check_clusters(spark, vectors, **how):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("a.b", F.lit(1)).withColumn("packed", F.lit(2)).withColumn("cluster", F.lit(3))
    found = clusters.cluster_vectors(df, **how)
    want, centroids = plain_clusters(vectors, **how)
    assert rows(found.assigned.select("vec_id", "cluster", "distance")) == sorted(want, key=repr)
    assert found.centroids.tolist() == centroids
    per = {}
    for _, c, d in want:
        per[c] = per.get(c, 0) + d
    for r in found.with_inertia(spark).collect():
        assert (r.cluster_inertia, r.inertia) == (per[r.cluster], sum(per.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    return found


def test_clusters_of_odd_vectors(spark):
    good = lambda s: [math.sin(s * 7 + j) for j in range(64)]
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, good(3)[:63]), (4, [*good(4), 0.5]), (5, [*good(5)[:63], None]), (6, [*good(6)[:63], nan]), (7, [-inf, *good(7)[:63]])]
    check_clusters(spark, odd)  # nothing is kept
    check_clusters(spark, [])
    few = [(i, good(i)) for i in range(5)] + odd + [(None, good(1)), (None, good(2))]
    check_clusters(spark, few)  # fewer vectors than centroids
    check_clusters(spark, [(i, [float(i % 3)] * 64) for i in range(40)] + [(7, [1.0] * 64)] * 9)  # ties: equal vectors, equal centroids, repeated rows
    check_clusters(spark, [(i, [x * 10.0 ** (i % 6) for x in good(i)]) for i in range(60)])  # all widths
    with pytest.raises(Exception, match="beyond"):
        check_clusters(spark, [(1, [1e9] * 64)])
    with pytest.raises(ValueError, match="k is"):
        clusters.cluster_vectors(spark.createDataFrame(few, "vec_id long, embedding array<double>"), k=0)


@pytest.mark.parametrize("k,dimensions,rounds", [(1, 3, 2), (2, 1, 3), (40, 2, 6), (9, 64, 3)])
def test_clusters_of_lattices(spark, k, dimensions, rounds):
    """Small integers: many vectors are as far from one centroid as from another."""
    rng = random.Random(k)
    vectors = [(i, [float(rng.randrange(7)) for _ in range(dimensions)]) for i in range(400)]
    check_clusters(spark, vectors, k=k, dimensions=dimensions, rounds=rounds, scale=1.0, seed=5)


def test_clusters_at_any_partitions(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    plain = sorted(plain_clusters(want)[0])
    for n in (1, 7):
        assert sorted(tuple(r) for r in clusters.cluster_vectors(table.repartition(n)).assigned.select("vec_id", "cluster", "distance").collect()) == plain


def test_search_skips_and_is_exact():
    rng = np.random.default_rng(3)
    centers = rng.integers(-900, 900, (30, 8))
    x = (centers[rng.integers(0, 30, 5000)] + rng.integers(-40, 40, (5000, 8))).astype(np.int64)
    centroids, before, total = x[:30].copy(), None, 0
    cluster, upper, lower = np.zeros(5000, np.int32), np.full(5000, np.inf), np.full(5000, -np.inf)
    for _ in range(6):
        search = clusters.Search(centroids, before)
        cluster, upper, lower = search.assign(x, cluster, upper, lower)
        every = ((x[:, None] - centroids[None]) ** 2).sum(-1)
        assert (cluster == every.argmin(axis=1)).all()
        rest = every.copy()
        rest[np.arange(5000), cluster] = np.iinfo(np.int64).max
        assert (upper >= np.sqrt(every.min(axis=1))).all() and (lower <= np.sqrt(rest.min(axis=1))).all()
        total += search.scanned
        before, centroids = centroids, np.array([x[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(30)])
    assert total < 6 * 5000 * 30 / 3


def test_vectors_packed_and_unpacked():
    x = np.array([[-128, 127, 0], [128, 0, 0], [-129, 0, 0], [32767, -32768, 1], [32768, 0, 0], [-(1 << 27), 1 << 27, 5], [0, 0, 0]])
    assert [len(b) // 3 for b in clusters.pack(x)] == [1, 2, 2, 2, 4, 4, 1]
    assert (clusters.unpack(pa.array(clusters.pack(x)), 3) == x).all()


# ---- 12 ------------------------------------------------------------------------------------------------------------


def check_packing(spark, df, size=1024):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    docs = [(r[0], [*model.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in df.select("doc_id", "text").collect()]
    made = packing.pack_sequences(df, size=size)
    sequences = sorted(made.collect(), key=lambda r: r.sequence_id)
    total = sum(len(ids) for _, ids in docs)
    assert [r.sequence_id for r in sequences] == list(range(-(-total // size)))
    assert all(r.n_tokens == size for r in sequences[:-1])
    line = []
    for r in sequences:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.n_tokens == sum(r.length) and r.padded_to == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else size)
        assert r["at"] == [sum(r.length[:k]) for k in range(len(r.length))]
        line += [(r, k, ids[a : a + n]) for k, (a, n) in enumerate(zip(r["at"], r.length, strict=True))]
    # the pieces of each document, put together again: the line has them one after another
    whole, open_ = [], []
    for r, k, ids in line:
        assert r.start[k] == len(open_)
        open_ += ids
        if len(open_) == r.doc_tokens[k]:
            whole.append((r.doc_id[k], open_))
            open_ = []
    assert not open_ and sorted(whole, key=repr) == sorted(docs, key=repr)
    want = sorted([(r.doc_id[k], r.start[k], r.length[k], zlib.crc32(np.array(ids, "<u4").tobytes()), r.doc_tokens[k], r.sequence_id, r["at"][k], r.padded_to) for r, k, ids in line], key=repr)
    assert rows(packing.piece_digests(made).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to")) == want


def test_packing_of_odd_texts(spark):
    for n in (1, 3, 20):
        check_packing(spark, odd_docs(spark).withColumn("ids", F.lit(2)).repartition(n))
    check_packing(spark, odd_docs(spark).repartition(5), size=7)
    check_packing(spark, odd_docs(spark).where("false"))
    check_packing(spark, spark.createDataFrame([(i, None) for i in range(64)], "doc_id long, text string").repartition(9), size=16)  # the last one is a power of two
    check_packing(spark, spark.createDataFrame([(f"x{i}", "a b") for i in range(9)], "doc_id string, text string"), size=1)


def test_packing_of_documents(spark, sf):
    check_packing(spark, queries.table(spark, sf, "documents").repartition(6))


def test_pieces_are_the_librarys_ids(sf):
    encoder = packing.ByteEncoder(default_path("byte_bpe_50k.json"))
    assert encoder.by_pieces
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", "\t", "'s", "'", "a", "The", "é", "1", ".", ",", "--", "　", "\x85", "🙂", "<|endoftext|>", "日本", "\x1c", "ſ", "'LL"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(4000)]
    texts += [r[0] for r in duckdb.sql(f"SELECT coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall()]
    want = encoder.ids(texts)
    assert encoder.encode(pa.array(texts)).to_pylist() == want
    assert encoder.encode(pa.array([*texts, None]).slice(1), 0).to_pylist() == [*[x + b"\0\0" for x in want[1:]], b"\0\0"]


# ---- 13 ------------------------------------------------------------------------------------------------------------


def plain_runs(words, least=24):
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_of_random_words():
    rng = random.Random(2)
    texts = []
    for k in range(400):
        words = []
        while len(words) < rng.randrange(1, 200):
            block = [rng.choice(["a", "b", "c"][: 1 + k % 3]).encode() for _ in range(rng.randrange(1, 20))]
            words += (block * rng.randrange(1, 12))[: rng.randrange(1, 90)]
        texts.append(words)
    texts += [[], [b"a"] * 23, [b"a"] * 24, [b"a"] * 5000, [b"a", b"b"] * 700 + [b"a"], [*[b"a"] * 300, b"b"] * 40, [str(i % 200).encode() for i in range(601)], [str(i % 201).encode() for i in range(602)]]
    assert sum(map(len, map(plain_runs, texts))) > 300
    for least in (24, 1, 5, 100):
        assert periodic.runs_of(texts, least) == [plain_runs(t, least) for t in texts]
    assert [periodic.runs_of([t])[0] for t in texts] == periodic.runs_of(texts)


def plain_collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def test_periodic_runs_of_odd_texts(spark):
    loops = ["x y z " * 30, "a " * 100_000, "q " + "r s " * 15 + "t", "é　\x85 " * 40, "a b\tc\n" * 20 + "a b c d " * 20]
    docs = odd_docs(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(100 + i, t, None) for i, t in enumerate(loops)], "doc_id long, text string, lang string"))
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("runs", F.lit(2)).repartition(3)
    want = []
    for i, t in [*TEXTS, *[(100 + i, t) for i, t in enumerate(loops)]]:
        words = (t or "").encode().split()
        runs = periodic.runs_of([words])[0] if len(words) > 1000 else plain_runs(words)
        want.append((i, len(words), runs, plain_collapsed(words, runs).decode() if len(words) < 50_000 else "a"))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.where("false")).collect() == []


def test_periodic_query_against_brute_force(spark, sf):
    want = []
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len((text or "").encode().split())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
        digest = lambda x: hashlib.sha256(x).hexdigest()
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(plain_collapsed(words, runs))))
    got = queries.op13_periodic_runs(spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert rows(got) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 10


# ---- what holds for earlier operators ------------------------------------------------------------------------------


def test_media_do_not_depend_on_the_order_of_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert len(media.dictionary_of(docs, "text")) > 1000
    want = rows(media.media_columns(docs))
    assert rows(media.media_columns(docs.orderBy(F.xxhash64("doc_id")).repartition(7))) == want
    assert rows(media.media_columns(docs.repartition(3).sortWithinPartitions(F.desc("text")))) == want


def test_copies_of_a_row_are_dealt_as_one(spark, monkeypatch):
    """200 equal rows at half a rate are 100, wherever they lie; totals of a table of copies are what is expected."""
    docs = spark.createDataFrame([(i, f"alpha beta {i} gamma", "x") for i in range(40) for _ in range(1 + i * i % 97)] + [(100, "one two three", "x")] * 200, "doc_id long, text string, `a.b` string").repartition(6)
    labelled = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)], "id long, domain string")
    targets = {"a": 0.5, "b": 0.5}
    for total, group in ((None, 100_000), (4000.0, 100_000), (4000.0, 30)):
        monkeypatch.setattr(mixing, "GROUP", group)
        rate = {r.doc_id: r.rate for r in mixing.with_rates(docs, labelled, targets, total=total).select("doc_id", "rate").distinct().collect()}
        had = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
        mixed = mixing.mix(docs, labelled, targets, total=total)
        assert mixed.columns == docs.columns
        got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
        for i, n in had.items():
            assert abs(got.get(i, 0) - n * rate[i]) <= (1.001 if group > 1000 or n <= 30 else 2 + n / 30)
        if group > 1000:
            want = sum(had[i] * rate[i] for i in had)
            assert abs(sum(got.values()) - want) <= 0.01 * want + 3
    assert "residual" in mixing.with_rates(docs, labelled, targets).columns


def test_notices_on_end_take_time_in_proportion():
    scanner = licenses.NoticeScanner(licenses.PHRASES, licenses.NOTICES)
    for text, n in (("licensed undr cc by ", 3000), ("permission is hereby granted free of charge to any person obtaining a coppy ", 1000)):
        assert len(scanner.fuzzy(joined(text * n)[0])) == n
    mixed = joined("released undr the mit license released under the mit license released under teh mit license")[0]
    assert [(mixed[a:b], e) for a, b, _, e in scanner.fuzzy(mixed)] == [(b"released undr the mit license", 1), (b"released under the mit license", 0), (b"released under teh mit license", 2)]


def plain_language(model, text):
    """A prediction from the model's arrays, letter by letter."""
    line = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    line = " ".join(line.split(" ")).strip(" ")
    while "  " in line:
        line = line.replace("  ", " ")
    if not line:
        return "und", 0.0, False
    line = " " + line + " "
    m, top = [int(x) for x in langid.MULTIPLIERS], 1 << 32
    found = []
    for i in range(len(line)):
        h = ord(line[i]) * m[0] % top
        if line[i] != " ":
            found.append(h * m[3] % top)
        for n in range(2, langid.LONGEST + 1):
            if i + n > len(line) or " " in line[i + 1 : i + n - 1]:
                break
            h = (h ^ (ord(line[i + n - 1]) + n)) * m[n - 1] % top
            h ^= h >> 15
            found.append(h * m[3] % top)
    buckets = [h >> (32 - (langid.BUCKETS.bit_length() - 1)) for h in found]
    z = [(sum(float(model.logits[b][k]) for b in buckets) / len(buckets) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
    e = [math.exp(x - max(z)) for x in z]
    k = e.index(max(e))
    score = e[k] / sum(e)
    return model.languages[k], score, score >= model.least_score and sum(bool(model.known[b]) for b in buckets) / len(buckets) >= model.least_known


def test_languages_are_predicted_as_defined(spark, sf):
    docs = queries.table(spark, sf, "documents")
    model = langid.fit(docs.where(langid.learnable(F.col("doc_id"))))
    every = docs.select("doc_id", "text").unionByName(odd_docs(spark).where("doc_id <> 5").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))
    got = {}
    for r in langid.identify(every.dropDuplicates(["doc_id"]), model).collect():
        got[r.doc_id] = (r.lang_pred, r.score, r.accepted)
    for r in every.dropDuplicates(["doc_id"]).collect():
        if len(r.text or "") < 6000:
            lang, score, accepted = plain_language(model, r.text)
            assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-5
            assert got[r.doc_id][2] == accepted or abs(score - model.least_score) < 1e-5
    right = docs.where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang").collect()
    assert sum(got[r.doc_id][0] == r.lang for r in right) >= 0.95 * len(right)
