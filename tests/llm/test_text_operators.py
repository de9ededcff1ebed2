"""Operators 1, 3, 5, 6, 7 and 9 against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from seriesmend.llm import chat, decontaminate, langid, licenses, queries, token_counts, url_filter
from seriesmend.llm.vocab import default_path

from .helpers import LONG, TEXTS, low_words, odd_docs, rows


def empty(df):
    return df.limit(0)


# ---- 1 -------------------------------------------------------------------------------------------------------------


def test_language_id_on_held_out_rows(spark, sf):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all() and got.accepted.mean() > 0.98


def test_language_id_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, max_rows=200)
    got = langid.identify(odd_docs(spark), model).collect()
    assert len(got) == len(TEXTS)
    for r, (i, t) in zip(got, TEXTS, strict=True):
        assert r.doc_id == i and (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r.score <= 1
    assert langid.identify(empty(odd_docs(spark)), model).count() == 0
    nothing = langid.fit(docs.where("lang = 'none'"))
    assert nothing.predict("text")[:2] == ("und", 0.0)
    kept = langid.identify(odd_docs(spark), model, keep=True)
    assert kept.columns == odd_docs(spark).columns and kept.where("text is null").count() == 0


def test_subwords_are_those_within_words():
    a = langid.normal("Ab c1d")
    assert "".join(map(chr, a)) == " ab c d "
    want = set()
    for n in range(1, 5):
        for i in range(len(a) - n + 1):
            part = a[i : i + n]
            if (n == 1 and part[0] != 32) or (n > 1 and not (part[1:-1] == 32).any()):
                want.add((n, tuple(part)))
    assert len(langid.subwords(a)) == sum(1 for n in range(1, 5) for i in range(len(a) - n + 1) if (n == 1 and a[i] != 32) or (n > 1 and not (a[i + 1 : i + n - 1] == 32).any()))
    assert len(want) > 5


# ---- 3 -------------------------------------------------------------------------------------------------------------


def test_chat_round_trip():
    r = random.Random(0)
    bits = ["<", "|", "\\", "\n", "a", chat.END, chat.START, "n"]
    for _ in range(5000):
        turns = [tuple("".join(r.choice(bits) for _ in range(r.randint(0, 8))) for _ in range(2)) for _ in range(2)]
        text = "".join(chat.render(*t) for t in turns)
        assert chat.parse(text) == turns and text.count(chat.START) == 2 and text.count(chat.END) == 2
    with pytest.raises(ValueError):
        chat.parse("no turn")


def digests(turns):
    out = []
    key = lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, chat.render(r[2] or "", r[3] or ""))
    for _, g in itertools.groupby(sorted(turns, key=key), lambda r: repr(r[0])):
        g = [(c, t, role or "", text or "") for c, t, role, text in g]
        loss = "".join(x[3] for x in g if x[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((g[0][0], len(g), sha("".join(f"{x[2]}\n{x[3]}\n" for x in g)), len(loss), sha(loss), sum(len(chat.render(x[2], x[3])) for x in g)))
    return sorted(out, key=repr)


def test_chat_query(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-1, k, role, "<|im_end|><|im_start|>assistant ok") for k, role in enumerate(("user", "assistant"))]
    assert rows(queries.op3_chat_format(spark, sf)) == digests(turns)


def test_chat_odd_rows(spark):
    data = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "<|x"), (None, 3, "assistant", ""), (None, 2, "as\n\\sistant", LONG), (2, 5, "assistant", "b"), (2, 5, "assistant", "a")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("x")).withColumn("conv", F.lit(1))
    assert rows(chat.format_conversations(df)) == digests(data)
    assert chat.format_conversations(empty(df)).count() == 0


def replay(events):
    """Final messages by going through the log in order."""
    out = {}
    for conv, seq, msg, kind, role, text in sorted(events, key=lambda e: e[1]):
        live = out.setdefault(conv, {})
        gone = out.setdefault((conv, "gone"), set())
        if msg in gone:
            continue
        m = live.setdefault(msg, [seq, "", ""])
        if kind == "regenerate":
            later = [k for k, v in live.items() if v[0] > m[0]]
            for k in later:
                gone.add(k)
                del live[k]
        m[1] = role if role is not None else m[1]
        m[2] = m[2] + text if kind == "delta" else text
    return sorted((c, v[0], k, v[1], v[2]) for c, live in out.items() if not isinstance(c, tuple) for k, v in live.items())


def test_chat_events_against_replay(spark):
    r = random.Random(3)
    events = []
    for conv in range(30):
        for seq in range(r.randint(1, 25)):
            events.append((conv, seq, r.choice([0, None]), f"m{r.randint(0, 6)}", r.choice(["message", "delta", "delta", "edit", "regenerate"]), r.choice([None, "user", "assistant"]), r.choice("abc")))
    df = spark.createDataFrame(events, "conv long, seq long, part int, msg string, kind string, role string, text string")
    got = sorted(tuple(x) for x in chat.messages(df).select("conv", "began.seq", "msg", "role", "text").collect())
    assert got == replay([(c, s, *rest) for c, s, _, *rest in events])


def test_chat_log_has_every_kind_and_gives_the_turns_back(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    log = chat.events_of(turns).collect()
    assert {e.kind for e in log} == set(chat.KINDS)
    every = [((e.conv), (e.seq, e.part), tuple(e.msg), e.kind, e.role, e.text) for e in log]
    want = sorted((r.conv_id, r.turn, r.role, r.text or "") for r in turns.collect())
    assert sorted((c, at[0], role, text) for c, at, _, role, text in replay(every)) == want
    assert sorted((r.conv, r.began.seq, r.role, r.text) for r in chat.messages(chat.events_of(turns)).collect()) == want
    whole = chat.format_turns(chat.messages(chat.events_of(turns))).collect()
    assert all((r.loss is not None) == r.formatted.startswith(f"{chat.START}assistant\n") for r in whole)
    assert all(r.formatted[r.loss.start : r.loss.end] == chat.parse(r.formatted)[0][1] for r in whole if r.loss)


# ---- 5 -------------------------------------------------------------------------------------------------------------


def judge(url):
    host, path = url_filter.parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in queries.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None)


def test_url_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = queries.op5_url_filter(spark, sf).join(pages.select("page_id", "url"), "page_id").collect()
    assert len(got) == pages.count()
    for r in got:
        want = judge(r.url)
        assert (r.host, r.path, r.rule) == want[:3] and r.verdict == (want[3] if len(want) > 3 else r.verdict)


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "x://WWW.example.com/en/1?q#f", "http://a.net/es/", "http://a.net/es", "http://net/fr/x", "http://x.org/ads", "http://ads.org/x", "http://x.org/loads", "a://b?c://com/", "http://" + "a." * 5000 + "com/"]
    df = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)] + [(3, "http://a.net/es/")] * 2, "page_id long, url string").withColumn("host", F.lit(1))
    rules = [url_filter.site_rule(*r) for r in queries.SITE_RULES]
    got = url_filter.filter_urls(df, rules).collect()
    for r, u in zip(got, [*urls, "http://a.net/es/", "http://a.net/es/"], strict=True):
        want = judge(u)
        assert (r.host, r.path, r.rule) == want[:3], u
        assert r.verdict == (want[3] if len(want) > 3 else "block" if u in ("http://x.org/ads", "http://ads.org/x") else "allow"), u
    assert url_filter.filter_urls(empty(df), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, [], []).collect()} == {"allow"}


def test_url_index_misses_no_rule():
    r = random.Random(1)
    word = lambda: "".join(r.choice("ab1") for _ in range(r.randint(1, 2)))
    rules = [url_filter.Rule(r.choice(["", "||", "^"]) + r.choice(["/", ".", "*", "^"]).join(word() for _ in range(r.randint(1, 3))) + r.choice(["", "^", "*", "/"]), "block") for _ in range(80)]
    index = url_filter.RuleIndex(rules, {})
    for _ in range(1500):
        host, path = ".".join(word() for _ in range(r.randint(1, 3))), "".join("/" + word() for _ in range(r.randint(0, 3)))
        all_ = {x.pattern for x in rules if url_filter.compiled(x.pattern).match(host + path)}
        assert all_ == {x.pattern for x, m in index.candidates(host, path) if m.match(host + path)}


def test_patterns_from_a_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/ads/x"), (2, "http://a.org/news"), (3, None), (4, "http://bad.example/x")], "page_id long, url string")
    table = spark.createDataFrame([("/ads/",), (None,), ("/ads/",), ("||bad.example^",)], "pattern string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], table).collect()}
    want = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], [url_filter.Rule("/ads/", "block"), url_filter.Rule("||bad.example^", "block")]).collect()}
    assert got == want and got[1] == "block" and got[2] == got[3] == "allow"
    assert {r.verdict for r in url_filter.filter_urls(pages, [], table.limit(0)).collect()} == {"allow"}


# ---- 6 -------------------------------------------------------------------------------------------------------------


def test_token_counts_are_the_library_s(spark, sf):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    got = token_counts.count_tokens(docs, sample_rows=50).collect()
    for r, d in zip(got, docs.collect(), strict=True):
        n = len(model.encode(d.text or ""))
        assert tuple(r) == (d.doc_id, len((d.text or "").encode()), n, n > 4096)
    assert token_counts.count_tokens(empty(odd_docs(spark))).count() == 0


def test_token_count_cache_turns_over(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 20)
    m = token_counts.PieceCounter(default_path("piece_bpe_32k.model"))
    r = random.Random(1)
    bits = [" ", "  ", "a", "b", "\n", "▁", "é", "ﬁ", "\u3000", "\0", "<s>", "</s>", "\t", "word", ".", "\u0301", "🙂", "<unk>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for lo in range(0, len(texts), 50):
        assert m.count(texts[lo : lo + 50]) == m.lengths(texts[lo : lo + 50])


# ---- 7 -------------------------------------------------------------------------------------------------------------


def contaminated(docs, items, window=10):
    found = {}
    for i, t in items:
        w = low_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(None if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, of = low_words(t), set(), set()
        for n in set(map(len, found)):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in found:
                    of |= found[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(x for x in of if x is not None)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(r[-1] for r in want) and rows(queries.op7_decontamination(spark, sf)) == want
    assert rows(decontaminate.contamination(docs, bench, most_bytes=2000)) == want
    clean = {r[0] for r in want if not r[-1]}
    for bound in (2000, 1 << 20):
        kept = decontaminate.contamination(docs, bench, keep=True, most_bytes=bound)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean


def test_decontamination_odd_rows(spark):
    items = [(1, "no id HERE"), (2, None), (3, ""), (4, "fox is réal the"), (4, "again"), (None, "the quick brown"), (5, "b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd_docs(spark)
    want = contaminated([(i, t) for i, t in TEXTS], items)
    for bound in (10, 1 << 20):
        assert rows(decontaminate.contamination(docs, bench, most_bytes=bound)) == want
    assert decontaminate.contamination(empty(docs), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, empty(bench)).collect())
    spans = [r.spans for r in decontaminate.contamination(docs, bench, spans=True).collect()]
    for s, (_, t) in zip(spans, TEXTS, strict=True):
        assert all(low_words(t[x.start : x.end]) and t[x.start] not in " \n" for x in s)


# ---- 9 -------------------------------------------------------------------------------------------------------------


def test_license_base_places(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    for r, d in zip(licenses.scan_licenses(docs).collect(), docs.collect(), strict=True):
        w = low_words(d.text)
        hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + p.count(" ") + 1] == p.split()]
        at = [i for i, _ in hits]
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) == (d.doc_id, len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(empty(odd_docs(spark))).count() == 0


def test_license_seeds_lose_no_match():
    """Every notice within its edits is found, by a whole-line fuzzy search without seeds."""
    scanner = licenses.NoticeScanner({}, licenses.NOTICES)
    r = random.Random(2)
    for label, notice, most in licenses.NOTICES:
        for _ in range(15):
            s = list(notice)
            for _ in range(r.randint(0, most)):
                k = r.randrange(1, len(s) - 1)
                s[k : k + 1] = r.choice([[], ["q"], [s[k], "z"]])
            line = f" before {''.join(s)} after ".encode()
            whole = regex.compile(rb"(?be)(?<= )(?:%b){e<=%d}(?= )" % (regex.escape(notice.encode(), literal_spaces=True), most)).search(line)
            found = [x for x in scanner.fuzzy(line) if x[2] == label]
            assert (whole is not None) == any(e <= most for *_, e in found) or whole is None
            if whole is not None:
                assert any(a <= whole.start() + most and b >= whole.end() - most for a, b, *_ in found)


def test_license_notices_before_a_better_one():
    notices = ["released undr the mit license", "released under the mit license", "released under teh mit license"]
    for order in itertools.permutations(notices):
        line = f" {' '.join(order)} ".encode()
        assert [line[a:b].decode() for a, b, *_ in licenses.NoticeScanner({}, licenses.NOTICES).fuzzy(line) if b - a > 20] == list(order)


def edits_within(pattern, text):
    """Least edits of pattern against any part of text (Sellers' dynamic program)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b)))
    return min(row)


def test_license_lines_of_several_notices():
    """Every planted notice within its edits is reported where it stands, whatever stands around it."""
    scanner = licenses.NoticeScanner({}, licenses.NOTICES)
    r = random.Random(5)
    for _ in range(60):
        line, planted = " ", []
        for _ in range(r.randint(2, 6)):
            if r.random() < 0.5:
                line += " ".join(r.choice(["the", "of", "license", "mit", "copy", "x1"]) for _ in range(r.randint(1, 5))) + " "
            label, notice, most = r.choice(licenses.NOTICES)
            s = list(notice)
            for _ in range(r.randint(0, most // 2)):
                k = r.randrange(1, len(s) - 1)
                s[k : k + 1] = r.choice([[], ["q"], [s[k], "z"]])
            planted.append((len(line), len(line) + len(s), label, most, edits_within(notice, "".join(s))))
            line += "".join(s) + " "
        found = scanner.fuzzy(line.encode())
        for a, b, label, most, edits in planted:
            assert edits <= most and any(x == label and min(b, d) - max(a, c) >= (b - a) / 2 and e <= most for c, d, x, e in found), (line, a, b, found)


def test_license_spans(spark):
    text = "X. Permision is hereby granted, free of charge, to any persons obtaining the copy. MIT  license"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = licenses.scan_licenses(df).first()
    got = {text[s.start : s.end]: (s.label, s.edits) for s in r.spans}
    assert got["MIT  license"] == ("mit", 0) and any(k.startswith("Permision") and v[0] == "mit" and 0 < v[1] <= 6 for k, v in got.items())


def test_arrow_types_survive(spark):
    """Large strings and binaries go through the shared map as they are."""
    from pyspark.sql import types as T

    from seriesmend.runtime import arrow_map

    df = spark.createDataFrame([("x",)], "a string")
    out = arrow_map(df, lambda bs: ({"b": [np.int64(3)], "c": pa.array(["y"], pa.large_string())} for _ in bs), T.StructType([T.StructField("b", T.LongType()), T.StructField("c", T.StringType())]))
    assert [tuple(r) for r in out.collect()] == [(3, "y")]
