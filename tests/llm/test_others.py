"""URL rules, languages, parsing, media, toxicity and archives."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, media, parsing, toxicity, urlfilter, warc
from millrace.llm.base import new_path

RULES = urlfilter.RULES


def drawn(host, path, query):
    """Whether the query's list has this URL: every 16th by the hash of its canonical form."""
    bare = host.removeprefix("www.").removesuffix(":80").removesuffix(":443")
    for end in ("/index.html", "/index.htm", "/"):
        if path.endswith(end):
            path = path[: -len(end)]
            break
    return bool(host) and int(hashlib.md5((bare + path + query).encode()).hexdigest()[:8], 16) % 16 == 0


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    query = tail[len(path) :].split("#")[0]
    return host, path, None, "block" if drawn(host, path, query if len(query) > 1 else "") else "allow"


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.ORG/es/x?y#z", "http://a.example.org/en/12", "http://a.example.org/en/2", "http://notexample.org/es/", "http://x.com/fr", "http://x.com/fr/1", "http://com/de/", "http://spam-farm.example.net/a", "http://www.b.net:80/q/", "ftp://x.org?a/", "http://x.org#/", "a://b://c.org/"]
    urls += [f"https://www.h{k}.net/p{k % 5}/{'?id=' + str(k) if k % 3 else ''}" for k in range(200)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    got = urlfilter.judge(df, urlfilter.rule_table(spark), urlfilter.listed_urls(df)).collect()
    assert len(got) == 2 * len(urls)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id]), urls[r.page_id]


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    filled = urlfilter.build_filter(keys, 64)
    hit = keys.where(urlfilter.maybe_listed(filled)(F.xxhash64("key"))).count()
    assert hit == 3000
    some = spark.range(3000, 6000).select(F.concat(F.lit("k"), "id").alias("key"))
    assert some.where(urlfilter.maybe_listed(urlfilter.build_filter(keys, 1 << 12))(F.xxhash64("key"))).count() < 100


def test_urls_of_any_length(spark):
    rows = [(1, "http://" + "a." * 5000 + "example.org/es/" + "x" * 100_000), (2, "http://" + "b." * 8000 + "net/" + "y" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("b." * 8000 + "net/" + "y" * 50_000,)], "key string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df, urlfilter.rule_table(spark), listed).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "block")}
    assert urlfilter.judge(df.limit(0), urlfilter.rule_table(spark), listed.limit(0)).collect() == []


def test_listed_urls_and_false_positives(spark):
    urls = [f"http://h{i}.net/p{i % 7}/" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.net/p{i % 7}",) for i in range(0, 600, 5)], "key string")
    for blocks in (1, None):  # of 256 bits: most keys pass a filter of one block, and the join takes them out
        got = urlfilter.judge(df, urlfilter.rule_table(spark), listed, blocks).collect()
        assert {r.page_id for r in got if r.verdict == "block"} == set(range(0, 600, 5)) == {r.page_id for r in got if r.listed}


def test_queries_are_part_of_a_url(spark, tmp_path, monkeypatch):
    (tmp_path / "list.txt").write_text("# bad pages\n\nhttp://www.a.net/x/?id=1#top\nhttps://a.net/y/index.html\nno url\n")
    listed = urlfilter.url_list(spark, str(tmp_path / "list.txt"))
    urls = ["http://a.net/x?id=1", "http://a.net/x?id=2", "http://a.net/x", "https://www.a.net:443/y/", "http://a.net/y#z", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    blocked = lambda: {r.page_id for r in urlfilter.judge(df, urlfilter.rule_table(spark), listed).collect() if r.verdict == "block"}
    assert blocked() == {0, 3, 4}
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", 0)  # a list too long for any filter
    assert blocked() == {0, 3, 4}


def planted(spark, folder, rows):
    """documents of (doc_id, text, lang) and labels of toxic."""
    spark.createDataFrame([(i, t, lang, "s") for i, t, lang, _ in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, _, y in rows if y is not None], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_queries_of_models(spark, tmp_path):
    """op6 and op9 on planted documents: all texts long, some rows repeated thousands of times, null, blank and unspaced ones."""
    rng = random.Random(9)
    sets = {"aa": ["th", "ing", "er"], "bb": ["ção", "os", "ue"]}
    words = lambda k, n: ["".join(rng.choice(sets[k]) for _ in range(rng.randint(2, 4))) for _ in range(n)]

    def text(k, bad):
        out = words(k, 2600)  # over both models' bounds
        for at in range(20, len(out), 40) if bad else ():
            out[at] = rng.choice(["zork!", "Blarg", "snarf"])
        return " ".join(out)

    rows = [(i, text("ab"[i % 2] * 2, i % 3 == 0), "ab"[i % 2] * 2, int(i % 3 == 0)) for i in range(120)]
    rows += [(500, rows[1][1][:300], "bb", 0)] * 3000 + [(900, None, "aa", 1), (901, "", None, None), (902, "123 ..", None, None), (903, "thinger" * 900, None, None)]
    planted(spark, tmp_path, rows)
    got = {r.doc_id: r for r in langid.op6_language_id(spark, str(tmp_path)).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows[:120]]) > 0.97 and {i for i, r in got.items() if r.held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    scored = toxicity.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    by_id = {r.doc_id: r for r in scored}
    assert np.mean([by_id[i].predicted == y for i, _, _, y in rows[:120]]) > 0.9


def test_unspaced_runs_are_read_to_their_end():
    rng = random.Random(10)
    make = lambda bad: "".join(rng.choice("abcde") for _ in range(600)) + ("zorkblarg" * 30 if bad else "")
    model = toxicity.train([make(k % 2) for k in range(200)], [k % 2 for k in range(200)])
    test = [make(k % 2) for k in range(60)]
    assert np.mean((model.scores(test) >= 0.5) == (np.arange(60) % 2 == 1)) > 0.9
    head = "x" * 300
    assert model.scores([head + "zorkblarg" * 30])[0] != model.scores([head + "abcde" * 54])[0]
    assert "".join(toxicity.words_of("é" * 1000)) == "é" * 1000 and max(map(len, toxicity.words_of("é" * 1000))) <= toxicity.MAX_WORD


def test_models_without_labels(spark, tmp_path):
    planted(spark, tmp_path, [(1, "a text", None, None), (2, None, None, None)])
    assert {r.lang_pred for r in langid.op6_language_id(spark, str(tmp_path)).collect()} == {"und"}
    assert {r.score for r in toxicity.op9_toxicity(spark, str(tmp_path)).collect()} == {0.0}
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert langid.identify(empty, None).collect() == [] and toxicity.score_documents(empty, None).collect() == []


def test_many_languages_are_all_learnt(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 9, f"l{i}") for i in range(240)]
    texts, langs = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(langs) == {f"l{i}" for i in range(240) if zlib.crc32(str(i).encode()) % 5}


def test_languages():
    rng = random.Random(3)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60))
    sets = {"aa": ["th", "ing", "er"], "bb": ["ção", "os", "ue"], "cc": ["sch", "ich", "ung"]}
    texts, labels = zip(*[(make(p), k) for k, p in sets.items() for _ in range(60)], strict=True)
    model = langid.train(list(texts), list(labels))
    names, scores = model.predict([make(p) for k, p in sets.items() for _ in range(20)] + [None, "", "123 !?"])
    assert np.mean([a == b for a, b in zip(names, [k for k in sets for _ in range(20)] + ["und"] * 3, strict=True)]) > 0.97
    assert all(0 <= s <= 1 for s in scores) and names[-3:] == ["und"] * 3
    assert (model.weights == 0).mean() > 0.5 and langid.train([], []) is None
    assert langid.gram_counts("abc " * 40_000).sum() > 400_000  # across chunks


def test_parsing_is_locally_consistent():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    whole = parsing.sketches([text], 10**9)[0]
    for shift in ("x", "some words before ", "z" * 37):
        moved = parsing.sketches([shift + text + " after"], 10**9)[0]
        assert len(np.intersect1d(whole, moved)) / len(whole) > 0.9
    alone = [parsing.sketches([t])[0] for t in ("", "a", "aaaa", text, "ab" * 50)]
    together = parsing.sketches(["", "a", "aaaa", text, "ab" * 50])
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    assert parsing.likeness(whole[:64], whole[:64]) == 1 and parsing.likeness(whole[:64], together[1]) < 0.1
    assert parsing.likeness(together[0], together[0]) == 1 and parsing.likeness(together[0], together[1]) == 0


def test_edited_texts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i * 3, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90)))) for i in range(40)] + [(200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in parsing.op7_fingerprints(spark, str(tmp_path), ranges=7).collect()}
    assert len(got) == 41
    texts = [t or "" for _, t in rows]
    for k, (d, _) in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == parsing.as_string(parsing.sketches([text])[0]) and r.edited_fingerprint == parsing.as_string(parsing.sketches([edited])[0])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_edited_texts_of_shared_ids(spark, tmp_path):
    """Null ids first, then ids; rows of one id by their text's hash. Ranges part them where they are many."""
    rng = random.Random(16)
    text = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 60)))
    rows = [(None, text()) for _ in range(60)] + [(7, text()) for _ in range(80)] + [(i, text()) for i in range(20)] + [(7, "again")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("th", F.xxhash64("text"))
    df.drop("th").write.parquet(str(tmp_path / "documents.parquet"))
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.th, r.doc_id, r.text) for r in df.collect()))
    want = []
    for k, (*_, d, t) in enumerate(order):
        following, cut = order[(k + 1) % len(order)][4], len(t) // 4
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()))
    for ranges in (1, 40):
        got = parsing.op7_fingerprints(spark, str(tmp_path), ranges).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert len({r["range"] for r in parsing.ranged_with_next(df.drop("th"), 40).where("doc_id IS NULL OR doc_id = 7").collect()}) > 20
    one = parsing.ranged_with_next(df.drop("th").limit(1)).collect()
    assert sorted(r.own for r in one) == [False, True] and parsing.ranged_with_next(df.drop("th").limit(0)).collect() == []


def test_media_query(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 3000)))) for i in range(30)] + [(40, None), (41, ""), (42, "é" * 40_000), (43, "same"), (44, "same")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op8_media(spark, str(tmp_path)).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        payload, r = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)), got[i]
        stored = media.wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        blocks, spans, _ = media.features(stored)
        assert r.feature.split(":")[0] == str(len(spans)) and hashlib.sha256(blocks.astype(np.float16).tobytes()).hexdigest()[:16] == r.feature.split(":")[2]
    assert got[43].feature == got[44].feature and got[40].feature == got[41].feature
    empty = media.write_media(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), new_path(spark, "e"))
    assert media.audio_features(empty, new_path(spark, "e")).collect() == []


def test_media(spark, tmp_path):
    for up, down in ((1, 2), (2, 3), (3, 2)):
        x, kernel = np.random.default_rng(1).random(300), media._lowpass(up, down)
        wide = np.zeros(300 * up)
        wide[::up] = x
        full = np.convolve(wide, kernel)[len(kernel) // 2 :][: 300 * up : down]
        assert np.allclose(media.resample(x, up, down, kernel), full[: -(-300 * up // down)])
    assert media.unwav(media.wav(b"abc")) == (b"abc", media.RATE)
    rows = [(1, None, "a"), (2, "", "b"), (3, "é" * 5000, "c"), (4, "hello " * 3000, "d"), (4, "hello " * 3000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = media.write_media(df, new_path(spark, "t"))
    for r in stored.collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        payload = media.unwav(r.media)[0]
        assert len(payload) % 64 == 0 and len(payload) > 0 and payload[: r.n_bytes] == text.encode() and not payload[r.n_bytes :].strip(b"\0")
    blank = stored.select(F.lit(9).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("media"), "n_bytes").limit(1)
    found = media.audio_features(stored.select("doc_id", "media", "n_bytes").unionByName(blank), new_path(spark, "t")).collect()
    assert len(found) == 6 and {r.doc_id for r in found if r.tensors is None} == {9}
    wavs = {r.doc_id: r.media for r in stored.collect()}
    for r in found[:5] if found[-1].doc_id == 9 else [r for r in found if r.tensors is not None]:
        blocks, spans, segments = media.features(wavs[r.doc_id])
        assert np.array_equal(np.array(r.tensors, np.float32).reshape(blocks.shape), blocks.astype(np.float16).astype(np.float32))
        assert [tuple(x) for x in r.spans] == spans and [tuple(x) for x in r.segments] == segments
    assert media.as_tensors(np.zeros((2, media.BLOCK_FRAMES, media.MELS))).type.shape == [media.BLOCK_FRAMES, media.MELS]
    assert media.segments(np.r_[np.zeros(20), np.ones(10) * 5, np.zeros(20)]) == [(20, 30)]


def test_media_features_keep_every_frame():
    rng = random.Random(12)
    for n in (64, 640, 9000, 40_000):
        samples = bytes(rng.randrange(97, 123) for _ in range(n))
        mels = media.log_mels(media.resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128))
        blocks, spans, segments = media.features(media.wav(samples))
        assert len(blocks) == len(spans) == -(-len(mels) // media.BLOCK_FRAMES)
        assert np.array_equal(blocks.reshape(-1, media.MELS)[: len(mels)], mels)
        assert spans[0][0] == 0 and spans[-1][1] == pytest.approx(len(mels) * 0.024) and all(b == c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        assert all(0 <= a < b <= spans[-1][1] for a, b in segments)


def test_toxicity_learns_words_and_gradients():
    rng = random.Random(8)
    clean = lambda n: [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))) for _ in range(n)]

    def doc(bad):
        words = clean(rng.randint(5, 150))
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["zork!", "Blarg", "snarf"])
        return " ".join(words)

    texts, labels = zip(*[(doc(k % 3 == 0), int(k % 3 == 0)) for k in range(300)], strict=True)
    model = toxicity.train(list(texts), list(labels))
    test = [(doc(k % 2 == 0), k % 2 == 0) for k in range(100)]
    scores = model.scores([t for t, _ in test])
    assert np.mean((scores >= 0.5) == np.array([b for _, b in test])) > 0.9
    assert all(0 <= s <= 1 for s in model.scores([None, "", " "])) and toxicity.train(["a"], [1]) is None
    ids = np.array([[1, 2, 3] + [0] * (toxicity.WINDOW - 3)])
    model._inputs = {w: np.random.default_rng(0).standard_normal((4, 3 * toxicity.HIDDEN)) for w in "fb"}
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    logit, tape = model.run(ids, keep=True)
    g, dx = model.gradients(ids, np.ones(1), tape)
    for name in ("Uf", "Ub", "att", "out"):
        at, eps = (0,) * model.p[name].ndim, 1e-3
        model.p[name][at] += eps
        up = model.run(ids)[0]
        model.p[name][at] -= 2 * eps
        down = model.run(ids)[0]
        model.p[name][at] += eps
        assert (up - down) / (2 * eps) == pytest.approx(g[name][at], abs=2e-2)


def test_labels_of_absent_documents_take_no_place(spark):
    """Only labelled documents that exist compete for the sample's places: 60,000 other labels change nothing."""
    docs = spark.createDataFrame([(k, None if k == 7 else f"text {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.range(60_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    texts, y = toxicity.training_rows(docs, labels, max_per_class=1500)
    kept = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 and k != 7]
    assert sorted(zip(texts, y, strict=True)) == sorted((f"text {k}", k % 2) for k in kept)
    assert len(toxicity.training_rows(docs, labels, max_per_class=10)[0]) == 20


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        at = toxicity.window_starts(n)
        covered = {i for a in at for i in range(a, a + toxicity.WINDOW)}
        assert set(range(n)) <= covered and (np.diff(at) == toxicity.STRIDE).all()


def test_archives(spark):
    big, small = "<p>é</p>" * 300, "tiny"
    rows = [(i, f"http://x/{i}" if i % 4 else None, [big, small, None, big + str(i)][i % 4], "k") for i in range(60)] + [(None, "u\r\nx", small, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    path = new_path(spark, "warc")
    index = warc.write_archives(warc.mark_revisits(df), path)
    got = warc.read_records(index, path).collect()
    assert len(got) == len(rows)
    keeper = max(i for i, _, h, _ in rows if h == big)
    for r in got:
        html = next(h for i, _, h, _ in rows if i == r.id) or ""
        raw = html.encode()
        assert (r.payload_bytes, r.digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        again = html == big and r.id != keeper
        assert (r.kind, r.refers_to) == (("revisit", keeper) if again else ("response", None))
        assert r.payload == (None if again else raw)
    some = warc.read_records(index.where("id % 7 = 0"), path, False).collect()
    assert sorted(r.id for r in some) == list(range(0, 60, 7))
    assert warc.coalesced([(0, 10), (10, 5), (200_000, 3)]) == [(0, 15, 2), (200_000, 3, 1)]
    empty = spark.createDataFrame([], df.schema)
    assert warc.read_records(warc.write_archives(warc.mark_revisits(empty), new_path(spark, "w")), path).collect() == []


def test_archives_of_string_ids(spark):
    big = "<p>x</p>" * 300
    rows = [("b%0A\r\n", "http://x", big), ("a", None, big), (None, "http://y", big), ("a", "http://z", "s")]
    df = spark.createDataFrame(rows, "k string, `u.v` string, h string")
    path = new_path(spark, "warc")
    index = warc.write_archives(warc.mark_revisits(df, "k", "u.v", "h"), path)
    got = sorted((r.id or "", r.kind, r.refers_to, r.payload and len(r.payload)) for r in warc.read_records(index, path).collect())
    assert got == [("", "revisit", "b%0A\r\n", None), ("a", "response", None, 1), ("a", "revisit", "b%0A\r\n", None), ("b%0A\r\n", "response", None, 2400)]
    import gzip

    for r in index.select("file").distinct().collect():
        with gzip.open(f"{path.removeprefix('file://')}/{r.file}") as file:
            raw = file.read().decode()
        names = [x.split("\r\n")[0] for x in raw.split("WARC-Record-ID: ")[1:]]
        assert raw.startswith("WARC/1.1\r\nWARC-Type: warcinfo") and len(set(names)) == len(names) and "HTTP/1.1 200 OK" in raw


def test_held_out():
    assert zlib.crc32(b"7") % 5 == zlib.crc32(str(7).encode()) % 5
