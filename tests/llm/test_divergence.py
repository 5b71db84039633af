"""Distances of sources against dense sums, exact prices, defined cases."""

import random
import re
from collections import Counter

from millrace.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def plain_audit(rows, min_docs, top):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), lang or "", source or "") for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(t for words, *_ in own for t in set(words))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = {s: Counter(t for words, _, source in own if source == s for t in words) for s in {d[2] for d in own}}
        total = sum(counts.values(), Counter())

        def price(c, kept=kept):
            size = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (size + 5 * len(kept)) for t in kept}

        q, p = price(total), {s: price(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)}
    return out


def planted(seed=2):
    rng, rows = random.Random(seed), []
    words = ["Alpha", "beta", "GAMMA", "élan", "Élan", "日本", "x1y", "don't", "_z_", "ΑΒΓ"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    for k in range(400):
        source = rng.choice(["hot", "hot", "s1", "s2", "é", None, ""])
        lang = rng.choice(["en", "fr", None])
        pick = [rng.choice(words[: 10 + 15 * (len(source or "") % 5)]) for _ in range(rng.randrange(0, 30))]
        rows.append((k, rng.choice([" ", "\n", ", "]).join(pick) if k % 17 else None, lang, source, "clash", 1))
    return rows + [(1, "only once", "de", "s1", "", 1), (2, "", "de", "s2", "", 1), (3, "alone", "it", "s9", "", 1)] + [(4, "same same text", "en", "copies", "", 1)] * 40


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def test_equals_dense_sums(spark, monkeypatch):
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(divergence.audit(df, 5, 7)) == plain_audit(rows, 5, 7)
    assert rows_of(divergence.audit(df)) == plain_audit(rows, 30, 50)


def test_pieces_of_texts():
    text = "Größe ABC-def " * 50 + "a" * 300
    whole = [w for words in divergence.terms_of(text) for w in words]
    divergence.PIECE, kept = 64, divergence.PIECE
    try:
        assert [w for words in divergence.terms_of(text) for w in words] == whole and len(list(divergence.terms_of(text))) > 5
    finally:
        divergence.PIECE = kept


def test_prices_are_exact(spark):
    rows = [(n, size, terms) for n in (0, 1, 10**12 + 7, 10**15) for size in (10**15, 3 * 10**15 + 1) for terms in (1, 10**6)] + [(0, 0, 0)]
    df = spark.createDataFrame(rows, "n long, size long, terms long")
    for r in df.withColumn("p", divergence.price("n", "size", "terms")).collect():
        under = r["size"] + 5 * r["terms"]
        assert r.p == (None if under == 0 else 1 + 1_000_000_000 * (r.n + 5) // under)


def test_empty(spark):
    assert rows_of(divergence.audit(spark.createDataFrame([], SCHEMA))) == set()
