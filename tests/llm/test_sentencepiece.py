"""Encoding against the library and against all segmentations; exact round trips."""

import os

import numpy as np
import pytest

from millrace.llm import sentencepiece as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no model")
TEXTS = ["", "a", " ", "  two  spaces ", "line\nbreak\r\n\ttab", "été naïve ñandú", "日本語 🙂", "x" * 900, "ab" * 300 + " tail", "The quick brown fox. " * 20, "\x00\x01", "    " * 30 + "x"]


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_equals_library():
    import sentencepiece

    codec, library = sp.Codec(sp.read_model()), sentencepiece.SentencePieceProcessor(model_proto=sp.read_model())
    got = codec.encode(TEXTS)
    assert [ids(g) for g in got] == library.encode(TEXTS)
    assert codec.decode(got) == TEXTS
    assert codec.encode([None]) == [None] and codec.decode([None]) == [None]


def best_score(pieces, word):
    best = [0.0] + [-np.inf] * len(word)
    known = {pieces.texts[i]: float(pieces.scores[i]) for i in pieces.ids.tolist()}
    for end in range(1, len(word) + 1):
        for size in range(1, end + 1):
            part = word[end - size : end]
            score = known.get(part, pieces.unknown if size == 1 else -np.inf)
            best[end] = max(best[end], best[end - size] + score)
    return best[-1]


def test_viterbi_is_best():
    codec = sp.Codec(sp.read_model(), True)
    words = ["▁thereabouts", "▁électricité", "▁xqzj", "abc", "▁▁▁word", "▁" + "na" * 20]
    for word in words:
        alive, nexts = codec.pieces.viterbi(codec.pieces.substrings(sp.points([word], len(word))))
        path = [(i, int(nexts[0, i]) - i) for i in np.flatnonzero(alive[0]).tolist()]
        assert "".join(word[i : i + n] for i, n in path) == word
        table = codec.pieces.substrings(sp.points([word], len(word)))[0]
        score = sum(float(codec.pieces.scores[table[i, n - 1]]) if table[i, n - 1] >= 0 else codec.pieces.unknown for i, n in path)
        assert score == pytest.approx(best_score(codec.pieces, word))
    assert codec.decode(codec.encode(TEXTS)) == TEXTS


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "some text", "c"), (3, "some text", "c")], "doc_id long, text string, ids string")
    out = sp.encode(df).collect()
    assert sorted(len(r.ids) if r.ids is not None else -1 for r in out)[:2] == [-1, 0]
    back = sp.decode(sp.encode(df)).collect()
    assert sorted(str(r.text) for r in back) == sorted(["None", "", "some text", "some text"])
    assert sp.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, tmp_path):
    import hashlib

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=sp.read_model())
    rows = [*enumerate(TEXTS), (50, None), (51, "long " * 30_000), (51, "long " * 30_000), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sp.op2_sentencepiece(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        found = None if t is None else np.array(library.encode(t), "<i4")
        want.append((str(i), None, None, None) if t is None else (str(i), len(found), hashlib.sha256(found.tobytes()).hexdigest(), True))
    assert sorted(want, key=str) == sorted(((str(r.doc_id), r.n_ids, r.ids_sha256, r.round_trip) for r in got), key=str)
    assert all(r.viterbi_round_trip in (None, True) for r in got)
    assert sp.encode(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).collect() == []
