"""Byte-level BPE against tiktoken, exact round trips, defined cases."""

import base64
import random

import numpy as np
import pytest

from millrace.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["", " ", "a", "Hello  world, it's 2024!\n\n\tnext", "été naïve ñandú  ", "日本語のテキスト 🙂🙂", "x" * 3000, "ab" * 5000 + " tail", "\x00\x01\x1c\x1d\x85​ ", "don't'll 'S ½ ² Ⅷ", " \n \r\n  z", "﻿mark"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def random_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "abcdefghij ABC  \n\t.,!'012éßñ漢字🙂ЖΩ½ ́"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 400))) for _ in range(n)]


def ids_of(vocabulary, text):
    return [i for w in vocabulary.words(text) for i in vocabulary.merged(w.encode())]


def test_equals_library(vocabulary, library):
    for text in TEXTS + random_texts(300):
        assert ids_of(vocabulary, text) == library.encode_ordinary(text)


def test_every_code_point_is_split_alike(vocabulary, library):
    """Letters, digits and blanks of the pattern are those of the library, alone and between letters."""
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    wrong = [c for c in points if ids_of(vocabulary, f"a{c} {c}1 {c}") != library.encode_ordinary(f"a{c} {c}1 {c}")]
    assert wrong == []


def test_long_words_merge_like_short_ones(vocabulary):
    rng = random.Random(5)
    for n in (2, 3, 50, 200):
        word = bytes(rng.choice(b"etaoin shrdlu") for _ in range(n))
        if word not in vocabulary.ranks:
            assert vocabulary._merged_long(word) == vocabulary.merged(word)


def test_packed_numbers():
    for values in ([0], [127, 128, 0, 1 << 14, (1 << 21) - 1, 1 << 28, 1 << 40], []):
        data, ends = bpe.packed(np.array(values, np.int64))
        assert bpe.unpacked(data)[0].tolist() == values and len(ends) == len(values)


@pytest.mark.parametrize("block_words", [1, 40, 2_000_000])
def test_tables(spark, vocabulary, library, block_words):
    texts = [None, *TEXTS, *random_texts(60), "the same text", "the same text", None]
    rows = [(k if k % 9 else None, {"k": k}, t, "clash", "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, `a.b` map<string,int>, text string, word string, ids string").drop("ids")
    encoded = bpe.encode(df, vocabulary, keep=("doc_id", "a.b", "word"), block_words=block_words)
    assert encoded.columns == ["doc_id", "a.b", "word", "ids"]
    found = {r["a.b"]["k"]: r.ids for r in encoded.collect()}
    assert found == {k: None if t is None else library.encode_ordinary(t) for k, t in enumerate(texts)}
    back = {r["a.b"]["k"]: r["bytes"] for r in bpe.decode(encoded, vocabulary, keep=("a.b",)).collect()}
    assert {k: None if b is None else bytes(b).decode() for k, b in back.items()} == dict(enumerate(texts))


def test_empty_and_strange(spark, vocabulary):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, vocabulary), vocabulary).collect() == []
    only_null = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.ids) for r in bpe.encode(only_null, vocabulary).collect()) == [(1, None), (2, [])]
    bad = spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="lacks"):
        bpe.decode(bad, vocabulary).collect()


def test_other_vocabulary(spark):
    """Another file and pattern: bytes and two merges."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abab"]
    small = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)), r"\S+|\s+")
    df = spark.createDataFrame([(1, "ababab c")], "doc_id long, text string")
    assert bpe.encode(df, small).first().ids == [257, 256, 32, 99]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_equals_library(spark, library):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(texts.pop(r.doc_id).encode()))
    assert not texts
