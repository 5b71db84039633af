"""The trie of conversations against a plain one; owners, hot conversations, defined cases."""

import hashlib
import math
import random
import zlib

import pytest

from millrace.llm import trie
from millrace.llm.base import each_place

SCHEMA = "conv_id long, turn long, role string, text string, words string, depth int"


def plain_nodes(rebuilt):
    """{path: measures} by walking every prefix of every conversation."""
    members, out = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda path: len([w for w in path[-1][1].replace("\t", " ").split(" ") if w]) if path else 0
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}

    def below(p):
        return [p, *(x for q in children[p] for x in below(q))]

    for p, ids in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(rebuilt[c]) == len(p)))
        tree = below(p)
        out[min(ids), len(p)] = (
            min(members[p[:-1]]) if p else None, len(ids), len(children[p]), sum(not children[q] for q in tree),
            sum((len(members[q]) - 1) * words(q) for q in tree), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def ordered(rows):
    found = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in found.items()}


def rebuild(convs):
    head = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    base = lambda c: c - int(math.fmod(c, 20))  # noqa: E731  as SQL has it
    return {c: convs.get(base(c), [])[: head[c]] + turns[head[c] :] for c, turns in convs.items()}


def planted(n=150, seed=3):
    rng, out = random.Random(seed), []
    for c in range(n):
        if c % 40 == 20:
            continue  # a block without its first conversation
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            turn = None if t == 0 and c % 7 == 0 else t if c % 5 else t // 2  # null turns, and ties
            out.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no  way", "a\tb c", "", None]) if rng.random() < 0.9 else f"own {c}", "x", 1))
    return out + [(7, 1, "user", "yes", "x", 1)] * 3 + [(None, 1, "user", "lost", "x", 1), (-20, 1, "user", "yes", "x", 1), (-3, 1, None, None, "x", 1)]


def got(nodes, ends):
    rows = nodes.join(trie.end_digests(ends), trie.KEY, "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len({(r.conv_id, r.depth) for r in rows}) == len(rows)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or empty) for r in rows}


def test_equals_plain(spark):
    rows = planted()
    turns = trie.turns_in_order(spark.createDataFrame(rows, SCHEMA))
    assert got(*trie.prefix_trie(trie.rebuilt(turns))) == plain_nodes(rebuild(ordered(rows)))
    assert got(*trie.prefix_trie(trie.paths_of(turns))) == plain_nodes(ordered(rows))


def test_hot_conversation_and_first_turn(spark):
    """A third of all turns in one conversation, most of them equal rows; a first turn that half of the conversations share; ends of many blocks at one node."""
    rows = [(0, 1, "user", "again", "", 0)] * 120 + [(0, t, "user", f"w{t} x", "", 0) for t in range(2, 60)]
    rows += [(c, 0, "user", "hello there", "", 0) for c in range(1, 20_000, 97)] + [(c, 0, "user", f"other {c}", "", 0) for c in range(3, 20_000, 199)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = trie.turns_in_order(spark.createDataFrame(rows, SCHEMA))
        assert got(*trie.prefix_trie(trie.paths_of(turns))) == plain_nodes(ordered(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "user", "hi"), (2, 1, "user", "hi"), (2, 2, None, None)], "conv_id long, turn int, role string, text string")
    found = {(r.conv_id, r.depth): (r.role, r.text, r.n_convs) for r in trie.conversation_trie(df).collect()}
    assert found == {(1, 0): (None, None, 2), (1, 1): ("user", "hi", 2), (2, 2): ("", "", 1)}
    none = spark.createDataFrame([], SCHEMA)
    nodes, ends = trie.prefix_trie(trie.rebuilt(trie.turns_in_order(none)))
    assert got(nodes, ends) == {}


@pytest.mark.parametrize("most", [1, 3, 10])
def test_each_place(spark, most):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 101), ("d", 3)], "id string, many long")
    rows = [(r.id, r.nth) for r in each_place(df, "many", "nth", most).collect()]
    assert sorted(rows) == sorted((i, k) for i, n in (("a", 1), ("b", 7), ("c", 101), ("d", 3)) for k in range(1, n + 1))
