"""SimHash against brute force, and its defined cases."""

import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from millrace.llm import simhash


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < k else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b c d e", "é É ü\u00a0x y z", "w " * 700])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == brute_fingerprint(text, 3)


def brute_components(fps, radius):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_tree_finds_all_links(radius):
    rng = np.random.default_rng(radius)
    values = np.unique(rng.integers(0, 1 << 12, 150).astype(np.uint64))
    assert simhash.forest(values, radius).tolist() == brute_components(values.tolist(), radius)


def test_groups(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today " * 30
    rows = [(k, base + f"tail{k}" * (k % 2), "x") for k in range(20)] + [(50, None, "x"), (51, "", None), (52, " \n", "y"), (None, base, "z"), (7, base, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(rows)
    fps = [simhash.fingerprint(r[1], 3) for r in rows]
    labels = brute_components(fps, 2)
    want = {}
    for label, r in zip(labels, rows, strict=True):
        want.setdefault(label, []).extend([r[0]] if r[0] is not None else [])
    expected = sorted(((r[0] is None, r[0] or 0), min(want[label])) for label, r in zip(labels, rows, strict=True))
    assert sorted(((g.doc_id is None, g.doc_id or 0), g.component_id) for g in got) == expected


def test_empty_table(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chains_across_shards(spark):
    fps = [0]
    for k in range(40):  # each one bit from the one before: links only along the chain
        fps.append(fps[-1] ^ (1 << k))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    labels = simhash.components(simhash.shard_links(df, 2)).collect()
    assert {r.label for r in labels} == {0} and len(labels) == 41


def test_keep_first(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 20
    df = spark.createDataFrame([(1, base, "a"), (2, base, "b"), (3, "quite another text that is here", "c"), (3, "quite another text that is here", "c")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.source) for r in simhash.keep_first(df).collect()) == [(1, "a"), (3, "c")]


def test_near_copies_at_the_threshold(spark):
    rng = random.Random(31)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, near = [], 0
    for i in range(40):
        base = words(250)
        edited = list(base)
        for at in rng.sample(range(5, 245), 4 if i % 2 else 12):
            edited[at] = "edited"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
        x, y = (simhash.shingle_set(t, 5) for _, t in rows[-2:])
        shared = len(np.intersect1d(x, y))
        near += shared >= 0.8 * (len(x) + len(y) - shared)
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 20 <= near < 40 and set(range(0, 80, 2)) <= got and len(got) == 80 - near


def test_one_row_a_group_whatever_the_ids(spark):
    rows = [(1, "one text of its own"), (1, "another text that stands alone"), (None, "first of no id"), (None, "second without any id"), (None, "first of no id"), (3, ""), (4, None)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text or "" for r in got) == sorted({t or "" for _, t in rows})


def test_a_group_whose_members_are_not_all_alike(spark):
    """Each text is like the next one, the first and the last are not: one row stays."""
    rng = random.Random(41)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        words = words[8:] + ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(8)]
    x, y = (simhash.shingle_set(t, 5) for t in (rows[0][1], rows[-1][1]))
    assert len(np.intersect1d(x, y)) / len(np.union1d(x, y)) < 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS `_id`", "text AS `a.b`", "1 AS node", "2 AS _m")
    got = simhash.keep_first(df, "_id", "a.b")
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(0, rows[0][1], 1, 2)]


def test_which_row_stays_does_not_depend_on_order(spark):
    rows = [(1, "the same text again", s) for s in "xyz"] + [(1, "the same text again", "x"), (2, "alone", "q")]
    schema = "doc_id long, text string, source string"
    kept = {tuple(sorted(tuple(r) for r in simhash.keep_first(spark.createDataFrame(part, schema).repartition(n)).collect())) for part, n in ((rows, 1), (rows[::-1], 3), (rows[2:] + rows[:2], 2))}
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_rows_before_across_ranges(spark):
    """A group in many ranges: every row meets those before it, as in one window."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(7, k, k % 3) for k in range(500)] + [(k, k, 0) for k in range(1000, 1040)], "band long, node long, label long")
        got = {(r.band, r.node): [tuple(x) for x in r.before] for r in simhash.with_before(df.repartition(5), "band", ["node"], 4).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(7, k): [(j, j % 3) for j in range(k - 1, max(-1, k - 5), -1)] for k in range(500)} | {(k, k): [] for k in range(1000, 1040)}


def test_recall_of_planted_pairs(spark):
    """Pairs at 0.8 to 0.9, among them a hot group: hundreds of near copies of one page."""
    rng = random.Random(77)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows, pairs = [], []

    def edited(base, times):
        out = list(base)
        for at in rng.sample(range(5, len(base) - 5), times):
            out[at] = "edit"
        return out

    for i in range(300):
        base = words(160)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(base, rng.choice([1, 2, 3]))))]
        x, y = (simhash.shingle_set(t, 5) for _, t in rows[-2:])
        shared = len(np.intersect1d(x, y))
        if shared >= 0.8 * (len(x) + len(y) - shared):
            pairs.append((2 * i, 2 * i + 1))
    page = words(160)
    rows += [(10_000 + k, " ".join(edited(page, 1))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    group = {r.doc_id: r.group for r in simhash.near_groups(df.withColumn("mark", F.lit(0).cast("long"))).collect()}
    found = sum(group[a] == group[b] for a, b in pairs)
    assert len(pairs) > 200 and found >= len(pairs) - 1
    assert len({group[10_000 + k] for k in range(300)}) == 1


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_spanning_links_are_within_the_radius(radius):
    rng = np.random.default_rng(10 + radius)
    values = np.unique(rng.integers(0, 1 << 12, 150).astype(np.uint64))
    a, b = simhash.spanning(values, radius)
    assert len(a) < len(values) and all(bin(int(values[i]) ^ int(values[j])).count("1") <= radius for i, j in zip(a, b, strict=True))
    label = list(range(len(values)))
    for _ in label:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            label[i] = label[j] = min(label[i], label[j])
    assert label == brute_components(values.tolist(), radius)


def test_near_copies_meet_by_their_fingerprints(spark, monkeypatch):
    """Without any bands, the fingerprints' trees alone bring together the near copies that lie within their reach."""
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows = []
    for i in range(30):
        base = words(600)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:300], "edited", *base[301:]]))]
    fps = [simhash.majority(simhash.shingle_set(t, 5)) for _, t in rows]
    assert all(f == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in simhash.shingle_set(t, 5)) > len(simhash.shingle_set(t, 5))) for f, (_, t) in zip(fps[:4], rows[:4], strict=True))
    near = {i for i in range(30) if bin(fps[2 * i] ^ fps[2 * i + 1]).count("1") <= simhash.NEAR_BITS}
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "candidates", lambda sketches: none)
    monkeypatch.setattr(simhash, "candidates_between", lambda sketches, labels: none)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(0).cast("long"))
    group = {r.doc_id: r.group for r in simhash.near_groups(df).collect()}
    assert len(near) > 20 and {i for i in range(30) if group[2 * i] == group[2 * i + 1]} == near


def joined_by_brute_force(rows, least=0.8):
    """The groups of ids whose sets are linked, by comparing all pairs."""
    sets, label = [simhash.shingle_set(t, 5) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared >= least * (len(sets[i]) + len(sets[j]) - shared) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    groups = {}
    for (k, _), x in zip(rows, label, strict=True):
        groups.setdefault(x, set()).add(k)
    return sorted(map(sorted, groups.values()))


def groups_of(spark, rows):
    groups = {}
    for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.col("doc_id"))).collect():
        groups.setdefault(r.group, set()).add(r.doc_id)
    return sorted(map(sorted, groups.values()))


def test_near_copies_that_share_no_band(spark):
    """Pairs over the threshold whose fingerprints lie apart, and that share none of the bands, are joined all the same."""
    rng = random.Random(19)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows = []
    while len(rows) < 6:
        base = words(60)
        edited = [*base[:20], "edited", *base[21:45], "edited", *base[46:]] if rng.random() < 0.5 else [*base[:-6], *words(6)]
        x, y = (simhash.shingle_set(" ".join(t), 5) for t in (base, edited))
        shared = len(np.intersect1d(x, y))
        apart = bin(simhash.majority(x) ^ simhash.majority(y)).count("1") > simhash.NEAR_BITS
        if shared >= 0.8 * (len(x) + len(y) - shared) and apart and not (simhash.band_keys(x) == simhash.band_keys(y)).any():
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(edited))]
    assert groups_of(spark, rows) == [[0, 1], [2, 3], [4, 5]]


@pytest.mark.parametrize("together", [512, 3])
def test_groups_equal_those_of_all_pairs(spark, monkeypatch, together):
    """Texts that share much and little, with a passage that all have; without bands, so that the second round has all to do."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "candidates", lambda sketches: none)
    rng = random.Random(23)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage, bases, rows = words(30), [words(n) for n in (4, 5, 6, 9, 30, 80, 150)], []
    for k in range(90):
        text = list(passage) + list(rng.choice(bases)) if k % 3 else list(rng.choice(bases))
        for at in rng.sample(range(len(text)), rng.randrange(min(4, len(text)))):
            text[at] = words(1)[0]
        rows.append((k, " ".join(text[rng.randrange(3) :])))
    rows += [(100, ""), (101, " "), (102, "one"), (103, "one two three four five six seven eight nine"), (104, "one two three four five six seven eight nine ten")]
    assert groups_of(spark, rows) == joined_by_brute_force(rows)
