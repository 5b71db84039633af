"""Fair queueing: targets, whole documents, determinism, defined cases."""

import pytest

from millrace.llm import mixing


def brute_targets(sizes, weights, budget, most):
    total, capped = sum(sizes) * budget, set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] >= most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def rows(n=400):
    return [(i, "w " * (i * 7919 % 97), None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", "extra") for i in range(n)]


def test_targets_and_takes(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size string")
    got = mixing.mix(df, (3.0, 1.0, 2.0), 1.5).collect()
    assert len(got) == 400
    sources = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in got if r.source == s) for s in sources]
    want = brute_targets(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))], 1.5, 2)
    for s, size, target in zip(sources, sizes, want, strict=True):
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size} and mine[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert sum(r.taken for r in got) <= 1.5 * sum(sizes)
    again = mixing.mix(df.repartition(7), (3.0, 1.0, 2.0), 1.5).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_rows_are_repeated(spark):
    df = spark.createDataFrame(rows(100), "doc_id long, text string, source string, note string")
    times = {r.doc_id: r.times for r in mixing.mix(df, (3.0, 1.0, 2.0), 1.5).collect()}
    out = mixing.mixed_rows(df, (3.0, 1.0, 2.0), 1.5)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in times.items() if v}


def test_equal_rows_have_their_own_fate(spark):
    data = [(None, "w w", "x", i % 2) for i in range(100)] + [(5, "a b c", "y", 0)] * 30 + [(6, None, "y", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n int").withColumnsRenamed({"n": "_copy"})
    mixed = mixing.mix(df, (1.0,), 1.5).collect()
    total = sum(r.taken for r in mixed)
    assert len(mixed) == 131 and 1.5 * 290 - 3 <= total <= 1.5 * 290
    out = mixing.mixed_rows(df, (1.0,), 1.5)
    rows = out.collect()
    assert out.columns == df.columns and sum(len(r.text.split()) for r in rows) == total
    assert sum(r.doc_id is None for r in rows) == sum(r.times for r in mixed if r.doc_id is None)
    assert 50 <= sum(r["_copy"] for r in rows) <= 100  # rows that differ in another column are blocks of their own


@pytest.mark.parametrize("data", [[], [(1, None, None)], [(1, "", "a"), (1, "", "a")], [(None, "a b", "x"), (None, "a b", "x")]])
def test_defined_cases(spark, data):
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), (3.0,), 1.5).collect()
    assert len(got) == len(data) and all(0 <= r.taken <= 2 * r.size for r in got)


def test_native_plan(spark, capsys):
    df = spark.createDataFrame(rows(50), "doc_id long, text string, source string, x string")
    for mixed in (mixing.mix(df), mixing.mixed_rows(df)):
        mixed.explain()
        assert not {"Python", "Arrow", "Pandas"} & set(capsys.readouterr().out.replace("(", " ").split())


def test_blocks_are_taken_by_arithmetic(spark):
    """How many rows of a block are taken is what their places say one by one, and takes no longer for 400 million of them."""
    small = [(size, 30, s, s + 1000, target) for size in (1, 3, 7) for s in (0, 5, 333) for target in (0.0, 17.3, 100.0, 1e4)]
    df = spark.createDataFrame(small, "size long, many long, s0 long, s1 long, target double")
    for cut in (0.0, 0.1, 0.77, 1.0, 3.3, float("inf")):
        for r in df.select("*", *[mixing.taken_places(cut, k).alias(f"t{k}") for k in (0, 1)]).collect():
            for start, taken in ((r.s0, r.t0), (r.s1, r.t1)):
                assert taken == sum(1 for n in range(1, 31) if r.target > 0 and (start + r.size * n) / r.target <= cut)
    hot = spark.createDataFrame([(7, 400_000_000, 10**14, 2 * 10**14, 3.1e14)], "size long, many long, s0 long, s1 long, target double")
    for cut in (0.3225806, 0.3251, 0.6499):
        r = hot.select("*", mixing.taken_places(cut, 0).alias("t0"), mixing.taken_places(cut, 1).alias("t1")).first()
        for start, taken in ((r.s0, r.t0), (r.s1, r.t1)):
            fits = lambda n, start=start: (start + 7 * n) / 3.1e14 <= cut  # noqa: E731, B023
            assert (taken == 0 or fits(taken)) and (taken == r.many or not fits(taken + 1))
