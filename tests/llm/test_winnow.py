"""Line dedup against brute force, and its defined cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import winnow


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)).capitalize() + "."


def passage(rng, n):
    return " ".join(sentence(rng, rng.randint(3, 9)) for _ in range(n))


def run(spark, rows, schema="doc_id long, text string, text2 string"):
    out = winnow.dedup_lines(spark.createDataFrame(rows, schema))
    return {r.doc_id: r for r in out.collect()}


def test_shared_passages_stay_once(spark):
    rng = random.Random(4)
    shared = passage(rng, 12)
    rows = [(i, f"{passage(rng, 8)} {shared} {passage(rng, 5)}\n{passage(rng, 3)}", "x") for i in range(12)] + [(100 + i, passage(rng, 20), "y") for i in range(10)]
    got = run(spark, rows)
    assert got[0].text == rows[0][1]
    inner = ". ".join(shared.split(". ")[1:-1])
    for i in range(1, 12):
        assert inner not in got[i].text and got[i]._words_removed >= 40
        assert rows[i][1].split("\n")[1] in got[i].text
    for i in range(100, 110):
        assert got[i].text == rows[i - 88][1] and got[i]._words_removed == 0


def test_every_long_repeat_goes(spark):
    rng = random.Random(9)
    pool = [sentence(rng, rng.randint(2, 12)) for _ in range(60)]
    rows = []
    for i in range(60):
        at = rng.randrange(50)
        rows.append((i, "\n".join([sentence(rng, 6), *pool[at : at + rng.randint(1, 8)], sentence(rng, 7)]), None))
    got = run(spark, rows)
    seen = set()
    for i, text, _ in rows:
        _, _, hashes, words = winnow.units(text.encode())
        n, covered = len(hashes), set()
        grams = []
        for a in range(n):
            b = int(np.searchsorted(np.cumsum(words[a:]), winnow.MIN_WORDS)) + a + 1
            if b <= n:
                key = tuple(hashes[a:b].tolist())
                grams.append(key)
                if key in seen:
                    covered |= set(range(a, b))
        seen |= set(grams)
        assert got[i]._units_removed >= len(covered)


def test_exact_copy_and_repeats_within(spark):
    rng = random.Random(2)
    text = passage(rng, 30)
    got = run(spark, [(5, text, None), (6, text, None), (7, passage(rng, 9) + "\n" + (sentence(rng, 30) + "\n") * 1, None)])
    assert got[5].text == text and got[6].text == ""
    twice = passage(rng, 10)
    own = run(spark, [(1, twice + "\n" + sentence(rng, 4) + "\n" + twice, None)])
    assert own[1]._words_removed >= 23 and twice.split(". ")[0] in own[1].text


def test_defined_cases(spark):
    rows = [(None, None, None), (1, "", "a"), (2, " \n \n", "b"), (2, " \n \n", "b"), (3, "Short line.\nShort line.\nShort line.", None)]
    out = winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, run string"))
    assert out.columns == ["doc_id", "text", "run", "_units_removed", "_words_removed"]
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert winnow.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(1)
    text = passage(rng, 20)
    out = winnow.dedup_lines(spark.createDataFrame([(1, text), (1, text), (1, "other")], "doc_id long, text string")).collect()
    assert sorted(r.text for r in out) == sorted([text, text, "other"])


def test_passages_cut_inside_sentences(spark):
    rng = random.Random(21)
    rows, pool = [], [passage(rng, 30).split() for _ in range(3)] + [sentence(rng, 200).split(), "\n".join(sentence(rng, 7) for _ in range(30)).split(" ")]
    for i in range(80):
        words = rng.choice(pool)
        at = rng.randrange(len(words) - 65)
        rows.append((i, " ".join([*sentence(rng, 40).split()[:-3], *words[at : at + rng.randint(20, 65)], *sentence(rng, 30).split()[4:]]), None))
    got = run(spark, rows)
    seen = set()
    for i, text, _ in rows:
        words, covered = text.split(), set()
        grams = [tuple(words[a : a + winnow.MIN_WORDS]) for a in range(len(words) - winnow.MIN_WORDS + 1)]
        for a, g in enumerate(grams):
            if g in seen:
                covered |= set(range(a, a + winnow.MIN_WORDS))
        seen |= set(grams)
        left = got[i].text.split()
        assert got[i]._words_removed >= len(covered) - (2 * (winnow.WINDOW - 1) if len(covered) >= 50 else 50) and len(left) == len(words) - got[i]._words_removed
        assert left[:37] == words[:37] and left[-26:] == words[-26:]


def test_first_place_of_a_repeated_word_stays(spark):
    got = run(spark, [(1, "same " * 60 + "end", None), (2, "other start " + "same " * 60, None)])
    assert got[1].text.split() == ["same"] * 12 + ["end"] and got[2].text.split()[:2] == ["other", "start"]


def is_subsequence(part, whole):
    rest = iter(whole)
    return all(any(x == y for y in rest) for x in part)


def coverable(docs):
    """For each text the words that stand in a run of RUN_WORDS words, or a short whole line, that stands earlier too."""
    runs, lines, out = set(), set(), []
    for text in docs:
        words, flags, at = text.split(), [False] * len(text.split()), 0
        for line in text.split("\n"):
            own = line.split()
            if winnow.MIN_LINE <= len(own) < winnow.RUN_WORDS:
                if tuple(own) in lines:
                    flags[at : at + len(own)] = [True] * len(own)
                lines.add(tuple(own))
            at += len(own)
        for a in range(len(words) - winnow.RUN_WORDS + 1):
            key = tuple(words[a : a + winnow.RUN_WORDS])
            if key in runs:
                flags[a : a + winnow.RUN_WORDS] = [True] * winnow.RUN_WORDS
            runs.add(key)
        out.append(flags)
    return out


def test_only_what_repeats_goes(spark):
    """Both ways: nothing is deleted that doesn't stand earlier, and no long run or whole line of what does is left."""
    rng = random.Random(33)
    pool = [sentence(rng, rng.randint(2, 30)) for _ in range(40)]
    texts = []
    for _ in range(70):
        parts = [rng.choice(pool) if rng.random() < 0.35 else sentence(rng, rng.randint(3, 14)) for _ in range(rng.randint(1, 14))]
        texts.append("".join(p + rng.choice([" ", "\n", "\n", "\r\n", "\n  "]) for p in parts))
    got = run(spark, [(i, t, None) for i, t in enumerate(texts)])
    for i, (text, flags) in enumerate(zip(texts, coverable(texts), strict=True)):
        words, left = text.split(), got[i].text.split()
        assert is_subsequence(left, words) and len(words) - len(left) == got[i]._words_removed
        assert is_subsequence([w for w, f in zip(words, flags, strict=True) if not f], left)
        seen = {line.strip() for t in texts[:i] for line in t.split("\n")}
        for line in text.split("\n"):
            if len(line.split()) >= winnow.MIN_LINE and line.strip() in seen:
                assert line.strip() not in {x.strip() for x in got[i].text.split("\n")}


def test_lines_whatever_their_white_space(spark):
    rng = random.Random(5)
    line = sentence(rng, 14)
    rows = [(1, f"{sentence(rng, 6)}\n{line}\n{sentence(rng, 4)}"), (2, f"    {line}\n{sentence(rng, 9)}"), (3, f"{line}\r\n{sentence(rng, 9)}\r\n"), (4, f"{sentence(rng, 9)}\n\t{line.replace(' ', '  ')}"), (5, sentence(rng, 20))]
    got = {r.doc_id: r._words_removed for r in winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 14, 3: 14, 4: 14, 5: 0}


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(6)
    text, others = passage(rng, 12), [passage(rng, 6) for _ in range(30)]
    rows = [(7, text)] * 40 + [(8, text)] + [(None, t) for t in others] + [(None, others[0])] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS `_id`", "text AS `a.b`", "'x' AS _m", "'y' AS _spans", "1 AS _words_removed")
    out = winnow.dedup_lines(df, "_id", "a.b")
    assert out.columns == ["_id", "a.b", "_m", "_spans", "_words_removed", "_units_removed", "_words_removed_"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) and all(r[2:5] == ("x", "y", 1) for r in got)
    assert [r[1] for r in got if r[0] == 7] == [text] * 40 and [r[1] for r in got if r[0] == 8] == [""]
    assert sorted(r[1] for r in got if r[0] is None) == sorted(t for d, t in rows if d is None)


def test_a_chain_of_copies_past_the_ends_of_lines(spark):
    rng = random.Random(7)
    lines = [sentence(rng, 3) for _ in range(13)]
    got = run(spark, [(1, "\n".join(lines), None), (2, "\n".join([sentence(rng, 5), *lines, sentence(rng, 5)]), None)])
    assert got[2]._words_removed == 39


def test_runs_dealt_over_tasks_meet_the_same_first_place(spark):
    rows = [(None if i % 7 == 0 else i % 50, i, i % 3, 256 * i + 12) for i in range(600)] + [(5, 1, 99, 12)]
    runs = spark.createDataFrame(rows, "doc_id long, mark long, run long, place long")

    def found(hot):
        return sorted(map(str, winnow.first_places(runs, hot).select("doc_id", "mark", "place", "f_id", "f_mark", "f_place").collect()))

    plain = found([])
    assert len(plain) == 597 and found([1]) == plain and found([0, 1, 2, 99, 12345]) == plain


def test_one_python_worker_a_task(spark, capsys):
    """The scan for runs asks the filter of repeated texts itself: a second Python step in the same task would hold a worker of its own."""
    rows = [(k, f"{k} " + "word " * 40) for k in range(30)] + [(100 + k, "copy " * 40) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.xxhash64("text"))
    repeated, firsts, copies = winnow.documents(df)
    alone = winnow.run_rows(df, 12, 12, 5, repeated)
    alone.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    ids = {r.doc_id for r in alone.select("doc_id").distinct().collect()} | {r.doc_id for r in firsts.collect()}
    assert ids == {*range(30), 100} and {r.doc_id for r in copies.collect()} == {101, 102}
