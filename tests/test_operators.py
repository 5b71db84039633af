"""Graphs, resolution, chunks, cascades and sources against brute force and invariants."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import ann, cascade, chunker, extract, graph, ledger, paging, resolve, views
from millrace.sources import html, loadfiles

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7), (7, 7), (1, 2)]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "a long, b long")


def test_walks(spark):
    e = edges(spark)
    assert [(r.node, r.depth) for r in graph.neighbourhood(e, 1, 2).collect()] == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert [(r.src, r.dst) for r in graph.shortest_path(e, 1, 5).collect()] == [(1, 3), (3, 4), (4, 5)]
    assert graph.shortest_path(e, 1, 1).collect() == [] and graph.shortest_path(e, 1, 6).collect() == [] and graph.shortest_path(e, 1, 5, 2).collect() == []


def test_ranks_and_groups(spark):
    e = edges(spark)
    ranks = {r.node: r["rank"] for r in graph.pagerank(e).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks[3] == max(ranks.values())
    assert {r.node: r.component for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}
    between = {r.node: r.betweenness for r in graph.betweenness(e).collect()}
    assert between[3] == 1.0 and between[1] == 0 and 0 < between[4] < 1
    rng = random.Random(1)
    two = [(a, b) for base in (0, 50) for a in range(base, base + 15) for b in range(base, a) if rng.random() < 0.8] + [(0, 50)]
    found = {r.node: r.community for r in graph.communities(edges(spark, two)).collect()}
    assert len(set(found.values())) >= 1 and set(found) == {n for p in two for n in p}


def test_walks_store_their_edges_once(spark, monkeypatch):
    """The levels of a neighbourhood and of a path read edges that lie by their start: they are stored once a walk."""
    stored, store = [], graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda df, key: stored.append(key) or store(df, key))
    edges = spark.createDataFrame([(k, k + 1, k) for k in range(6)], "a long, b long, n long")
    assert {(r.node, r.depth) for r in graph.neighbourhood(edges, 0, 4).collect()} == {(k, k) for k in range(5)} and stored == ["src"]
    assert [tuple(r) for r in graph.shortest_path(edges, 0, 4, keep=("n",)).collect()] == [(k + 1, k, k + 1, k) for k in range(4)] and stored == ["src", "src"]


def test_a_cut_keeps_no_constraints(spark):
    """What a loop filters by doesn't add up from round to round."""
    df = spark.range(10).where("id > 3 AND NOT array_contains(array(1, 2), id)")
    plan = graph.cut(df)._jdf.queryExecution().optimizedPlan()
    assert plan.constraints().isEmpty() and graph.cut(df).count() == 6


def test_tree_of_many_levels(spark):
    """A full binary tree of fifteen levels: each of them in the time of the one before."""
    rows = spark.range(1, 1 << 15).selectExpr("id", "nullif(id div 2, 0) AS parent", "id % 7 >= 0 AS ok")
    got = graph.tree(rows, 1, "id", "parent", 20, F.col("ok")).groupBy("depth").count().collect()
    assert {(r.depth, r["count"]) for r in got} == {(k, 1 << k) for k in range(15)}


def test_tree_stops_at_cycles(spark):
    rows = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1)], "id long, parent long")
    assert {(r.id, r.depth) for r in graph.tree(rows, 1, "id", "parent").collect()} == {(1, 0), (2, 1), (4, 1), (3, 2)}


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(3)
    names = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(2))) for i in range(60)]
    names += [(100 + i, n + rng.choice(["", "a", " b"])) for i, n in names[:20]]
    grams = lambda s: {p[k : k + 3] for w in s.split() for p in [f"  {w} "] for k in range(len(p) - 2)}
    want = {(a, b) for a, x in names for b, y in names if a < b and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) > 0.6}
    df = spark.createDataFrame(names, "id long, name string")
    first = {r.id: r.first for r in resolve.name_classes(df, "id", "name").collect()}
    members = {f: {i for i, x in first.items() if x == f} for f in first.values()}
    linked = [(members[r.a], members[r.b]) for r in resolve.similar_names(df, "id", "name", None, 0.6, None).collect()]
    got = {tuple(sorted((a, b))) for xs, ys in [*linked, *((m, m) for m in members.values())] for a in xs for b in ys if a != b}
    assert got == want and any(len(m) > 1 for m in members.values())
    groups = {r.node: r.keep for r in resolve.merge_groups(df, "id", "name", None, 0.6001).collect()}
    assert all(groups[a] == groups[b] for a, b in want) and set(groups) == {x for pair in want for x in pair}


def test_ten_thousand_equal_names(spark):
    df = spark.range(10_000).selectExpr("id", "'the very same name' AS name").unionByName(spark.createDataFrame([(-1, "the very same nam"), (-2, "other")], "id long, name string"))
    assert [(r.a, r.b) for r in resolve.similar_names(df, "id", "name", None, 0.7, None).collect()] == [(-1, 0)]
    assert {r.keep for r in resolve.merge_groups(df, "id", "name", None, 0.7).collect()} == {-1}


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "Anna met ANNA example; annabel left. Anna, anna, anna"), (2, "short"), (3, "nobody at all here")], "id long, text string")
    names = spark.createDataFrame([(7, "Anna", 0.7), (7, "Anna Example", 0.9), (8, "Bo", 0.9)], "e long, name string, confidence double")
    got = resolve.find_mentions(texts, "id", "text", names, "e", "name").collect()
    assert [(r.id, r.e if "e" in r else r.entity, r.n, r.confidence) for r in got] == [(1, 7, 4, 0.9)]


def test_merge(spark):
    entities = spark.createDataFrame([(1, "A", ["x"], 2, 1.0), (2, "B", ["y"], 3, 2.0), (3, "C", [], 1, 0.5)], "id long, name string, aliases array<string>, mention_count long, risk double")
    mentions = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "entity long, document long")
    links = spark.createDataFrame([(1, 2, "k", 0.9), (1, 3, "k", 0.2), (2, 3, "k", 0.7)], "a long, b long, kind string, strength double")
    groups = spark.createDataFrame([(1, 1), (2, 1)], "node long, keep long")
    e, m, l, log = resolve.merge_entities(entities, mentions, links, groups)
    assert {(r.id, r.name, tuple(r.aliases), r.mention_count, r.risk) for r in e.collect()} == {(1, "A", ("B", "x", "y"), 5, 2.0), (3, "C", (), 1, 0.5)}
    assert {tuple(r) for r in m.select("entity", "document").collect()} == {(1, 10), (1, 11)}
    assert [tuple(r) for r in l.collect()] == [(1, 3, "k", 0.7)] and [(r.kept, r.merged) for r in log.collect()] == [(1, 2)]


def test_pairs_of_a_group_by_matrices(spark, monkeypatch):
    """Blocks of three, groups of any size, a vector of zeros, none, and one with a gap: all pairs, and none is scored by a function of arrays."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(9)
    rows = [(i, i % 3 if i % 4 else None, None if i % 5 == 0 else i % 12, rng.standard_normal(4).tolist(), "unsolved" if i % 2 else "confirmed") for i in range(60)]
    rows[7], rows[8], rows[9] = (7, *rows[7][1:3], [0.0] * 4, "unsolved"), (8, *rows[8][1:3], None, "confirmed"), (9, *rows[9][1:3], [1.0, None, 2.0, 3.0], "unsolved")
    items = spark.createDataFrame(rows, "id long, kind int, length int, vector array<double>, status string")
    found = cascade.close_pairs(items, 0.3)
    cos = lambda x, y: round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
    fits = lambda a, b: (a[2] is None or (b[2] is not None and abs(a[2] - b[2]) <= 3)) and (a[1] is None or a[1] == b[1]) and (a[1] is not None or a[2] is not None)
    whole = [r for r in rows if r[0] not in (7, 8, 9)]
    want = {(a[0], b[0]): cos(a[3], b[3]) for a in whole for b in whole if a[0] != b[0] and b[4] == "unsolved" and fits(a, b)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len({r[:2] for r in got}) and {(a, b): s for a, b, s in got} == {k: s for k, s in want.items() if s >= 0.3}
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_cascade_and_back(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, "name" if i % 2 else None, None if i % 5 == 0 else i % 9, (base + 0.2 * rng.standard_normal(8)).tolist(), "unsolved", None, 0, None) for i in range(30)]
    items = spark.createDataFrame(rows, "id long, kind string, length int, vector array<double>, status string, source long, depth int, text string")
    got = {(r.source, r.target) for r in cascade.close_pairs(items, 0.9).collect()}
    cos = lambda x, y: round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6)
    fits = lambda a, b: (a[2] is None or (b[2] is not None and abs(a[2] - b[2]) <= 3)) and (a[1] is None or a[1] == b[1])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and fits(a, b) and not (a[1] is None and a[2] is None) and cos(a[3], b[3]) >= 0.9}
    assert got == want and want
    done = spark.createDataFrame([(1, "found")], "id long, text string")
    after = graph.cut(cascade.propagate(items, done, cascade.reached(items, done, 0.9)))
    proposed = after.where("status = 'proposed'")
    assert {r.id for r in proposed.collect()} == {b for a, b in want if a == 1} and {r.text for r in proposed.collect()} == {"found"}
    none = spark.createDataFrame([], "proposal string, id long, text string, status string, kind string, sources array<string>")
    back, _ = cascade.revert(after, none, cascade.trees(after, done.select("id")))
    assert {(r.status, r.source, r.depth, r.text) for r in back.collect()} == {("unsolved", None, 0, None)}


def test_confirmed_then_reverted_is_the_start(spark):
    """Both tables: the winner goes on, similar items get one proposal that cites it; taken back, only the winner's own mark differs."""
    rows = [(i, "name", 5, [1.0, 0.1 * i], "disputed" if i == 9 else "unsolved", None, 0, None) for i in range(10)]
    items = spark.createDataFrame(rows, "id long, kind string, length int, vector array<double>, status string, source long, depth int, text string")
    votes = lambda p, i, text, c, b, kind="manual", status="pending", sources=None: (p, i, text, status, kind, c, 5, 0, b, sources, None)
    given = [votes("a", 0, "Ann", 0.9, 4), votes("b", 0, "Bob", 0.8, 4), votes("c", 0, "Cy", 0.2, 4), votes("d", 9, "Dee", 0.9, 4), votes("e", 1, "Ann", None, 0, "cascade", sources=["77"])]
    proposals = spark.createDataFrame(given, "proposal string, id long, text string, status string, kind string, confidence double, up long, down long, backing long, sources array<string>, match double")
    after, judged = (graph.cut(x) for x in cascade.confirm_and_propagate(items, proposals, 0.95))
    status = {r.proposal: (r.status, r.outcome) for r in judged.collect()}
    assert status["a"] == ("accepted", "confirmed") and status["b"] == ("superseded", "confirmed") and status["c"] == ("superseded", "confidence_too_low")
    assert status["d"] == ("pending", "item_already_resolved")
    new = {r.id: r.sources for r in judged.where("kind = 'cascade' AND proposal <> 'e'").collect()}
    proposed = {r.id for r in after.where("status = 'proposed'").collect()}
    assert proposed == {1, 2, 3} and set(new) == proposed - {1} and set(map(tuple, new.values())) == {("0",)}  # item 1 has that proposal already
    back, left = cascade.revert(after, judged, cascade.trees(after, spark.createDataFrame([(0,)], "id long")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, items.collect()))
    assert {r.proposal: r.status for r in left.collect()} == {"a": "rejected", "b": "pending", "c": "pending", "d": "pending", "e": "pending"}


def test_edges_stay_where_they_are(spark):
    """In a round of PageRank, components or labels only what nodes say is shuffled."""
    from millrace.shared import bucketed

    edges = spark.range(200).selectExpr("id % 20 AS a", "id * 7 % 31 AS b")
    links = bucketed(graph.symmetric(edges).distinct(), "src")
    known = bucketed(links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.pagerank_round(links, known, known.withColumn("rank", F.lit(0.1)), 0.85, 31, 0.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .#\n-", max_size=400), max_size=12))
def test_chunks_hold_all_text(parts):
    text = "\n\n".join(parts)
    chunks = chunker.chunk_text(text)
    body = "".join(s["body"] for s in chunker.sections(text))
    joined = "".join(c["content"] for c in chunks)
    for ch in "ab":
        assert joined.count(ch) >= body.count(ch)
    assert all(0 < c["char_count"] <= chunker.Sizes().most for c in chunks) and [c["chunk_index"] for c in chunks] == list(range(len(chunks)))


def test_sections():
    got = chunker.chunk_text("intro\n# A\none\n--- Page 3 ---\n### B\ntwo\n## C\nthree")
    assert [(c["section_title"], c["page_number"], c["hierarchy_path"]) for c in got] == [("Document Start", 1, ["Document Start"]), ("A", 1, ["A"]), ("B", 3, ["A", "B"]), ("C", 3, ["A", "C"])]


def test_transcripts_and_riders(spark):
    rows = [("r", i * 10.0, i * 10.0 + 9, "x" * 400) for i in range(5)] + [("e", 0.0, 1.0, "")]
    got = extract.pack_segments(spark.createDataFrame(rows, "k string, s double, e double, t string"), "k", "s", "e", "t").where("k = 'r'").orderBy("chunk").collect()
    assert [(r.start, r.end, len(r.text)) for r in got] == [(0.0, 20.0, 801), (20.0, 40.0, 801), (40.0, 49.0, 400)]
    text = "".join(f"RIDER (Grand Jury Subpoena to T{i}, dated May {i}, 2001)\n1. Item number {i}\n18 U.S.C. § 371\n" for i in (1, 2, 3))
    found = extract.riders(spark.createDataFrame([(1, text, 3), (2, "none", 1)], "id long, t string, pages int"), "id", "t", "pages").orderBy("first_page").collect()
    assert [(r.target, r.items, r.statutes) for r in found] == [(f"T{i}", [f"Item number {i}"], ["18 U.S.C. § 371"]) for i in (1, 2, 3)]
    assert found[0].first_page == 1 and found[-1].last_page == 3


def test_files(spark, tmp_path):
    (tmp_path / "v.opt").write_text('B1,V,IMAGES\\p\\a.pdf,,,,2\nB2,V,"x,y",Y,,,3\nB3,V,z,,,,\nbad,line\nB4,V,z,Y,,,1\n')
    rows = loadfiles.opt_rows(loadfiles.numbered_lines(spark, str(tmp_path / "v.opt")))
    assert [(r.bates, r.path, r.starts, r.pages) for r in rows.orderBy("line_no").collect()] == [("B1", "IMAGES/p/a.pdf", False, 2), ("B2", "x,y", True, 3), ("B3", "z", False, 1), ("B4", "z", True, 1)]
    assert [(r["first"], r["last"], r.pages) for r in loadfiles.opt_documents(rows).orderBy("doc_no").collect()] == [("B1", "B1", 1), ("B2", "B3", 2), ("B4", "B4", 1)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"abc")
    assert [(r.size, r.sha256[:8]) for r in loadfiles.manifest(spark, str(tmp_path / "a")).collect()] == [(3, "ba7816bf")]
    import sqlite3

    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("CREATE TABLE persons (id, full_name)")
        db.execute("CREATE TABLE other (name)")
        db.executemany("INSERT INTO persons VALUES (?, ?)", [(1, "Anna"), (2, "Bo")])
    assert {(r.table, r.name) for r in loadfiles.sqlite_names(spark, str(tmp_path / "d.db")).collect()} == {("persons", "Anna"), ("persons", "Bo")}
    page = 'x self.__next_f.push([1,"a\\n\\"b"]) self.__next_f.push([1,"\\x"])'
    assert html.payload_text(spark.createDataFrame([(1, page)], "id long, h string"), "id", "h").first().payload == 'a\\n\\"b\\x'
    assert [len(r.c) for r in spark.createDataFrame([("<i>1<i>2",)], "p string").select(html.cards("p", "<i>").alias("c")).collect()] == [2]
    bad = spark.createDataFrame([(1, "AMZ- without an id"), (2, None), (3, ""), (4, "email " + "x" * 200)], "k long, chunk string")
    assert all(html.records(bad, "k", kind).collect() == [] for kind in html.FORMATS)


def test_lines_of_split_files(spark, tmp_path):
    """Files of many splits have the numbers of one task's read, blank lines and both line ends counted; documents go on over splits."""
    rng, want = random.Random(8), {}
    for name in ("b.opt", "a.opt"):
        lines = ["" if rng.random() < 0.05 else f"B{k:05d},VOL1,IMG\\{'x' * rng.randrange(60)}.tif,{'Y' if rng.random() < 0.1 else ''},,,{k % 3}" for k in range(4000)]
        (tmp_path / name).write_text("".join(x + rng.choice(["\n", "\r\n"]) for x in lines), newline="")
        want[name] = lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = loadfiles.numbered_lines(spark, str(tmp_path / "*.opt"))
        assert read.rdd.getNumPartitions() > 10
        got = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in read.collect()}
        both = {r.line_no: r.line for r in loadfiles.numbered_lines(spark, str(tmp_path / "*.opt"), across=True).collect()}
        documents = {(r.file.rsplit("/", 1)[1], r.doc_no): (r.first, r.last, r.pages) for r in loadfiles.opt_documents(loadfiles.opt_rows(read)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(name, k): line for name, lines in want.items() for k, line in enumerate(lines) if line}
    assert both == {k: line for k, line in enumerate(want["a.opt"] + want["b.opt"]) if line}
    plain = {}
    for name, lines in want.items():
        n = 0
        for line in filter(None, lines):
            n += line.split(",")[3] == "Y"
            plain.setdefault((name, n), []).append(line.split(",")[0])
    assert documents == {k: (v[0], v[-1], len(v)) for k, v in plain.items()}


def test_overwrite_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for _ in range(2):
        ledger.overwrite_partitions(df, str(tmp_path / "t"), "k")
    ledger.overwrite_partitions(df.where("k = 1").withColumn("v", F.lit("c")), str(tmp_path / "t"), "k")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "c"), (2, "b")}


def test_index_of_cells(spark):
    """Recall of the approximate search, and the exact one against brute force; a vector that many rows share is one in the index."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 16))[rng.integers(0, 30, 1500)] + 0.6 * rng.standard_normal((1500, 16))
    x[200:500] = x[200]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, v array<double>")
    centres = ann.fit(df, "v", 36)
    index, ids = ann.build(df, "id", "v", centres)
    assert index.count() == 1201 and ids.count() == 1500
    asked = df.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("vector"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    distinct = [i for i in range(1500) if i <= 200 or i >= 500]
    want = {q: sorted(distinct, key=lambda i, q=q: (-round(float(u[i] @ u[q]), 6), i))[:10] for q in range(0, 1500, 50)}

    def found(exact):
        out = {}
        for r in ann.search(index, centres, asked, 10, 8, exact).orderBy("q", F.desc("similarity"), "key").collect():
            out.setdefault(r.q, []).append(r.key)
        return out

    assert found(True) == want
    codes = ann.Codes.fit(u[:800])
    index = ann.build(df, "id", "v", centres, codes)[0]
    for by in (None, codes):
        near = {}
        for r in ann.search(index, centres, asked, 10, 8, False, by).collect():
            near.setdefault(r.q, set()).add(r.key)
        assert np.mean([len(near[q] & set(want[q])) / 10 for q in want]) >= 0.9


def test_matrices_of_the_index_are_bounded(monkeypatch):
    """Cells, codes and comparisons go by pieces, with the same outcome whatever their size."""
    x = ann.unit(np.random.default_rng(9).standard_normal((700, 10)))
    whole = ann.Cells.fit(x, 30)
    want, code = whole.assign(x), ann.Codes.fit(x).encode(x)
    monkeypatch.setattr(ann, "MATRIX", 500)
    assert max(p.stop - p.start for p in ann.pieces(700, 30)) == 16
    got = ann.Cells.fit(x, 30)
    assert np.allclose(got.centres, whole.centres) and (got.assign(x)[0] == want[0]).all() and (ann.Codes.fit(x).encode(x) == code).all()
    assert ann.Codes.fit(x).scores(x[:5], code).shape == (5, 700)


def test_probes_reach_the_recall_asked_for():
    """Vectors without clusters: cells chosen within a sample hold as many of the whole's nearest, by brute force."""
    x = ann.unit(np.random.default_rng(6).standard_normal((3000, 24)))
    cells = ann.Cells.fit(x[:1000], 40)
    probes = ann.probes_for(x[:1000], cells, 10)
    asked, own = x[::50], cells.assign(x)[0]
    near = np.argsort(-(asked @ x.T), axis=1)[:, :10]
    looked = np.argsort(-(asked @ cells.centres.T), axis=1)[:, :probes]
    assert np.mean([np.isin(own[n], c).mean() for n, c in zip(near, looked, strict=True)]) >= 0.93
    assert 1 < probes < len(cells.centres) and ann.probes_for(x[:0], cells, 10) == 1


def test_betweenness_over_cells_of_edges(spark, monkeypatch):
    """Nodes in many small blocks and two components: the same as in one block, and what moves a level is a row a node and block, not one an edge and source."""
    rng = random.Random(6)
    e = spark.createDataFrame([(x, y) for x in range(60) for y in rng.sample(range(60), 3) if x // 40 == y // 40], "a long, b long")
    whole = {r.node: round(r.betweenness, 9) for r in graph.betweenness(e, sources=7).collect()}
    moved, spread = [], graph.spread
    monkeypatch.setattr(graph, "BLOCK_NODES", 16)
    monkeypatch.setattr(graph, "spread", lambda cells, sent, blocks, width: moved.append((sent.count(), blocks)) or spread(cells, sent, blocks, width))
    assert {r.node: round(r.betweenness, 9) for r in graph.betweenness(e, sources=7).collect()} == whole and max(whole.values()) > 0
    assert all(n <= 60 and blocks == 4 for n, blocks in moved)


def test_betweenness_equals_brute_force(spark):
    rng = random.Random(4)
    rows = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)})
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        depth, level = {s: 0}, [s]
        while level:
            level = sorted({w for v in level for w in near[v]} - set(depth))
            depth |= dict.fromkeys(level, max(depth.values()) + 1)
        paths = {s: [[s]]}
        for v in sorted(depth, key=depth.get):
            if v != s:
                paths[v] = [p + [v] for w in near[v] if depth[w] == depth[v] - 1 for p in paths[w]]
        for t, every in paths.items():
            for p in every:
                for v in p[1:-1]:
                    total[v] += 1 / len(every)
    most = max(1.0, *total.values())
    got = {r.node: r.betweenness for r in graph.betweenness(edges(spark, rows)).collect()}
    assert got == pytest.approx({v: b / most for v, b in total.items()})


def test_numbers_of_rows(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    got = paging.numbered(df, ["k"], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 1001)) and all(r.n == r.k + 1 for r in got)
    a, b = spark.createDataFrame([(3,), (1,)], "k long"), spark.createDataFrame([(9,), (7,), (8,)], "k long")
    assert sorted((r.i, r.a_k, r.b_k) for r in resolve.by_position(a, b, "k").collect()) == [(1, 1, 7), (2, 3, 8), (3, None, 9)]


def test_views(spark):
    folder = views.new_folder(spark)
    live = lambda: spark.range(3)
    assert views.saved(spark, f"{folder}/v", live).count() == 3
    for n in (5, 6):
        views.refresh(spark.range(n), f"{folder}/v")
    assert views.saved(spark, f"{folder}/v", live).count() == 6 and len(views.versions(spark, f"{folder}/v")) == 2


def test_bounded_marks_and_votes(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "true") for i in range(10)], "id long, flag string")
    left = []
    for _ in range(4):
        rows = spark.createDataFrame(ledger.mark(rows, F.col("id") > 1, "flag", "id", 3).collect(), rows.schema)
        left.append(rows.where("flag IS NULL AND id > 1").count())
    assert left == [2, 0, 0, 0]
    log = spark.createDataFrame([(1, "up"), (1, "down"), (2, "up")], "i long, k string")
    assert {tuple(r) for r in ledger.tally(log, "i", "k", {"u": "up", "d": "down"}).collect()} == {(1, 1, 1), (2, 1, 0)}
    with pytest.raises(Exception, match="unknown vote"):
        ledger.tally(log, "i", "k", {"u": "up"}).collect()


def brute_chunks(body, sizes):
    """Paragraphs, or sentences of long ones, one after the other: a piece goes to the open chunk if there is room."""
    if len(body) <= sizes.most:
        return [body]
    room, pieces = sizes.most - sizes.overlap - 2, []
    for paragraph in [p.strip() for p in body.split("\n\n")]:
        if len(paragraph) <= room:
            pieces.append(("\n\n", paragraph))
            continue
        parts, held = [], ""
        for sentence in paragraph.replace("! ", "!\0").replace("? ", "?\0").replace(". ", ".\0").split("\0"):
            for part in [sentence[k : k + room] for k in range(0, len(sentence), room)]:
                if held and len(held) + 1 + len(part) > room:
                    parts.append(held)
                    held = ""
                held = held + " " + part if held else part
        pieces += [("\n\n", p) for p in [*parts, held]]
    chunks = []
    for gap, p in pieces:
        if chunks and len(chunks[-1]) + len(gap) + len(p) <= room:
            chunks[-1] += gap + p
        else:
            chunks.append(p)
    if len(chunks) > 1 and len(chunks[-1]) < sizes.least and len(chunks[-2]) + 2 + len(chunks[-1]) <= sizes.most:
        chunks[-2:] = [chunks[-2] + "\n\n" + chunks[-1]]
    return chunks[:1] + [f"{a[-sizes.overlap:].strip()}\n\n{b}" for a, b in zip(chunks, chunks[1:], strict=False)]


def test_chunks_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9)))
    paragraph = lambda: " ".join(" ".join(word() for _ in range(rng.randint(3, 40))) + rng.choice(".!?") for _ in range(rng.randint(1, 25)))
    texts = ["\n\n".join(paragraph() for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["x" * 5000, "short", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunker.chunk_documents(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for i, t in enumerate(texts):
        assert got.get(i, []) == (brute_chunks(t, chunker.Sizes()) if t else [])


def test_rollup_by_batches(spark, tmp_path):
    """A stream's batches, one of them run twice, late and folded, equal a full recompute; distinct counts lie within the sketch's error."""
    from millrace.operators.rollup import Rollup

    measures = {"n": ("count", "1"), "total": ("sum", "v"), "last": ("max", "v"), "users": ("distinct", "u")}
    parts = [spark.range(k * 5000, (k + 1) * 5000).selectExpr("id % 3 AS k", "id AS v", "id * 7 % 4000 AS u") for k in range(3)]
    view = Rollup.create(spark, ("k",), measures)
    with pytest.raises(ValueError):
        view.read()
    view.add(parts[2], 2)
    view.add(parts[1], 0)
    view.add(parts[0], 0)
    view.add(parts[1], 1)
    full = {r.k: r for r in parts[0].union(parts[1]).union(parts[2]).groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("last"), F.count_distinct("u").alias("users")).collect()}
    for fold in (None, 1, 2):
        if fold is not None:
            view.fold(fold)
        for r in view.read().collect():
            want = full[r.k]
            assert (r.n, r.total, r.last) == (want.n, want.total, want.last) and abs(r.users - want.users) <= 0.04 * want.users


def test_names_by_stored_trigrams(spark):
    from millrace.functions.text import similarity
    from millrace.operators.postings import NameIndex

    rng = random.Random(12)
    words = ["anna", "annabel", "bell", "anne", "smith", "smyth", "jones", "joan"]
    rows = [(i, " ".join(rng.sample(words, 2)), [rng.choice(words)] if i % 3 else None) for i in range(80)] + [(100, "", []), (101, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, aliases array<string>")
    index = NameIndex.create(df, "id", "name", "aliases", buckets=8)
    for q in ("anna smith", "joan", "zzz", ""):
        alike = df.select("id", F.round(F.coalesce(similarity("name", F.lit(q)), F.lit(0.0)), 6).alias("s"))
        by_alias = df.select("id", F.explode("aliases").alias("a")).select("id", F.round(similarity("a", F.lit(q)), 6).alias("x")).groupBy("id").agg(F.max("x").alias("x"))
        want = alike.join(by_alias, "id", "left").where((F.col("s") > 0.3) | (F.coalesce("x", F.lit(0.0)) > 0.3)).orderBy(F.desc("s"), "id").limit(20)
        assert [(r.id, r.similarity) for r in index.nearest(q).collect()] == [(r.id, r.s) for r in want.collect()]


def test_folders_and_footers(spark, tmp_path):
    for name in ("a.pdf", "sub/b.PNG", "sub/deep/c.mov", "sub/none"):
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(b"x" * 7)
    found = {(r.path.rsplit("/", 1)[1], r.size, r.extension) for r in loadfiles.walk(spark, str(tmp_path / "f")).collect()}
    assert found == {("a.pdf", 7, "pdf"), ("b.PNG", 7, "png"), ("c.mov", 7, "mov"), ("none", 7, None)}
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    counted = loadfiles.from_footers(spark, str(tmp_path / "t")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    assert "PushedAggregation: [COUNT(*), MAX(id)]" in counted._jdf.queryExecution().toString()
    assert tuple(counted.first()) == (1000, 999) and spark.conf.get("spark.sql.sources.useV1SourceList") == before
