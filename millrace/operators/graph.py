"""Graphs as edge tables. Undirected edges are made symmetric once; then every step is an equi-join.

Edges that are walked again and again are stored once, bucketed by their start: a round moves what the nodes say, never the edges. Loops end by data, not by a guess, and
cut their lineage with tables in the folder that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.paging import numbered, seeded
from millrace.shared import bucketed, new_folder

#: Nodes of a block: a cell of edges has their numbers at either end.
BLOCK_NODES = 1 << 17


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, with its lineage cut: a table in the shared folder. A checkpoint would keep the constraints of the plan it cuts, which grow with every round of a loop, and know no sizes."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def symmetric(edges: DataFrame, a: str = "a", b: str = "b", keep: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, ...): every edge both ways; self edges go."""
    there = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *keep)
    return there.union(edges.select(F.col(b), F.col(a), *keep)).where("src <> dst")


def neighbourhood(edges: DataFrame, start, depth: int, limit: int | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, depth) within `depth` steps of the start, which has depth 0; limited by (depth, node)."""
    both = bucketed(symmetric(edges, a, b).distinct(), "src")
    seen = cut(both.select(F.col("src").alias("node")).where(F.col("node") == F.lit(start)).limit(1).select("node", F.lit(0).alias("depth")))
    frontier = seen.select("node")
    for d in range(1, depth + 1):
        step = both.join(frontier, both["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        new = cut(step.select("node", F.lit(d).alias("depth")))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new.select("node")
    out = seen.orderBy("depth", "node")
    return out.limit(limit) if limit else out


def shortest_path(edges: DataFrame, start, goal, max_depth: int = 6, a: str = "a", b: str = "b", keep: tuple[str, ...] = ()) -> DataFrame:
    """(step, src, dst, ...) along a shortest path; of several the one whose parents are smallest. Empty if there is none, or start is goal."""
    both = symmetric(edges, a, b, keep)
    links = bucketed(both.groupBy("src", "dst").agg(*[F.min(k).alias(k) for k in keep]) if keep else both.distinct(), "src")
    spark = edges.sparkSession
    kind = dict(links.dtypes)["src"]
    parents = cut(links.limit(0).select(F.col("dst").alias("node"), F.col("src").alias("parent")))
    frontier = spark.createDataFrame([(start,)], f"node {kind}")
    found = False
    if start != goal:
        for _ in range(max_depth):
            step = links.join(frontier, links["src"] == frontier["node"], "left_semi").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
            new = cut(step.where(F.col("node") != F.lit(start)).join(parents, "node", "left_anti"))
            if new.isEmpty():
                break
            parents, frontier = parents.unionByName(new), new.select("node")
            if not new.where(F.col("node") == F.lit(goal)).isEmpty():
                found = True
                break
    hops: list[tuple] = []
    node = goal
    while found and node != start:  # one lookup a hop, max_depth at most
        parent = parents.where(F.col("node") == F.lit(node)).first()["parent"]
        hops.append((parent, node))
        node = parent
    rows = [(i + 1, x, y) for i, (x, y) in enumerate(reversed(hops))]
    path = spark.createDataFrame(rows, f"step int, src {kind}, dst {kind}")
    return path.join(links, ["src", "dst"], "left").select("step", "src", "dst", *keep).orderBy("step")


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return symmetric(edges, a, b).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def pagerank_round(links: DataFrame, known: DataFrame, ranks: DataFrame, damping: float, total: int, idle: float) -> DataFrame:
    """Every node's rank after it was dealt along the links once. links and known are bucketed by src and node."""
    sent = ranks.where("n > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("n")).alias("share"))
    got = links.join(sent, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
    return known.join(got, "node", "left").withColumn("rank", F.lit((1 - damping) / total) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(idle / total))).drop("got")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, a: str = "a", b: str = "b", nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank): undirected and unweighted; parallel edges count once, and nodes without edges deal their rank to all."""
    links = bucketed(symmetric(edges, a, b).distinct(), "src")
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    all_nodes = (nodes.select("node") if nodes is not None else links.select(F.col("src").alias("node"))).distinct()
    known = bucketed(all_nodes.join(out, all_nodes["node"] == out["src"], "left").select("node", F.coalesce("n", F.lit(0)).alias("n")), "node")
    total = known.count()
    if total == 0:
        return known.select("node", F.lit(0.0).alias("rank"))
    ranks, has_idle = known.withColumn("rank", F.lit(1.0 / total)), not known.where("n = 0").isEmpty()
    for k in range(rounds):
        idle = ranks.where("n = 0").agg(F.sum("rank")).first()[0] if has_idle else 0.0
        ranks = pagerank_round(links, known, ranks, damping, total, idle)
        if has_idle or k % 5 == 4:
            ranks = cut(ranks)
    return ranks.select("node", "rank")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached. Labels spread and pointers jump, so rounds grow with the logarithm of the diameter."""
    links = bucketed(symmetric(edges, a, b).distinct(), "src")
    labels = cut(links.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")))
    while True:
        told = links.join(labels.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("told"))
        near = labels.join(told, "node").select("node", F.least("component", "told").alias("c"), F.col("component").alias("was"))
        near = cut(near)
        jump = near.select(F.col("node").alias("c"), F.col("c").alias("next"))
        after = cut(near.join(jump, "c").select("node", F.least("c", "next").alias("component"), "was"))
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels


def communities(edges: DataFrame, rounds: int = 5, over: int = 20, a: str = "a", b: str = "b", weight: str | None = None) -> DataFrame:
    """(node, community): components, and within those of more than `over` nodes synchronous label propagation by weight; ties take the smallest label."""
    strength = F.col(weight).cast("double") if weight else F.lit(1.0)
    links = symmetric(edges.select(a, b, strength.alias("w")), a, b, ("w",)).groupBy("src", "dst").agg(F.max("w").alias("w"))
    links = bucketed(links, "src")
    whole = connected_components(edges, a, b)
    sizes = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sized = cut(whole.join(sizes, "component"))
    labels = sized.where(F.col("n") > over).select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        heard = links.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node"), "label").agg(F.sum("w").alias("w"))
        best = heard.groupBy("node").agg(F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).alias("label"))
        labels = cut(best)
    named = labels.join(sized, "node").select("node", "component", "label")
    rest = sized.where(F.col("n") <= over).select("node", "component", F.col("component").alias("label"))
    grouped = named.unionByName(rest)
    least = grouped.groupBy("component", "label").agg(F.min("node").alias("community"))
    return grouped.join(least, ["component", "label"]).select("node", "community")


def spread(cells: DataFrame, sent: DataFrame, blocks: int, width: int) -> DataFrame:
    """(n, vs): for every node next to a sender (n, v: `width` doubles) the sums of what its neighbours of each block send. cells: (cell, src, dst), bucketed by cell; only the senders move, once a block."""

    def add(edges: pa.Table, senders: pa.Table) -> pa.Table:
        place = np.full(BLOCK_NODES, -1)
        place[senders.column("n").to_numpy() % BLOCK_NODES] = np.arange(len(senders))
        at = place[edges.column("src").to_numpy() % BLOCK_NODES]
        to, known = edges.column("dst").to_numpy()[at >= 0], np.frombuffer(b"".join(senders.column("v").to_pylist()), np.float64).reshape(-1, width)
        at = at[at >= 0]
        near, local = np.unique(to, return_inverse=True)
        sums = np.stack([np.bincount(local, weights=known[at, k], minlength=len(near)) for k in range(width)], axis=1) if len(near) else np.zeros((0, width))
        return pa.table({"n": pa.array(near, pa.int64()), "v": pa.array([x.tobytes() for x in sums], pa.binary())})

    by_cell = sent.select("n", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_to")).select((F.expr(f"n div {BLOCK_NODES}") * blocks + F.col("_to")).alias("cell"), "n", "v")
    return cells.groupBy("cell").cogroup(by_cell.groupBy("cell")).applyInArrow(add, "n bigint, v binary").groupBy("n").agg(F.collect_list("v").alias("vs"))


def betweenness(edges: DataFrame, sources: int = 200, seed: int = 1, a: str = "a", b: str = "b") -> DataFrame:
    """(node, betweenness): shortest paths from the sources that a seeded hash picks, over the largest value, 1 at least.

    All sources walk together: a node has a row with its depth, paths and flow for each of them. Nodes are numbered, edges lie in cells of two blocks of numbers, and a level is a product of each cell
    with what its senders say; the way back passes each node's share to the level before.
    """
    links = symmetric(edges, a, b).distinct()
    names = cut(numbered(links.select(F.col("src").alias("node")).distinct(), ["node"], "n").select("node", (F.col("n") - 1).cast("long").alias("n")))
    picked = [r["n"] for r in names.orderBy(*seeded(seed, "node")).limit(sources).select("n").collect()]  # one a source
    width, blocks = len(picked), names.agg(F.max("n")).first()[0]
    blocks = 0 if blocks is None else blocks // BLOCK_NODES + 1
    if not width:
        return names.select("node", F.lit(0.0).alias("betweenness"))
    ends = links.join(names.select(F.col("node").alias("src"), F.col("n").alias("_s")), "src").join(names.select(F.col("node").alias("dst"), F.col("n").alias("_d")), "dst")
    cells = bucketed(ends.select((F.expr(f"_s div {BLOCK_NODES}") * blocks + F.expr(f"_d div {BLOCK_NODES}")).alias("cell"), F.col("_s").alias("src"), F.col("_d").alias("dst")), "cell")
    schema = "n bigint, depth binary, paths binary, flow binary, v binary"

    def rows(ns, depth: np.ndarray, paths: np.ndarray, flow: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        packed = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (depth, paths, flow)]
        return pa.RecordBatch.from_arrays([ns, *packed, pa.array([x.tobytes() if any_ else None for x, any_ in zip(v, v.any(axis=1), strict=True)], pa.binary())], names=["n", "depth", "paths", "flow", "v"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()[:, None] == np.array(picked)[None, :]
            yield rows(batch.column(0), np.where(own, 0, -1).astype(np.int16), own.astype(np.float64), np.zeros(own.shape), own.astype(np.float64))

    def after(level: int, back: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                depth, paths, flow = (np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(-1, width).copy() for k, kind in ((1, np.int16), (2, np.float64), (3, np.float64)))
                sums = np.stack([np.sum([np.frombuffer(v, np.float64) for v in vs], axis=0) if vs else np.zeros(width) for vs in batch.column(4).to_pylist()])
                if back:
                    hit = depth == level
                    flow[hit] = (paths * sums)[hit]
                    v = np.divide(1 + flow, paths, out=np.zeros_like(flow), where=hit)
                else:
                    hit = (depth < 0) & (sums > 0)
                    depth[hit], paths[hit] = level, sums[hit]
                    v = np.where(hit, paths, 0.0)
                yield rows(batch.column(0), depth, paths, flow, v)

        return run

    def step(state: DataFrame, level: int, back: bool) -> DataFrame:
        got = spread(cells, state.where("v IS NOT NULL").select("n", "v"), blocks, width)
        return cut(state.drop("v").join(got, "n", "left").mapInArrow(after(level, back), schema))

    state, level = cut(names.select("n").mapInArrow(begin, schema)), 0
    while not state.where("v IS NOT NULL").isEmpty():
        level += 1
        state = step(state, level, False)
    last = level - 1  # the deepest level that any source reaches; its nodes pass no flow on, and say 1 over their paths
    got = state.drop("v").withColumn("vs", F.array().cast("array<binary>"))
    for level in range(last, 0, -1):
        state = cut(got.mapInArrow(after(level, True), schema)) if level == last else step(state, level, True)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, flow = (np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(-1, width) for k, kind in ((1, np.int16), (2, np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(depth > 0, flow, 0.0).sum(axis=1))], names=["n", "b"])

    sums = cut(names.join(state.select("n", "depth", "flow").mapInArrow(total, "n bigint, b double"), "n").select("node", "b"))
    most = sums.agg(F.greatest(F.max("b"), F.lit(1.0)).alias("most"))
    return sums.join(F.broadcast(most)).select("node", (F.col("b") / F.col("most")).alias("betweenness"))  # one row


def compute_all(nodes: DataFrame, edges: DataFrame, weight: str, rounds: int = 20, sources: int = 200, a: str = "a", b: str = "b") -> DataFrame:
    """(node, degree, weight, rank, betweenness, community) of all nodes (node); nodes without edges have degree 0, and the rest null."""
    own = symmetric(edges, a, b, (weight,)).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum(weight).alias("weight"))
    ranked = pagerank(edges, rounds, a=a, b=b)
    out = nodes.select("node").distinct().join(own, "node", "left").fillna(0, ["degree", "weight"])
    for part in (ranked, betweenness(edges, sources, a=a, b=b), communities(edges, a=a, b=b, weight=weight)):
        out = out.join(part, "node", "left")
    return out


def top_subgraph(nodes: DataFrame, edges: DataFrame, size: int, least: float, by: str = "mentions", a: str = "a", b: str = "b", strength: str = "strength", most: int = 500) -> DataFrame:
    """The strongest edges among the `size` nodes with the most mentions; both ends must be inside before edges are counted."""
    chosen = nodes.orderBy(F.col(by).desc_nulls_last(), "node").limit(size).select("node")
    inside = edges.where(F.col(strength) >= least).join(chosen, edges[a] == chosen["node"], "left_semi")
    inside = inside.join(chosen, inside[b] == chosen["node"], "left_semi")
    return inside.orderBy(F.col(strength).desc(), a, b).limit(most)


def strongest(edges: DataFrame, node, k: int = 10, a: str = "a", b: str = "b", strength: str = "strength") -> DataFrame:
    """A node's k strongest edges, whichever end it is."""
    return symmetric(edges, a, b, (strength,)).where(F.col("src") == F.lit(node)).orderBy(F.col(strength).desc(), "dst").limit(k)


def tree(rows: DataFrame, root, id_col: str, parent: str, depth: int = 20, condition=None) -> DataFrame:
    """(id_col, depth, path) under a root; children must meet the condition, and a cycle ends where it meets its own path."""
    children = rows if condition is None else rows.where(condition)
    level = cut(rows.where(F.col(id_col) == F.lit(root)).select(F.col(id_col), F.lit(0).alias("depth"), F.array(id_col).alias("path")))
    found = level
    for d in range(1, depth + 1):
        up = level.select(F.col(id_col).alias("_p"), F.col("path").alias("_path"))
        new = children.join(up, F.col(parent) == F.col("_p")).where(~F.array_contains("_path", F.col(id_col)))
        level = cut(new.select(id_col, F.lit(d).alias("depth"), F.concat("_path", F.array(id_col)).alias("path")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def strongest_of_all(edges: DataFrame, k: int, a: str = "a", b: str = "b", strength: str = "strength") -> DataFrame:
    """(node, rank, other, strength): of every node its k strongest edges."""
    w = Window.partitionBy("src").orderBy(F.desc(strength), "dst")
    ranked = symmetric(edges, a, b, (strength,)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("src").alias("node"), "rank", F.col("dst").alias("other"), strength)


def sorted_communities(found: DataFrame) -> DataFrame:
    """Communities numbered from 0 by their smallest node."""
    number = numbered(found.select("community").distinct(), ["community"], "_n").select("community", (F.col("_n") - 1).alias("number"))
    return found.join(number, "community").select("node", "number")
