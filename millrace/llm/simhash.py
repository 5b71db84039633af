"""SimHash near-dedup: 64-bit fingerprints, linked at few differing bits with BK-trees.

A BK-tree over all fingerprints would have to sit in one place. Here the trees are shards of it: a fingerprint's 64 bits
are 8 blocks, and two fingerprints with at most r differing bits agree on at least 8 - r whole blocks. Each choice of 8 - r
blocks is a key; a shard holds the distinct fingerprints of one key, at most 2^(8 r) of them however hot a group of copies is.
Every fingerprint goes to its C(8, r) shards, so no link is lost; each shard's tree is searched along the edges within the
radius only, and what it links is given as a forest. The forests meet in label propagation over written tables.

Defined cases: a null, empty or blank text has fingerprint zero, which links like any other. Rows repeated, or sharing a
doc_id, keep a row each. A null doc_id never names a component while another id is there. Empty tables give empty results.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.base import map_texts, positional, slices, table, written
from millrace.llm.mixing import row_mark
from millrace.llm.urlfilter import build_filter, may_hold

BLOCKS, BLOCK_BITS = 8, 8
#: Queries that search a tree together.
AT_ONCE = 2048
#: Bits in which fingerprints of the pipeline's candidates differ at most.
NEAR_BITS = 3
#: The pipeline's candidates beyond these: at a Jaccard coefficient of 0.8, one pair of 1,600 shares no band.
BANDS, BAND_ROWS = 14, 4
#: Texts, about so many, that tell which shingles are common, and so many of these at most: they stand last in the order of a set's shingles.
COMMON_SAMPLE, COMMON_MOST = 4096, 65_536
#: Sets with one shingle, about so many, that are compared in one place; those of a shingle with more are dealt over pairs of parts.
TOGETHER = 512
#: Bits that tell of how many shingles with a hash in each of so many bins a set has, an odd or an even number.
ODD_BITS = 1024
#: Documents whose sets are made anew by a broadcast of their marks at most; of more, all texts are walked again.
FEW = 100_000
SALTS, FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
FACTORS = FACTORS << np.uint64(1) | np.uint64(1)


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of the text's word shingles, repeats included, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.array(list(map(partial(xxhash.xxh64_intdigest, seed=42), parts)), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts, bits = np.zeros(64, dtype=np.int64), hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(bits), 255):  # 255 ones at most fit a byte
        counts += np.add.reduce(np.unpackbits(bits[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """keep, and fp: the fingerprint's bits as a signed long."""

    def compute(texts: list) -> dict:
        return {"fp": pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))}

    return map_texts(df, text, "fp bigint", compute, list(keep))


class BKTree:
    """Children are keyed by their Hamming distance to the parent. Built and searched level by level, all items together."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values, parent, edge = values, np.full(n, -1), np.zeros(n, dtype=np.int64)
        items, node = np.arange(1, n), np.zeros(max(n - 1, 0), dtype=np.int64)
        while len(items):
            d = np.bitwise_count(values[items] ^ values[node]).astype(np.int64)
            _, first, group = np.unique(node * 65 + d, return_index=True, return_inverse=True)
            child = items[first]
            parent[child], edge[child] = node[first], d[first]
            rest = np.ones(len(items), dtype=bool)
            rest[first] = False
            items, node = items[rest], child[group][rest]
        self.kids = np.argsort(parent, kind="stable")[1:] if n else parent  # all but the root, by parent
        self.edge = edge[self.kids]
        self.start = np.searchsorted(parent[self.kids], np.arange(n + 1))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query's index, item's index) at most radius apart, level by level."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            yield q[d <= radius], node[d <= radius]
            many = self.start[node + 1] - self.start[node]
            at = np.repeat(self.start[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            q, d = np.repeat(q, many), np.repeat(d, many)
            near = np.abs(self.edge[at] - d) <= radius
            q, node = q[near], self.kids[at[near]]


def tree_links(values: np.ndarray, radius: int) -> np.ndarray:
    """All pairs of indices of the distinct values that are at most radius apart, the larger index first."""
    tree, links = BKTree(values), []
    for at in range(0, len(values), AT_ONCE):
        for q, node in tree.within(values[at : at + AT_ONCE], radius):
            q = q + at
            links.append(np.stack([q, node])[:, q > node].astype(np.int32))
    return np.concatenate(links, axis=1)


def spanning(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices at most radius apart, fewer than there are values, that hang together what all such pairs do."""
    (a, b), label, chosen = tree_links(values, radius), np.arange(len(values)), [np.zeros((2, 0), np.int32)]
    while len(a):
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        group, first = np.unique(high, return_index=True)  # each group hangs itself under one with a smaller label
        chosen.append(np.stack([a[first], b[first]]))
        label[group] = low[first]
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    a, b = np.concatenate(chosen, axis=1)
    return a, b


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct values the index of the first one of its group of links."""
    (a, b), label = tree_links(values, radius), np.arange(len(values))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def shard_links(distinct: DataFrame, radius: int, direct: bool = False) -> DataFrame:
    """Edges (fp, root) that connect what the shards' trees link; distinct has one row per fp. direct: each edge is itself within the radius."""
    keys = []
    for k, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        mask = sum(0xFF << (BLOCK_BITS * b) for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))))  # a shard of two keys is still searched exactly

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            pairs = starts[ends - starts == 2]  # the root and its only child
            pairs = pairs[np.bitwise_count(fp[pairs].view(np.uint64) ^ fp[pairs + 1].view(np.uint64)) <= radius]
            out_fp, out_root = [fp[pairs + 1]], [fp[pairs]]
            for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                values = fp[a:b]
                if direct:
                    one, other = spanning(values.view(np.uint64), radius)
                    out_fp.append(values[one])
                    out_root.append(values[other])
                    continue
                label = forest(values.view(np.uint64), radius)
                linked = label != np.arange(len(values))
                out_fp.append(values[linked])
                out_root.append(values[label[linked]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_fp)), pa.array(np.concatenate(out_root))], names=["fp", "root"])

        fp = key = np.zeros(0, dtype=np.int64)
        for batch in batches:  # sorted by key; the last key may go on in the next batch
            fp = np.concatenate([fp, batch.column(0).to_numpy(zero_copy_only=False)])
            key = np.concatenate([key, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield links(fp[:cut], key[:cut])
            fp, key = fp[cut:], key[cut:]
        if len(key):
            yield links(fp, key)

    sharded = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sharded = sharded.repartition(F.col("key")).sortWithinPartitions("key", "fp")
    return sharded.mapInArrow(run, "fp bigint, root bigint").distinct()


def components(edges: DataFrame, a: str = "fp", b: str = "root") -> DataFrame:
    """(node, label): the smallest node of each node's connected component. Smallest labels spread, and pointers jump."""
    both = written(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).where("node <> other").distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("least"))
        near = written(labels.join(told, "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("was")), "labels")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(near.join(jump, "label").select("node", F.least("label", "next").alias("label"), "was"), "labels")
        labels = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return labels


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """id_col, fp, component_id: the smallest id that links at radius bits or fewer reach, of the row's own included."""
    marked = written(fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), shingle=shingle), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = components(shard_links(distinct, radius))
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = rooted.groupBy("label").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(least, "label").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted; a text of fewer words is one shingle, a blank one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.array(list(map(xxhash.xxh64_intdigest, parts)), dtype=np.uint64))


def set_name(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key of BAND_ROWS least hashes for each of BANDS bands: two sets share one with probability 1 - (1 - J^BAND_ROWS)^BANDS."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (((found[at : at + 4096, None] ^ SALTS) * FACTORS) ^ (found[at : at + 4096, None] >> np.uint64(31))).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)


def with_before(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """df and before: the node and label of the `most` rows before each one in its group by this order, and, for node's sake, first: the node of the first row seen.

    Groups may be of any size: rows are ranged by group and order, and a window runs within a range, to which the last rows of the range before it are lent.
    """
    ranged = written(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "near-ranged")
    last = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*[F.col(c).desc() for c in (group, *order)]))).where(F.col("_n") <= most).drop("_n")
    nexts = ranged.select("_range").distinct().withColumn("_next", F.lead("_range").over(Window.orderBy("_range")))  # a row a range
    lent = last.join(F.broadcast(nexts.where("_next IS NOT NULL")), "_range").withColumn("_range", F.col("_next")).drop("_next").withColumn("_lent", F.lit(True))
    w = Window.partitionBy(group, "_range").orderBy(*order)
    seen = ranged.withColumn("_lent", F.lit(False)).unionByName(lent)
    before = [F.lag(F.struct("node", "label"), k).over(w) for k in range(1, most + 1)]
    return seen.select("*", F.array_compact(F.array(*before)).alias("before"), F.first("node").over(w).alias("first")).where("NOT _lent")


def banded(sketches: DataFrame) -> DataFrame:
    return sketches.dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))


def candidates_by_fingerprint(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of names of sets whose SimHash fingerprints fp differ in NEAR_BITS bits at most, found by BK-trees over shards of them: each set meets the first one of its
    fingerprint, and these meet along the links of each shard that hang it together."""
    sets = sketches.dropDuplicates(["node"]).select("node", "fp")
    firsts = written(sets.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    same = sets.join(firsts, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = shard_links(firsts, NEAR_BITS, direct=True)
    for side, k in (("fp", "a"), ("root", "b")):
        links = links.join(firsts.select(F.col("fp").alias(side), F.col("first").alias(k)), side)
    return same.unionByName(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).where("a <> b").distinct()


def candidates(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of names of sets that share a band: each set meets the first of its range of the band, and the one before it."""
    met = with_before(banded(sketches).withColumn("label", F.col("node")), "band", ["node"], 1)
    pairs = met.select(F.col("node").alias("b"), F.explode(F.concat(F.array("first"), F.transform("before", lambda x: x["node"]))).alias("a"))
    return pairs.where("a <> b").select("a", "b").distinct()


def common_shingles(plain: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, COMMON_MOST at most, sorted, and in how many. They make an order of shingles; any order gives the same groups."""
    n = plain.count()
    some = map_texts(plain.sample(min(1.0, COMMON_SAMPLE / max(n, 1)), seed=1), "text", "shingles array<bigint>", lambda texts: {"shingles": [shingle_set(t, shingle).view(np.int64) for t in texts]}, [])
    counted = some.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(COMMON_MOST)
    found = counted.toArrow()
    keys, many = found.column("s").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], many[order]


def rare_first(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set, rare ones before common ones: of two sets whose Jaccard coefficient is at least `least`, each one's first n - ceil(least n) + 1 have one in common."""
    if not len(found):
        return found
    keys, many = common
    rank = np.zeros(len(found), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        rank = np.where(keys[at] == found, many[at], 0)
    return found[np.lexsort((found, rank))][: len(found) - math.ceil(least * len(found) - 1e-9) + 1]


def odd_bins(found: np.ndarray) -> bytes:
    """A bit a bin of hashes: whether the set has an odd number there. Two sets differ in at least as many shingles as bits."""
    bins = np.bincount((found >> np.uint64(64 - ODD_BITS.bit_length() + 1)).astype(np.int64), minlength=ODD_BITS)
    return np.packbits((bins & 1).astype(bool)).tobytes()


def candidates_between(sketches: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs (a, b) without a common label (node, label) that may be alike: they share one of their first shingles, and neither their sizes nor their odd bins say that they differ in more than they may.

    No pair over the coefficient is left out. Sets of one label aren't compared, so a group of copies that hangs together makes no pairs; the sets of a very common shingle are dealt over pairs of their parts.
    """
    sets = written(sketches.dropDuplicates(["node"]).select("node", "size", "slack", "odd", "rare"), "near-sets-rare")
    w = Window.partitionBy("shingle")
    met = sets.select("node", F.explode("rare").alias("shingle")).withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1")
    known = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.withColumns({"low": F.min("label").over(w), "high": F.max("label").over(w)}).where("low <> high").drop("low", "high")
    parts = F.ceil(F.col("n") / F.lit(TOGETHER)).cast("long")
    dealt = mixed.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.join(sets.select("node", "size", "slack", "odd"), "node").select("shingle", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "label", "size", "slack", "odd")

    def pairs_of(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        low, high, part, node, label, size, slack = (rows.column(k).to_numpy() for k in range(1, 8))
        odd = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint64).reshape(len(rows), -1)
        i, step, out = np.arange(len(rows)), 0, []
        while len(i):  # each row with the one `step` after it in its group
            step += 1
            i = i[i + step < len(rows)]
            i = i[group[i] == group[i + step]]
            j = i + step
            fits = (label[i] != label[j]) & ((low[i] == high[i]) | (part[i] != part[j])) & (np.abs(size[i] - size[j]) <= slack[i] + slack[j])
            x, y = i[fits], j[fits]
            fits = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64) <= slack[x] + slack[y]
            out.append(np.stack([node[x[fits]], node[y[fits]]]))
        found = np.unique(np.sort(np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:  # sorted by group; the last one may go on in the next batch
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            if not len(rows):
                continue
            new = np.zeros(len(rows), np.int64)
            for k in range(3):
                c = rows.column(k).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield pairs_of(rows.slice(0, cut), group[:cut])
            rest = rows.slice(cut)
        if rest is not None and len(rest):
            yield pairs_of(rest, np.zeros(len(rest), np.int64))

    keys = ["shingle", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def held_sets(df: DataFrame, pairs: DataFrame, text: str, shingle: int) -> DataFrame:
    """node and hashes: the sets of these pairs."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-wanted")
    filter_ = build_filter(wanted)

    def sets(texts: list) -> dict:
        found = [shingle_set(t, shingle) for t in texts]
        nodes = np.array([set_name(f) for f in found], np.uint64)
        keys = np.array([xxhash.xxh64_intdigest(n.tobytes(), seed=42) for n in nodes], np.uint64)  # Spark's xxhash64 of the node
        some = may_hold(filter_, keys)  # asked here, so that a task needs one Python worker, not two
        return {"node": pa.array(nodes.view(np.int64)), "hashes": [f.tobytes() if s else None for f, s in zip(found, some, strict=True)]}

    held = map_texts(df, text, "node bigint, hashes binary", sets, []).where("hashes IS NOT NULL").dropDuplicates(["node"])
    return written(held.join(wanted, F.col("node") == F.col("key"), "left_semi"), "near-sets")


def similar_pairs(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard coefficient is at least `least`."""
    one, two = (held.select(F.col("node").alias(k), F.col("hashes").alias(f"of_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            good = []
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared >= least * (len(x) + len(y) - shared))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def near_groups(plain: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, mark and group of the rows (doc_id, text, mark): a group is linked by pairs whose sets of `shingle`-word shingles have a Jaccard coefficient of
    at least `least`, checked exactly.

    First pairs whose SimHash fingerprints of these shingles lie within NEAR_BITS bits, by the BK-trees, and pairs that share a band of least hashes are checked: they hang most groups together.
    Pairs at 0.8 differ in about 10 of the 64 bits, and some share no band: so in a second round all pairs of sets in different groups are found that share one of their first shingles, without which no
    two sets reach the coefficient. The groups are those of comparing all pairs.
    """
    common = common_shingles(plain, shingle)

    def compute(texts: list) -> dict:
        found = [shingle_set(t, shingle) for t in texts]
        longs = lambda hashes: pa.array(np.array(hashes, np.uint64).view(np.int64))
        return {
            "node": longs([set_name(f) for f in found]), "fp": longs([majority(f) for f in found]), "bands": [band_keys(f).view(np.int64) for f in found],
            "size": [len(f) for f in found], "slack": [len(f) * (1 - least) / (1 + least) + 1e-6 for f in found], "odd": [odd_bins(f) for f in found], "rare": [rare_first(f, common, least).view(np.int64) for f in found],
        }

    sketches = written(map_texts(plain, "text", "node bigint, fp bigint, bands array<bigint>, size bigint, slack double, odd binary, rare array<bigint>", compute, ["doc_id", "mark"]), "near-sketches")
    pairs = written(candidates_by_fingerprint(sketches).unionByName(candidates(sketches).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "near-candidates")
    links = written(similar_pairs(pairs, held_sets(plain, pairs, "text", shingle), least), "near-links")
    labels = components(links, "a", "b")
    more = written(candidates_between(sketches, labels), "near-candidates")
    if not more.isEmpty():
        wanted = written(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sketches.groupBy("node").agg(F.min("mark").alias("mark")), "node").select("mark").distinct(), "near-marks")
        texts = plain.join(F.broadcast(wanted), "mark", "left_semi") if wanted.count() <= FEW else plain
        links = links.unionByName(similar_pairs(more, held_sets(texts, more, "text", shingle), least))
        labels = components(links, "a", "b")
    return sketches.select("doc_id", "mark", "node").join(labels, "node", "left").select("doc_id", "mark", F.coalesce("label", "node").alias("group"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """df's rows that stand for their group of near_groups: one row, with the group's smallest id.

    Of rows that share the id the one with the least hash of all its columns stays, whatever their order; a group whose ids are all null keeps one row likewise.
    """
    flat = positional(df)
    id_, text_ = (f"c{df.columns.index(c)}" for c in (id_col, text))
    plain = flat.select(F.col(id_).alias("doc_id"), F.col(text_).alias("text"), row_mark(flat).alias("mark"))
    grouped = near_groups(plain, shingle, least).groupBy("group")
    best = grouped.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("b")).select(F.col("b.doc_id").alias("id"), F.col("b.mark").alias("mark"))
    chosen = flat.withColumn("m", row_mark(flat)).join(best, F.col(id_).eqNullSafe(F.col("id")) & (F.col("m") == F.col("mark")), "left_semi")
    return chosen.dropDuplicates([id_, "m"]).drop("m").toDF(*df.columns)
