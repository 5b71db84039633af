"""The prefix trie of conversations: which turns many conversations begin with, and what sharing them would save.

A node is a distinct sequence of first turns. Of the conversations that run through it the smallest id owns it; what a conversation owns
is always the end of its path, since below a node of its own no smaller id can stand. Windows mark the owned nodes. With them every measure
of a subtree is a sum over its members alone: the words on a member's path below the node, less those on nodes that it owns itself, add up to the
occurrences beyond the first of each node, and a member that owns a childless last node brings that leaf. So one group-by of prefixes gives all.

A prefix is named by its depth and by sums of 128 bits of hash of each turn and its place; two different ones share a name with a probability of about
2**-128. Sums run along a conversation in two levels, within ranges of (conversation, place) and over the ranges, as one conversation may hold a third of
all turns; likewise the first window runs over a node's members in one range, the second over a row a range. Turns equal in all
columns are counted before anything is sorted.

Defined cases: turns without a conv_id belong to no conversation. Null roles and texts are empty. Turns go by number, null first; those of one number by the md5 of
role and text. Repeated rows are turns of their own. An empty table has no node. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.base import each_place, named, table, written
from millrace.llm.mixing import n_words

KEY = ["depth", "k0", "k1", "k2", "k3"]
#: Ids of 2**ID_BITS neighbouring numbers are joined to one string before a node's ends are hashed.
ID_BITS = 12


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """df and, under the names of sums, their running totals along each key's rows in this order, the row itself included; _range: the row's range."""
    ranged = written(df.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range", key).agg(*[F.sum(f"_{k}").alias(f"t_{k}") for k in sums])
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that the key reaches into
    starts = totals.select("_range", F.col(key).alias("_key"), *[F.sum(f"t_{k}").over(earlier).alias(f"b_{k}") for k in sums])
    starts = F.broadcast(starts.where(F.col(f"b_{next(iter(sums))}").isNotNull()).withColumnRenamed("_range", "_r"))  # only a range's first key began before it: a row a range
    within = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(*df.columns, "_range", *[F.sum(f"_{k}").over(within).alias(f"l_{k}") for k in sums])
    joined = local.join(starts, (F.col("_range") == F.col("_r")) & (F.col(key) == F.col("_key")), "left")
    return joined.select(*df.columns, "_range", *[(F.col(f"l_{k}") + F.coalesce(F.col(f"b_{k}"), F.lit(0))).alias(k) for k in sums])


def turns_in_order(df: DataFrame) -> DataFrame:
    """conv_id, place (from 1), mark (the md5 of role and text), words."""
    role, text = F.coalesce(named("role"), F.lit("")), F.coalesce(named("text"), F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = df.where(named("conv_id").isNotNull()).select(named("conv_id").cast("long").alias("conv_id"), named("turn").alias("turn"), mark.alias("mark"), n_words(text).alias("words"))
    counted = turns.groupBy(*turns.columns).agg(F.count(F.lit(1)).alias("many")).withColumn("given", F.col("turn").isNotNull())
    summed = running(counted, "conv_id", ["given", "turn", "mark"], {"upto": F.col("many")}, "turns")
    return written(each_place(summed, "many", "nth").select("conv_id", (F.col("upto") - F.col("many") + F.col("nth")).alias("place"), "mark", "words"), "places")


def paths_of(turns: DataFrame) -> DataFrame:
    """The conversations as they are: conv_id, depth (from 0, the root), mark, words, size (turns of the conversation)."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    return _with_roots(turns.join(sizes, "conv_id").select("conv_id", F.col("place").alias("depth"), "mark", "words", "size"), sizes)


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """As paths_of(), of conversations rebuilt: the first h turns of conversation c - c % block, then c's own after its first h; h = crc32(c) % most."""
    head = F.crc32(F.col("conv_id").cast("string")) % most
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), "place", "mark", "words")
    there = firsts.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    want = sizes.withColumns({"head": head, "base": F.col("conv_id") - F.col("conv_id") % block}).join(there, "base", "left")
    taken = F.least("head", F.coalesce("there", F.lit(0)))
    want = written(want.select("conv_id", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("size")), "rebuilt")
    lent = want.join(firsts, "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "mark", "words", "size")
    own = turns.where(F.col("place") > head).join(want, "conv_id").select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "mark", "words", "size")
    return _with_roots(lent.unionByName(own), want)


def _with_roots(paths: DataFrame, sizes: DataFrame) -> DataFrame:
    nothing = F.lit(0).cast("long")
    root = sizes.select("conv_id", nothing.alias("depth"), F.lit(None).cast("binary").alias("mark"), nothing.alias("words"), "size")
    return paths.withColumn("depth", F.col("depth").cast("long")).unionByName(root)


def prefix_trie(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, and the name k0 to k3; and the ends: (name, conv_id), a row a conversation.

    paths: conv_id, depth, mark, words, size, with a row at depth 0 for each conversation.
    """
    half = lambda n: F.xxhash64(F.lit(n), "depth", "mark")
    low, high = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF), lambda c: F.shiftrightunsigned(c, 32)
    hashed = paths.withColumns({"x": F.when(F.col("depth") > 0, half(1)).otherwise(0), "y": F.when(F.col("depth") > 0, half(2)).otherwise(0)}).drop("mark")
    parts = {"k0": low("x"), "k1": high("x"), "k2": low("y"), "k3": high("y")}
    rows = written(running(hashed, "conv_id", ["depth"], parts | {"upto": F.col("words")}, "prefixes").withColumn("before", F.col("upto") - F.col("words")), "paths")

    # the smallest member of each node within a range, then over the ranges
    local, whole = Window.partitionBy(*KEY, "_range"), Window.partitionBy(*KEY)
    marked = lambda df, w, longer: df.withColumns({"nth": F.row_number().over(w.orderBy("conv_id")), "longer": F.max(longer).over(w)}).where("nth = 1")
    owned = written(marked(marked(rows, local, F.col("depth") < F.col("size")), whole, F.col("longer")), "owned")

    own = owned.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.min("before").alias("shared"), F.max((F.col("depth") == F.col("size")) & ~F.col("longer")).cast("int").alias("leaf"))
    tops = owned.join(own.select("conv_id", "own_from"), "conv_id").where("depth = own_from and depth > 0")
    above = tops.select(F.col("conv_id").alias("_c"), (F.col("depth") - 1).alias("depth"), *[(F.col(k) - p).alias(k) for k, p in parts.items()])
    smallest = owned.where("depth = 0").agg(F.min("conv_id")).first()[0]  # the root is everyone's: its owner is one number
    deep = above.where("depth > 0").join(owned.select(*KEY, "conv_id"), KEY).select(F.col("_c").alias("conv_id"), F.col("conv_id").alias("above"))
    first = above.where("depth = 0").select(F.col("_c").alias("conv_id"), F.lit(smallest).cast("long").alias("above"))
    ends = rows.where("depth = size")
    facts = ends.select("conv_id", F.col("upto").alias("all_words")).join(own, "conv_id", "left").join(deep.unionByName(first), "conv_id", "left")
    facts = facts.select("conv_id", "own_from", "above", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("shared", "all_words").alias("shared"))

    each = rows.select("conv_id", *KEY, "before", "size").join(facts, "conv_id")
    has_child = (F.col("own_from") <= F.col("depth") + 1) & (F.col("depth") < F.col("size"))
    parent = F.when(F.col("own_from") == F.col("depth"), F.col("above")).when(F.col("own_from") < F.col("depth"), F.col("conv_id"))
    nodes = each.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.coalesce(has_child, F.lit(False)).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    return nodes, ends.select(*KEY, "conv_id")


def end_digests(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256: of the decimal ids that end at a node, ascending, joined by commas.

    Ids are joined to strings by blocks of 4,096 numbers; a node's strings pass in order through one task, which holds one at a time. SHA-256 has no other way.
    """
    blocks = ends.groupBy(*KEY, F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    sorted_ = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block")
    names = [pa.field(k, pa.int64()) for k in KEY] + [pa.field("ends_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), names, strict=True)], schema=pa.schema(names))
            done.clear()
            return out

        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == now:
                    digest.update(b"," + ids.encode())
                else:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
            if done:
                yield flushed()
        if now is not None:
            done.append((*now, digest.hexdigest()))
            yield flushed()

    return sorted_.mapInArrow(run, ", ".join(f"{k} bigint" for k in KEY) + ", ends_sha256 string")


def conversation_trie(df: DataFrame) -> DataFrame:
    """The trie of a table of conversations (conv_id, turn, role, text) as it is: nodes with the role and text of their last turn, null at the root."""
    turns = turns_in_order(df)
    nodes, _ = prefix_trie(paths_of(turns))
    role, text = F.coalesce(named("role"), F.lit("")), F.coalesce(named("text"), F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    texts = df.where(named("conv_id").isNotNull()).select(named("conv_id").cast("long").alias("conv_id"), mark.alias("mark"), role.alias("role"), text.alias("text")).dropDuplicates(["conv_id", "mark"])
    last = nodes.join(turns.select("conv_id", F.col("place").alias("depth"), "mark"), ["conv_id", "depth"], "left")
    return last.join(texts, ["conv_id", "mark"], "left").drop("mark", *KEY[1:])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie(rebuilt(turns_in_order(table(spark, sf_dir, "conversations"))))
    joined = nodes.join(end_digests(ends), KEY, "left")
    counts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return joined.select(*counts, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


OP11_SQL = r"""
WITH RECURSIVE
bits(k, n, v) AS (
  SELECT 0, n, n::UBIGINT FROM range(256) r(n)
  UNION ALL SELECT k + 1, n, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
bytes AS (SELECT n, v FROM bits WHERE k = 8),
ids AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc(conv_id, n, i, v) AS (
  SELECT conv_id, n, 0, 4294967295::UBIGINT FROM ids
  UNION ALL SELECT conv_id, crc.n, i + 1, xor(crc.v >> 8, bytes.v) FROM crc JOIN bytes ON bytes.n = xor(crc.v, ascii(substr(conv_id::VARCHAR, i + 1, 1))::UBIGINT) & 255 WHERE i < length(conv_id::VARCHAR)),
want AS (SELECT conv_id, n, (xor(v, 4294967295::UBIGINT) % 4)::BIGINT AS h, conv_id - conv_id % 20 AS base FROM crc WHERE i = length(conv_id::VARCHAR)),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
lent AS (SELECT w.conv_id, t.i AS depth, t.role, t.text FROM want w JOIN turns t ON t.conv_id = w.base AND t.i <= w.h),
taken AS (SELECT conv_id, count(*) AS k FROM lent GROUP BY conv_id),
own AS (SELECT t.conv_id, t.i - w.h + coalesce(k.k, 0) AS depth, t.role, t.text FROM turns t JOIN want w ON w.conv_id = t.conv_id AND t.i > w.h LEFT JOIN taken k ON k.conv_id = t.conv_id),
told AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words FROM (SELECT * FROM lent UNION ALL SELECT * FROM own)),
paths AS (
  SELECT conv_id, depth, words, string_agg(sha256(length(role) || ':' || role || text), '/') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path,
         count(*) OVER (PARTITION BY conv_id) AS size FROM told
  UNION ALL SELECT w.conv_id, 0, 0, '', coalesce((SELECT max(depth) FROM told t WHERE t.conv_id = w.conv_id), 0) FROM want w),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, max(size) AS longest,
         coalesce(string_agg(CASE WHEN depth = size THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM paths GROUP BY path, depth),
up AS (SELECT u.conv_id AS below, u.depth AS below_depth, u.n_convs, u.words, u.depth = u.longest AS leaf, v.path, v.depth FROM nodes u JOIN paths v ON v.conv_id = u.conv_id AND v.depth <= u.depth),
sums AS (
  SELECT path, depth, count(*) FILTER (below_depth = depth + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM up GROUP BY path, depth),
parents AS (SELECT u.below AS conv_id, u.below_depth AS depth, v.conv_id AS parent_conv_id FROM up u JOIN nodes v ON v.path = u.path AND v.depth = u.depth WHERE u.depth = u.below_depth - 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path AND s.depth = n.depth LEFT JOIN parents p ON p.conv_id = n.conv_id AND p.depth = n.depth
"""
