"""Entity resolution: pairs, similar names, merging, matching of names in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import similarity_of, snippet, trigrams
from millrace.operators.graph import connected_components
from millrace.operators.paging import numbered


def cooccurrence(mentions: DataFrame, document: str, entity: str, keep: int = 0) -> DataFrame:
    """(a, b, n, last): unordered pairs of entities of one document, in how many documents, and the largest of these; keep: also evidence, the first `keep` of them.

    No pair's documents are gathered beyond those that are kept: they are numbered in their order first.
    """
    m = mentions.select(F.col(document).alias("d"), F.col(entity).alias("e")).where("e IS NOT NULL").distinct()
    pairs = m.alias("x").join(m.alias("y"), (F.col("x.d") == F.col("y.d")) & (F.col("x.e") < F.col("y.e")))
    pairs = pairs.select(F.col("x.e").alias("a"), F.col("y.e").alias("b"), F.col("x.d").alias("d"))
    if not keep:
        return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))
    pair = Window.partitionBy("a", "b")
    few = pairs.withColumns({"n": F.count(F.lit(1)).over(pair), "last": F.max("d").over(pair), "r": F.row_number().over(pair.orderBy("d"))}).where(F.col("r") <= keep)
    return few.groupBy("a", "b").agg(F.max("n").alias("n"), F.max("last").alias("last"), F.sort_array(F.collect_list("d")).alias("evidence"))


def _trigram_sets(names: DataFrame, id_col: str, name: str, kind: str | None) -> DataFrame:
    return names.select(F.col(id_col).alias("id"), (F.col(kind) if kind else F.lit("")).alias("kind"), F.array_sort(trigrams(name)).alias("g")).where(F.size("g") > 0)


def name_classes(names: DataFrame, id_col: str, name: str, kind: str | None = None) -> DataFrame:
    """(id, first): the smallest id of its kind with the same trigrams. However many share a name, none of their pairs is made."""
    sets = _trigram_sets(names, id_col, name, kind)
    firsts = sets.groupBy("kind", "g").agg(F.min("id").alias("first"))
    same = (F.col("s.g") == F.col("f.g")) & F.col("s.kind").eqNullSafe(F.col("f.kind"))
    return sets.alias("s").join(firsts.alias("f"), same).select("id", "first")


def merge_groups(names: DataFrame, id_col: str, name: str, kind: str | None = None, least: float = 0.95) -> DataFrame:
    """(node, keep): of each group of names that are linked at `least` or more, or have equal trigrams, the smallest id; names alone are left out."""
    pairs = similar_names(names, id_col, name, kind, least - 1e-6, None).where(F.col("similarity") >= least)
    classes = name_classes(names, id_col, name, kind)
    linked = representatives(pairs)
    kept = classes.join(linked.withColumnRenamed("node", "first"), "first", "left").select(F.col("id").alias("node"), F.coalesce("keep", "first").alias("keep"))
    sizes = kept.groupBy("keep").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(sizes.where("n > 1"), "keep").select("node", "keep")


def similar_names(names: DataFrame, id_col: str, name: str, kind: str | None = None, least: float = 0.85, limit: int | None = 500) -> DataFrame:
    """(a, b, similarity): pairs of one kind over the threshold, a < b, by trigrams, between the first ids of names with equal trigrams; name_classes() tells who these stand for.

    Prefix filter: with trigrams ordered from rare to frequent, two sets of Jaccard coefficient >= t share one of the first n - ceil(t n) + 1 of each; only
    names that share such a trigram, whose sizes fit, and which after it have enough trigrams left are compared. The result equals comparing all pairs.
    """
    base = _trigram_sets(names, id_col, name, kind).groupBy("kind", "g").agg(F.min("id").alias("id"))
    grams = base.select("id", "kind", F.explode("g").alias("x"))
    counted = grams.join(grams.groupBy("kind", "x").agg(F.count(F.lit(1)).alias("met")), ["kind", "x"])
    ordered = counted.groupBy("id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("met", "x"))), lambda y: y["x"]).alias("g"))  # a name's trigrams
    n = F.size("g")
    firsts = ordered.select("id", "kind", "g", F.posexplode(F.slice("g", F.lit(1), (n - F.ceil(F.lit(least) * n) + 1).cast("int"))).alias("at", "x"))
    a, b = firsts.alias("a"), firsts.alias("b")
    na, nb = F.size("a.g"), F.size("b.g")
    fits = (na >= F.lit(least) * nb) & (nb >= F.lit(least) * na)
    left = F.least(na - F.col("a.at"), nb - F.col("b.at")) >= F.lit(least / (1 + least) - 1e-9) * (na + nb)
    met = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.id") < F.col("b.id")) & fits & left)
    score = F.when(fits & left, F.round(similarity_of(F.col("a.g"), F.col("b.g")), 6))  # its filter is pushed into the join, before the cheap conditions
    scored = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), score.alias("similarity")).distinct()
    found = scored.where(F.col("similarity") > least)
    return found.orderBy(F.desc("similarity"), "a", "b").limit(limit) if limit else found


def linked_names(names: DataFrame, id_col: str, name: str, kind: str, least: float = 0.85) -> DataFrame:
    """(a, b, similarity, copy): every pair of different names of one kind over the threshold, between the first ids of either name (copy false), and
    each further id of a name beside its first one (copy true), whose pairs are its own.

    Names that differ in letter case, order of words or marks alone have equal trigrams and are pairs of similarity 1.
    """
    each = names.select(F.col(id_col).alias("id"), F.col(kind).alias("kind"), F.col(name).alias("name")).where("kind IS NOT NULL")
    firsts = each.groupBy("kind", "name").agg(F.min("id").alias("first")).where(F.size(trigrams("name")) > 0)
    classes = name_classes(firsts, "first", "name", "kind").withColumnsRenamed({"id": "text", "first": "class"})
    a, b = (classes.select(F.col("text").alias(k), F.col("class").alias(f"of_{k}")) for k in "ab")
    pairs = similar_names(firsts, "first", "name", "kind", least, None).withColumnsRenamed({"a": "of_a", "b": "of_b"})
    across = pairs.join(a, "of_a").join(b, "of_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    within = a.join(b, F.col("of_a") == F.col("of_b")).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    copies = each.join(firsts, ["kind", "name"]).where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within).withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))


def representatives(pairs: DataFrame) -> DataFrame:
    """(node, keep): of each group of linked entities the smallest id."""
    return connected_components(pairs).select("node", F.col("component").alias("keep"))


def merge_entities(entities: DataFrame, mentions: DataFrame, edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities (id, name, aliases, mention_count, risk), mentions (entity, document) and edges (a, b, kind, strength) after merging groups (node, keep), and the log.

    Aliases take the merged names, counts are summed, risk is the largest; edges are re-pointed, self edges go, of equal edges the strongest stays.
    """
    kept = lambda df, col_: df.join(groups.withColumnRenamed("node", col_), col_, "left").withColumn(col_, F.coalesce("keep", col_)).drop("keep")
    keyed = entities.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("to", F.coalesce("keep", "id"))
    own = F.col("id") == F.col("to")
    names = F.collect_set(F.when(~own, F.col("name")))
    merged = keyed.groupBy("to").agg(
        F.max(F.when(own, F.col("name"))).alias("name"), F.sort_array(F.array_distinct(F.concat(F.flatten(F.collect_list("aliases")), names))).alias("aliases"),
        F.sum("mention_count").alias("mention_count"), F.max("risk").alias("risk"),
    ).withColumnRenamed("to", "id")
    moved = kept(mentions, "entity").distinct()
    pointed = kept(kept(edges, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", "strength").where("a <> b")
    return merged, moved, pointed.groupBy("a", "b", "kind").agg(F.max("strength").alias("strength")), keyed.where(~own).select(F.col("to").alias("kept"), F.col("id").alias("merged"), F.lit("similar name").alias("reason"))


def resolve_names(raw: DataFrame, raw_col: str, entities: DataFrame, id_col: str = "id", name: str = "name", aliases: str = "aliases", rank: str = "mention_count") -> DataFrame:
    """raw with entity: by exact name, else by alias, else by the last word if one name contains the other; of several the one with the most mentions.

    Every tier is an equi-join on distinct names, not a scan of pairs.
    """
    key = F.lower(F.trim(F.col(raw_col)))
    want = raw.select(key.alias("k")).where("k <> ''").distinct()
    e = entities.select(F.col(id_col).alias("entity"), F.lower(name).alias("n"), F.col(aliases).alias("al"), F.col(rank).alias("r"))
    first = lambda df: df.groupBy("k").agg(F.min_by("entity", F.struct(-F.col("r"), F.col("entity"))).alias("entity"))
    exact = first(want.join(e, F.col("k") == F.col("n")))
    by_alias = first(want.join(e.select("entity", "r", F.explode("al").alias("x")).withColumn("x", F.lower("x")), F.col("k") == F.col("x")))
    last = lambda c: F.element_at(F.split(c, r"\s+"), -1)
    near = want.join(e, (last(F.col("k")) == last(F.col("n"))) & (F.length(last(F.col("k"))) >= 3)).where(F.contains("n", F.col("k")) | F.contains("k", F.col("n")))
    tiers = exact.withColumn("t", F.lit(1)).unionByName(by_alias.withColumn("t", F.lit(2))).unionByName(first(near).withColumn("t", F.lit(3)))
    best = tiers.groupBy("k").agg(F.min_by("entity", "t").alias("entity"), F.min("t").alias("tier"))
    return raw.join(best, key == F.col("k"), "left").drop("k")


def find_mentions(texts: DataFrame, id_col: str, text: str, names: DataFrame, entity: str, name: str, weight: str = "confidence", least: int = 3, most: int = 3) -> DataFrame:
    """(id_col, entity, n, confidence, snippet): names of `least` letters or more as whole words in any case, one row a text and entity.

    Names and texts meet on the name's first word, an equi-join; the phrase is then looked for in the text. n counts `most` matches of a name at most.
    """
    first = lambda c: F.get(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.lit(0))
    wanted = names.where(F.length(name) >= least).select(F.col(entity).alias("entity"), F.lower(name).alias("name"), F.col(weight).alias("w"))
    wanted = wanted.groupBy("entity", "name").agg(F.max("w").alias("w")).withColumn("word", first(F.col("name")))
    whole = texts.where(F.length(text) >= 10).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    words = whole.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
    met = whole.join(words.join(wanted, "word").select("id", "entity", "name", "w").distinct(), "id")  # texts meet only the names that may be in them
    quoted = F.concat(F.lit(r"\b\Q"), F.col("name"), F.lit(r"\E\b"))
    hits = met.withColumn("n", F.least(F.regexp_count(F.lower("text"), quoted), F.lit(most))).where("n > 0")
    found = hits.select("id", "entity", "n", "w", F.struct((-F.col("w")).alias("o"), F.col("name").alias("k"), snippet(F.col("text"), F.position(F.col("name"), F.lower("text")), F.length("name")).alias("s")).alias("best"))
    out = found.groupBy("id", "entity").agg(F.sum("n").alias("n"), F.max("w").alias("confidence"), F.min("best").alias("best"))
    return out.select(F.col("id").alias(id_col), "entity", "n", "confidence", F.col("best.s").alias("snippet"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The table with changes put in by key; of several changes to one key the last by the order."""
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("_new", F.lit(0)).withColumn("_o", F.lit(None).cast("string")).unionByName(changes.select(*table.columns, F.lit(1).alias("_new"), (order.cast("string") if order is not None else F.lit(None).cast("string")).alias("_o")))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", "_o")).alias("_r")).select(*keys, "_r.*")


def rename_kind(edges: DataFrame, old: str, new: str) -> DataFrame:
    """Edges (a, b, kind, strength) with one kind renamed; where both kinds are there, the stronger stays."""
    named = edges.withColumn("kind", F.when(F.col("kind") == old, new).otherwise(F.col("kind")))
    return named.groupBy("a", "b", "kind").agg(F.max("strength").alias("strength"))


def best_match(records: DataFrame, candidates: DataFrame, key: str, second: str, value: str) -> DataFrame:
    """Repairs records: of the candidates with the same key the one with the same second field, else the first that has a value."""
    c = candidates.select(F.col(key).alias("_k"), F.col(second).alias("_s"), F.col(value).alias("_v"), F.monotonically_increasing_id().alias("_o"))
    met = records.join(c, F.col(key) == F.col("_k"), "left")
    ranked = met.groupBy(*records.columns).agg(F.min_by("_v", F.struct((~F.coalesce(F.col(second) == F.col("_s"), F.lit(False))).alias("a"), F.col("_v").isNull().alias("b"), F.col("_v").alias("c"))).alias(f"matched_{value}"))
    return ranked


def by_position(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """The i-th row of a beside the i-th row of b."""
    row = lambda df, p: numbered(df, [order], "i").select("i", *[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return row(a, "a").join(row(b, "b"), "i", "full")


def find_or_create(wanted: DataFrame, known: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """keys, id_col, met, created: the known row's id, or a new one that is made of the key, so that two runs make the same."""
    met = wanted.groupBy(*keys).agg(F.count(F.lit(1)).alias("met"))
    first = known.groupBy(*keys).agg(F.min(F.col(id_col).cast("string")).alias(id_col))
    return met.join(first, keys, "left").select(*keys, F.coalesce(id_col, F.md5(F.concat_ws("|", *keys))).alias(id_col), "met", F.col(id_col).isNull().alias("created"))


def word_pattern(name: str) -> str:
    return rf"(?i)\b{re.escape(name)}\b"
