"""Propagation of a resolved item to similar ones, and its way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ann
from millrace.operators.graph import cut

# The thresholds of confirmation and propagation.
LEAST_CONFIDENCE, LEAST_BACKING, LEAST_VOTES, MOST_DOWN, SIMILARITY, MOST_DEPTH = 0.78, 3, 7, 0.25, 0.88, 2
CASCADE_CONFIDENCE, CASCADE_BACKING, MOST_TARGETS, LENGTH_SLACK = 0.80, 4, 50, 3


def confirmation(status: Column, kind: Column, confidence: Column, up: Column, down: Column, backing: Column) -> Column:
    """Why a proposal isn't confirmed, or `confirmed`: the conditions in their order; cascade proposals need more."""
    u, d, b = (F.coalesce(x, F.lit(0)) for x in (up, down, backing))
    votes, cascade = u + d + b, kind == "cascade"
    need = F.when(cascade, F.greatest(F.lit(LEAST_CONFIDENCE), F.lit(CASCADE_CONFIDENCE))).otherwise(LEAST_CONFIDENCE)
    backers = F.when(cascade, F.greatest(F.lit(LEAST_BACKING), F.lit(CASCADE_BACKING))).otherwise(LEAST_BACKING)
    return (
        F.when(status != "pending", "proposal_already_resolved")
        .when(F.coalesce(confidence, F.lit(0.0)) < need, "confidence_too_low")
        .when(b < backers, "insufficient_corroborations")
        .when(votes < LEAST_VOTES, "insufficient_votes")
        .when(F.coalesce(F.try_divide(d.cast("double"), votes.cast("double")), F.lit(0.0)) > MOST_DOWN, "too_many_downvotes")
        .otherwise("confirmed")
    )


def transition(status: Column, allowed: tuple[str, ...], to: str) -> Column:
    """Compare and set: the new status where the old one is among the allowed."""
    return F.when(status.isin(*allowed), F.lit(to)).otherwise(status)


def close_pairs(items: DataFrame, least: float = SIMILARITY, slack: int = LENGTH_SLACK, sources: DataFrame | None = None) -> DataFrame:
    """(source, target, similarity) of items (id, kind, length, vector, status): target unsolved, of the source's kind and about its length.

    sources: (id) of the items that are sources; all, if it isn't given.

    Unknown kinds and lengths of the source fit all; an unknown length of the target fits none that is known; sources that know neither go nowhere. Every source meets its targets in one sort of groups, by
    what it knows: kind and each length in reach, kind alone, or each length in reach alone. So a pair is met once, and a group's vectors are compared by products of matrices.
    """
    group = lambda name, *by: F.xxhash64(F.lit(name), F.size("vector"), *by)
    length, kind, size = F.col("length").cast("long"), F.col("kind").isNotNull(), F.col("length").isNotNull()
    reach = F.sequence(length - slack, length + slack)
    chosen = items if sources is None else items.join(sources.select("id").distinct(), "id", "left_semi")
    asks = F.when(kind & size, F.transform(reach, lambda x: group("both", "kind", x))).when(kind, F.array(group("kind", "kind"))).when(size, F.transform(reach, lambda x: group("length", x)))
    holds = F.array_compact(F.array(F.when(kind & size, group("both", "kind", length)), F.when(kind, group("kind", "kind")), F.when(size, group("length", length))))
    a = chosen.where("vector IS NOT NULL").select(F.col("id").alias("q"), "vector", F.explode(asks).alias("group"))
    b = items.where("vector IS NOT NULL AND status = 'unsolved'").select(F.col("id").alias("key"), "vector", F.explode(holds).alias("group"))
    return ann.alike(b, a, least).where("q <> key").select(F.col("q").alias("source"), F.col("key").alias("target"), "similarity")


def cascade_counts(items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(id, n): how many unsolved items each one would reach."""
    n = close_pairs(items, least).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return items.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def reached(items: DataFrame, confirmed: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(id, source, text, depth, similarity): the unsolved items that confirmed ones (id, text) go on to, one deeper than their source.

    Each source has MOST_TARGETS at most, the most similar; a target of several sources takes the most similar one. Sources at MOST_DEPTH go no further.
    """
    depths = items.select(F.col("id").alias("source"), F.coalesce("depth", F.lit(0)).alias("d")).where(F.col("d") < MOST_DEPTH)
    sources = confirmed.join(depths.select(F.col("source").alias("id")), "id", "left_semi")  # only these are compared with all targets
    pairs = close_pairs(items, least, sources=sources).join(confirmed.select(F.col("id").alias("source"), "text"), "source")
    ranked = pairs.join(depths, "source").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("similarity"), "target"))).where(F.col("r") <= MOST_TARGETS)
    best = ranked.groupBy(F.col("target").alias("id")).agg(F.min_by(F.struct("source", "text", (F.col("d") + 1).alias("depth"), "similarity"), F.struct(-F.col("similarity"), F.col("source"))).alias("w"))
    return best.join(confirmed.select("id"), "id", "left_anti").select("id", "w.*")


def propagate(items: DataFrame, confirmed: DataFrame, found: DataFrame) -> DataFrame:
    """Items after the confirmed ones (id, text) went on: those that were found (reached()) are proposed."""
    best = found.select("id", F.struct("source", "text", "depth").alias("w"))
    out = items.join(best, "id", "left").join(confirmed.select("id", F.col("text").alias("_text")), "id", "left")
    hit = F.col("w").isNotNull()
    return out.select(
        "id", "kind", "length", "vector",
        F.when(F.col("_text").isNotNull(), "confirmed").when(hit, "proposed").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("w.source")).otherwise(F.col("source")).alias("source"), F.when(hit, F.col("w.depth")).otherwise(F.col("depth")).alias("depth"),
        F.coalesce("_text", F.when(hit, F.col("w.text")), "text").alias("text"),
    )


def cascade_proposals(found: DataFrame) -> DataFrame:
    """The proposals that reached items get: one an item and text, with the source that it cites."""
    return found.select(
        F.concat_ws(":", F.lit("cascade"), "id", F.md5("text")).alias("proposal"), "id", "text", F.lit("pending").alias("status"), F.lit("cascade").alias("kind"), F.lit(None).cast("double").alias("confidence"),
        *[F.lit(0).cast("long").alias(x) for x in ("up", "down", "backing")], F.array(F.col("source").cast("string")).alias("sources"), F.col("similarity").alias("match"),
    )


def confirm_and_propagate(items: DataFrame, proposals: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Items and proposals (proposal, id, text, status, kind, confidence, up, down, backing, sources, match) after all proposals were judged.

    Of an item's proposals that meet the conditions the most confident one (then the first) is accepted and the pending others are superseded; the item, unless it is
    confirmed or disputed already, takes its text and goes on to similar ones, which get proposals that cite it. A pending cascade proposal of the
    same item and text isn't made twice. outcome tells why a proposal wasn't accepted; it is null for those that are new.
    """
    outcome = confirmation(F.col("status"), F.col("kind"), F.col("confidence"), F.col("up"), F.col("down"), F.col("backing"))
    closed = items.where(F.col("status").isin("confirmed", "disputed")).select("id", F.lit(True).alias("_closed"))
    judged = proposals.withColumn("outcome", outcome).join(closed, "id", "left")
    judged = judged.withColumn("outcome", F.when((F.col("outcome") == "confirmed") & F.col("_closed"), "item_already_resolved").otherwise(F.col("outcome"))).drop("_closed")
    best = judged.where("outcome = 'confirmed'").groupBy("id").agg(F.min_by(F.struct("proposal", "text"), F.struct(-F.col("confidence"), F.col("proposal"))).alias("b"))
    won = cut(best.select("id", F.col("b.proposal").alias("_won"), F.col("b.text").alias("text")))
    marked = judged.join(won.select("id", "_won"), "id", "left")
    status = F.when(F.col("proposal") == F.col("_won"), "accepted").when(F.col("_won").isNotNull() & (F.col("status") == "pending"), "superseded").otherwise(F.col("status"))
    old = marked.withColumn("status", status).drop("_won")
    found = cut(reached(items, won.select("id", "text"), least))
    pending = old.where("kind = 'cascade' AND status = 'pending'").select("id", "text")
    new = cascade_proposals(found).join(pending, ["id", "text"], "left_anti")
    return propagate(items, won.select("id", "text"), found), old.unionByName(new.withColumn("outcome", F.lit(None).cast("string")))


def trees(items: DataFrame, roots: DataFrame, depth: int = 20) -> DataFrame:
    """(id, root): the roots (id) and all items that come from them, level by level; root: whether it is one."""
    level = cut(roots.select("id").distinct().join(items.select("id"), "id", "left_semi"))
    found = level.withColumn("root", F.lit(True))
    children = items.where("source IS NOT NULL").select("id", "source")
    for _ in range(depth):
        level = cut(children.join(level.select(F.col("id").alias("source")), "source", "left_semi").select("id").distinct().join(found.select("id"), "id", "left_anti"))
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("root", F.lit(False)))
    return found


def revert(items: DataFrame, proposals: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and proposals with whole trees (nodes: id, root) taken back.

    Items are unsolved again, without a text; the root keeps where it came from. Cascade proposals that cite any node go; a root's accepted proposal
    is rejected, and its superseded ones are pending.
    """
    marked = items.join(nodes.select("id", "root"), "id", "left")
    inside, leaf = F.col("root").isNotNull(), F.col("root") == F.lit(False)
    back = marked.select(
        "id", "kind", "length", "vector", F.when(inside, "unsolved").otherwise(F.col("status")).alias("status"), F.when(leaf, F.lit(None)).otherwise(F.col("source")).alias("source"),
        F.when(leaf, F.lit(0)).otherwise(F.col("depth")).alias("depth"), F.when(inside, F.lit(None)).otherwise(F.col("text")).alias("text"),
    )
    cites = proposals.where("kind = 'cascade'").select("proposal", F.explode("sources").alias("_s"))
    gone = cites.join(nodes.select(F.col("id").cast("string").alias("_s")), "_s", "left_semi").select("proposal").distinct()
    kept = proposals.join(gone, "proposal", "left_anti").join(nodes.where("root").select("id", F.lit(True).alias("_root")), "id", "left")
    status = F.when(F.col("_root") & (F.col("status") == "accepted"), "rejected").when(F.col("_root") & (F.col("status") == "superseded"), "pending").otherwise(F.col("status"))
    return back, kept.withColumn("status", status).drop("_root")
