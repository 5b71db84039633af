"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source repeats its documents in a newly shuffled order every round. A document's virtual finish time is the words that its
source has sent when it ends, divided by the source's target; the queue is ranged by it, and cut where the total budget is spent.

The words sent so far are a running sum over a source, and one source may hold a third of all rows. So the sum has two levels:
the shuffle hash deals each source into ranges; whole ranges are summed first, and a window only runs within a range.
The cut is found likewise, in a histogram of finish times and then in the one bin that holds it. Ranges a source and bins are about as many as
the square root of the rows, so that neither a range nor the list of ranges is long.

The shuffle hash is of the id and the text. Rows that are equal in both (a third of all rows may be) are one row with a count in all sums; the
queue takes them one after the other, which their place in the block gives without a window. How many of them are taken is arithmetic; where rows
are asked for, a block's are dealt over tasks in pieces.

Defined cases: a null or blank text has size 0 and is taken 0 words. A null source is a source of its own. Rows repeated, or sharing
a null or other doc_id, keep a row each, with its own fate. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.base import each_place, named, positional, table, written


def n_words(text: str | Column) -> Column:
    """Words: maximal runs of what is not ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(round_: int, id_: str, text: str) -> Column:
    """16 hexadecimal digits: a null id counts as one that is absent."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(f"mix{round_}"), F.col(id_).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))), 1, 16)


def targets(sized: DataFrame, weights: tuple[float, ...] | DataFrame, budget: float, most: int) -> DataFrame:
    """(source, source_size, target): the budget dealt by weight; what a source can't use is dealt again among the others.

    weights: (source, weight), or numbers that sources get in turn by code point, null last.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
        sums = sums.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna({"weight": 0.0})
    else:
        turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        sums = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights)).cast("int") + 1))
    bound = sums.withColumn("most", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("most") / F.when(F.col("weight") > 0, F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("source_size").over(Window.partitionBy()) * F.lit(budget) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = bound.withColumn("level", F.try_divide(rest, F.sum("weight").over(after)))
    stops = F.col("most") <= F.col("level") * F.col("weight")
    shared = F.max(F.when(~stops, F.col("level"))).over(Window.partitionBy())
    return level.select("source", "source_size", F.when(stops, F.col("most")).otherwise(F.least("most", F.coalesce(shared, F.lit(0.0)) * F.col("weight"))).alias("target"))


def finish_times(blocks: DataFrame, aims: DataFrame, rounds: int, digits: int) -> DataFrame:
    """blocks (doc_id, source, size, many, h0, h1, ...) with source_size, target, and s0, s1, ...: the words sent before each round's block.

    digits: those of the shuffle hash that name a range.
    """
    aims = aims.select(F.col("source").alias("_s"), "source_size", "target")
    out = blocks.join(aims, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    words = F.col("size") * F.col("many")
    for k in range(rounds):
        out = out.withColumn("_r", F.substring(f"h{k}", 1, digits))
        ranges = out.groupBy("source", "_r").agg(F.sum(words).alias("_n"))
        earlier = Window.partitionBy("source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(F.col("source").alias("_s"), F.col("_r").alias("_q"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_sent"))
        out = out.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_r") == F.col("_q")))
        within = Window.partitionBy("source", "_r").orderBy(f"h{k}", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
        sent = F.lit(k) * F.col("source_size") + F.col("_sent") + F.coalesce(F.sum(words).over(within), F.lit(0))
        out = out.withColumn(f"s{k}", sent).drop("_s", "_q", "_sent", "_r")
    return out


def finish(k: int, place: Column | str) -> Column:
    """The finish time in round k of the block's row at this place, counted from 1."""
    return F.try_divide((F.col(f"s{k}") + F.col("size") * place).cast("double"), "target")


def cut_time(timed: DataFrame, rounds: int, total: float, bins: int) -> float:
    """The last finish time up to which the queue holds at most total words. bins: of each unit of virtual time."""
    queue = timed.where("size > 0 and target > 0").select("size", "target", "many", F.explode(F.array(*[F.col(f"s{k}") for k in range(rounds)])).alias("s"))
    bin_of = lambda place: F.least(F.floor((F.col("s") + F.col("size") * place).cast("double") / F.col("target") * bins), F.lit(2 * bins)).cast("long")
    # a block's rows lie in a row of bins; its share of each bin is counted, not its rows
    spread = queue.withColumn("bin", F.explode(F.sequence(bin_of(F.lit(1)), bin_of(F.col("many")))))
    upto_bin = lambda b: F.greatest(F.lit(0), F.least(F.col("many"), F.ceil((b / F.lit(float(bins)) * F.col("target") - F.col("s")) / F.col("size")).cast("long") - 1))
    rows = spread.withColumn("first", F.when(bin_of(F.lit(1)) == F.col("bin"), F.lit(0)).otherwise(upto_bin(F.col("bin")))).withColumn("last", F.when(bin_of(F.col("many")) == F.col("bin"), F.col("many")).otherwise(upto_bin(F.col("bin") + 1)))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum(F.col("size") * (F.col("last") - F.col("first")))
    sums = rows.groupBy("bin").agg(share.alias("n")).select("bin", (F.sum("n").over(upto) - F.col("n")).alias("sent"), F.sum("n").over(upto).alias("upto"))
    found = sums.where(F.col("upto") > F.lit(total)).orderBy("bin").limit(1).collect()  # one row
    if not found:
        return float("inf")
    inside = rows.where((F.col("bin") == found[0]["bin"]) & (F.col("last") > F.col("first")))
    each = each_place(inside.select("s", "size", "target", "first", (F.col("last") - F.col("first")).alias("n")), "n", "nth").withColumn("place", F.col("first") + F.col("nth"))
    ties = each.groupBy(((F.col("s") + F.col("size") * F.col("place")).cast("double") / F.col("target")).alias("f")).agg(F.sum("size").alias("n"))
    run = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    last = ties.select("f", (F.sum("n").over(run) + F.lit(found[0]["sent"])).alias("upto")).where(F.col("upto") <= F.lit(total)).agg(F.max("f")).first()[0]
    return last if last is not None else (found[0]["bin"] / bins) * (1 - 1e-12)


def row_mark(df: DataFrame) -> Column:
    """A hash of all columns."""
    return F.xxhash64(*[F.map_entries(named(c)) if kind.startswith("map<") else named(c) for c, kind in df.dtypes])


def taken_blocks(df: DataFrame, weights: tuple[float, ...] | DataFrame, budget: float, rounds: int, id_col: str, text: str, source: str, mark: Column) -> tuple[DataFrame, float]:
    """Blocks of equal rows with the words sent before them, and the queue's cut."""
    texts = df.select(named(id_col).alias("doc_id"), named(source).alias("source"), named(text).alias("text"), mark.alias("mark"))
    keys = [shuffle_key(k, "doc_id", "text").alias(f"h{k}") for k in range(rounds)]
    sized = texts.select("doc_id", "source", n_words("text").alias("size"), "mark", *keys)
    blocks = written(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("many")), "sized")
    facts = blocks.agg(F.sum(F.col("size") * F.col("many")).alias("words"), F.sum("many").alias("rows")).first()
    root = math.sqrt(facts["rows"] or 0)
    digits, bins = max(1, min(8, round(math.log(root + 1, 16)))), max(64, 1 << round(math.log2(root + 1)))
    aims = targets(blocks.select("source", (F.col("size") * F.col("many")).alias("size")), weights, budget, rounds)
    timed = written(finish_times(blocks, aims, rounds, digits), "timed")
    return timed, cut_time(timed, rounds, (facts["words"] or 0) * budget, bins)


def taken_places(cut: float, k: int) -> Column:
    """How many of the block's rows the mix takes in round k; finish times grow with the place, so they are its first ones.

    The quotient tells it but for rounding; the comparison that times_taken() makes has the last word.
    """
    about = F.floor((F.lit(cut) * F.col("target") - F.col(f"s{k}")) / F.col("size"))
    about = F.when(about >= F.col("many"), F.col("many")).otherwise(F.greatest(about.cast("long"), F.lit(0)))
    near = [F.greatest(F.lit(0).cast("long"), F.least(F.col("many"), about + d)) for d in range(-2, 3)]
    return F.coalesce(F.greatest(F.lit(0).cast("long"), *[F.when((n > 0) & F.coalesce(finish(k, n) <= F.lit(cut), F.lit(False)), n) for n in near]), F.lit(0))


def times_taken(cut: float, rounds: int, place: Column | str) -> Column:
    """How often the mix takes the block's row at this place."""
    times = sum((F.coalesce(finish(k, place) <= F.lit(cut), F.lit(False)).cast("int") for k in range(rounds)), F.lit(0))
    return F.when(F.col("size") > 0, times).otherwise(0)


def mix(df: DataFrame, weights: tuple[float, ...] | DataFrame = (1.0,), budget: float = 1.0, rounds: int = 2, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, times (how often the mix takes the document), taken (its words, repeats counted).

    budget: the mix's words over all words. No document is taken more than rounds times.
    """
    timed, cut = taken_blocks(df, weights, budget, rounds, id_col, text, source, F.lit(0).cast("long"))
    rows = each_place(timed, "many", "_place").withColumn("times", times_taken(cut, rounds, F.col("_place")))
    return rows.select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, weights: tuple[float, ...] | DataFrame = (1.0,), budget: float = 1.0, rounds: int = 2, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df's rows, each as often as the mix takes it. Of rows that are equal in all columns one is carried along, with their count of all."""
    flat = positional(df)
    at = {c: f"c{df.columns.index(c)}" for c in (id_col, text, source)}
    mark = row_mark(flat)
    timed, cut = taken_blocks(flat, weights, budget, rounds, at[id_col], at[text], at[source], mark)
    taken = sum((taken_places(cut, k) for k in range(1, rounds)), taken_places(cut, 0))
    times = timed.where("size > 0").withColumn("times", taken).where("times > 0").groupBy(F.col("h0").alias("h"), F.col("mark").alias("m")).agg(F.sum("times").alias("times"))
    one = flat.withColumns({"h": shuffle_key(0, at[id_col], at[text]), "m": mark}).dropDuplicates(["h", "m"])
    return each_place(one.join(times, ["h", "m"]), "times", "copy").select(*flat.columns).toDF(*df.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), (3.0, 1.0, 2.0), 1.5)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, concat_ws(':', doc_id, md5(coalesce(text, ''))) AS name FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aims AS (
  SELECT source, source_size, CASE WHEN most <= level * weight THEN most
    ELSE least(most, coalesce(max(CASE WHEN most > level * weight THEN level END) OVER (), 0) * weight) END AS target FROM levels),
timed AS (
  SELECT s.doc_id, s.source, s.size, a.source_size, a.target, r.k,
    (r.k * a.source_size + sum(s.size) OVER (PARTITION BY s.source, r.k ORDER BY substr(md5('mix' || r.k || ':' || s.name), 1, 16), s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / nullif(a.target, 0) AS f
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source CROSS JOIN (VALUES (0), (1)) r(k)),
ties AS (SELECT f, sum(size) AS n FROM timed WHERE f IS NOT NULL AND size > 0 GROUP BY f),
run AS (SELECT f, sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ties),
cut AS (SELECT max(f) AS f FROM run WHERE upto <= (SELECT sum(size) * 1.5::DOUBLE FROM sized))
SELECT doc_id, size, source_size, target, (sum(CASE WHEN t.f <= cut.f THEN size ELSE 0 END))::BIGINT AS taken
FROM timed t, cut GROUP BY doc_id, source, size, source_size, target
"""
