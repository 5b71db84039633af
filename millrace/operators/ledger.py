"""Writes as results: merges, appends, counters and repairs as projections and aggregations over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_merge(old: Column, new: Column) -> Column:
    """Shallow merge of maps: of a key in both, the new value."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(F.coalesce(new, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def put_in_set(values: Column, value: Column) -> Column:
    return F.array_union(F.coalesce(values, F.array().cast("array<string>")), F.array(value))


def append(values: Column, value: Column) -> Column:
    return F.array_append(F.coalesce(values, F.array().cast("array<string>")), value)


def vote_counts(log: DataFrame, item: str, kind: str, removed: str) -> DataFrame:
    """(item, kind, n) after inserts and removals, 0 at least."""
    step = F.when(F.col(removed), -1).otherwise(1)
    return log.groupBy(item, kind).agg(F.greatest(F.sum(step), F.lit(0)).alias("n"))


def sticky(reached: Column, before: Column) -> Column:
    """Once true, always true."""
    return F.coalesce(before, F.lit(False)) | F.coalesce(reached, F.lit(False))


def sorted_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """a < b; pairs of one element go."""
    low, high = F.least(a, b), F.greatest(a, b)
    return df.where(F.col(a) != F.col(b)).withColumns({a: low, b: high})


def merge_on_key(df: DataFrame, keys: list[str], lists: tuple[str, ...], count: str) -> DataFrame:
    """One row a key: lists united and sorted, and how often the key was met."""
    return df.groupBy(*keys).agg(*[F.sort_array(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in lists], F.count(F.lit(1)).alias(count))


def clean_strength(c: Column, default: float = 0.5) -> Column:
    """0 to 1; what is no number is the default."""
    return F.when(c.isNull() | F.isnan(c), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def spend(log: DataFrame, campaign: str, cents: str, units: str) -> DataFrame:
    """Money and units by campaign, null included."""
    return log.groupBy(campaign).agg((F.sum(F.col(cents).cast("decimal(20,0)")) / 100).cast("decimal(20,2)").alias("amount"), F.sum(units).alias("units"))


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that df has: run again, it leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def compare_counts(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, expected, stored, matches) of two tables of counts (key, n)."""
    e, s = expected.select(key, F.col("n").alias("expected")), stored.select(key, F.col("n").alias("stored"))
    both = e.join(s, key, "full")
    return both.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored")).withColumn("matches", F.col("expected") == F.col("stored"))


def new_records(found: DataFrame, known: DataFrame, day: str, place: str) -> DataFrame:
    """Found rows whose day, or whose day and place, aren't known."""
    fresh = found.join(known.select(day).distinct(), day, "left_anti")
    other = found.join(known.select(day).distinct(), day, "left_semi").join(known.select(day, place).distinct(), [day, place], "left_anti")
    return fresh.unionByName(other.select(*fresh.columns))


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with the names of the rules that each row breaks; a rule that is null is broken. Rows without errors are what a batch writes."""
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("errors", errors)


def mark(df: DataFrame, due: Column, flag: str, id_col: str, most: int | None = None) -> DataFrame:
    """df with flag set to 'true' where it is null and the row is due; most: only for so many, the first by id, so that calls can be repeated until none is left."""
    waiting = df[flag].isNull() & F.coalesce(due, F.lit(False))
    if most is None:
        return df.withColumn(flag, F.when(waiting, "true").otherwise(F.col(flag)))
    batch = df.where(waiting).select(F.col(id_col).alias("_k")).orderBy("_k").limit(most)
    return df.join(batch, F.col(id_col) == F.col("_k"), "left").withColumn(flag, F.when(F.col("_k").isNotNull(), "true").otherwise(F.col(flag))).drop("_k")


def tally(log: DataFrame, item: str, kind: str, counted: dict[str, str]) -> DataFrame:
    """item and a count for each kind of vote; another kind is an error."""
    known = F.when(F.col(kind).isin(*counted.values()), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown vote: "), F.coalesce(kind, F.lit("null")))))
    return log.select(item, known.alias("k")).groupBy(item).agg(*[F.count_if(F.col("k") == v).alias(name) for name, v in counted.items()])


def log_spend(log: DataFrame, entries: DataFrame, campaign: str, amount: str) -> tuple[DataFrame, DataFrame]:
    """The log with new entries, and the counters (campaign, entries, spent) that they lead to; entries without a campaign count under null."""
    whole = log.unionByName(entries)
    return whole, whole.groupBy(campaign).agg(F.count(F.lit(1)).alias("entries"), F.sum(amount).alias("spent"))
