"""Events of an entity over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.dates import within_days


def united(sources: dict[str, DataFrame]) -> DataFrame:
    """Sources (entity, at, document) under their activity's name."""
    return reduce(DataFrame.unionByName, [s.select(F.lit(k).alias("activity"), "entity", F.col("at").cast("date").alias("at"), "document") for k, s in sources.items()])


def clusters(events: DataFrame, days: int) -> DataFrame:
    """Events with the cluster they belong to: a gap of more than `days` days starts a new one. Entities are windows of their own."""
    w = Window.partitionBy("entity").orderBy("at", "activity", "document")
    gap = F.datediff("at", F.lag("at").over(w)) > days
    return events.withColumn("cluster", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def co_temporal(events: DataFrame, day: str, days: int) -> DataFrame:
    """(entity, n, activities) within `days` days of a day; n is the number of kinds of activity."""
    near = events.where(within_days("at", F.lit(day), days) & F.col("entity").isNotNull())
    kinds = F.sort_array(F.collect_set("activity"))
    return near.groupBy("entity").agg(F.size(kinds).alias("n"), kinds.alias("activities"))


def with_fallback(events: DataFrame, fallback: DataFrame) -> DataFrame:
    """The events, or what takes their place if there are none."""
    return fallback if events.isEmpty() else events
