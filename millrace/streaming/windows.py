"""Structured Streaming over the events table. The reference has no streams; these are additions for its triggers and limits.

Queries run to the end of what is there (availableNow) and give what the sink then holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import new_folder


def shared(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet file, or folder of files, at path as a stream."""
    schema = spark.read.parquet(path).schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream writes until nothing is left: each batch is a partition of its own, so that a batch that runs again replaces itself."""
    spark = stream.sparkSession
    path = shared(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def tumbling(events: DataFrame, size: str, key: str = "event_type", late: str = "1 hour") -> DataFrame:
    """(start, key, n, total) by window; windows close when the watermark passes them."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, size: str, step: str, key: str = "event_type", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size, step)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events with less than the gap between them."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limit(events: DataFrame, most: int, seconds: int, key: str = "user_id") -> DataFrame:
    """(key, allowed, blocked): the first request opens a window; beyond `most` they are blocked until it is over. State is one row a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, count, allowed, blocked = state.get if state.exists else (None, 0, 0, 0)
        times, at = np.sort(np.concatenate([b["at"].to_numpy() for b in batches])), 0
        while at < len(times):  # a step a window, not a request
            if start is None or times[at] - start >= seconds * 1_000_000:
                start, count = int(times[at]), 0
            end = int(np.searchsorted(times, start + seconds * 1_000_000))
            room = min(end - at, max(0, most - count))
            allowed, blocked, count, at = allowed + room, blocked + end - at - room, count + end - at, end
        state.update((start, count, allowed, blocked))
        yield pd.DataFrame({key: [k[0]], "allowed": [allowed], "blocked": [blocked]})

    timed = events.select(key, F.unix_micros(F.col("ts")).alias("at"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} long, allowed long, blocked long", "start long, count long, allowed long, blocked long", "update", "NoTimeout")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of a sink's updates the last one of each key."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def vote_states(events: DataFrame, decide: Callable) -> DataFrame:
    """Counts of votes by proposal, kept by the stream, with the state that they lead to."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    counts = events.groupBy("user_id").agg(n("click").alias("up"), n("error").alias("down"), n("purchase").alias("backing"))
    return counts.withColumn("state", decide(F.col("up"), F.col("down"), F.col("backing")))
