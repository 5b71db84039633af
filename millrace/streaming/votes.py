"""Votes on proposals as an ordered process: who may vote, what a changed vote does, and when an item is backed or settled.

State is kept by item: its status, the vote of each (proposal, voter), the counts of each proposal, and votes that wait until the watermark has passed them, so
that they count in the order of their time however they arrive. A timer wakes an item for the earliest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Backers that make an item corroborated, and what settles it.
CORROBORATED, LEAST_VOTES, MOST_DOWN = 3, 7, 0.25
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUTCOME = "item long, status string, winner long, corroborated_by long, settled_by long, counted long, own long, late long"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, as several states of a key ask for."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class VoteProcessor(StatefulProcessor):
    """Rows: item, vote_id, proposal, author, voter, vote (up, down or backing), at. Gives OUTCOME, a row each time votes of an item were counted."""

    def init(self, handle) -> None:
        self._handle = handle
        self._facts = handle.getValueState("facts", "status string, winner long, corroborated_by long, settled_by long, counted long, own long, late long")
        self._waiting = handle.getListState("waiting", "at long, vote_id long, proposal long, author long, voter long, vote string")
        self._votes = handle.getMapState("votes", "proposal long, voter long", "vote string")
        self._counts = handle.getMapState("counts", "proposal long", "up long, down long, backing long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            times = part["at"].astype("datetime64[us]").astype("int64")
            self._waiting.appendList(list(zip(times.tolist(), part["vote_id"].tolist(), part["proposal"].tolist(), part["author"].tolist(), part["voter"].tolist(), part["vote"].tolist(), strict=True)))
            least = int(times.min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self._waiting.get()) if self._waiting.exists() else []
        due, rest = sorted(v for v in held if v[0] <= upto), [v for v in held if v[0] > upto]
        if rest:
            self._waiting.put(rest)
            self._handle.registerTimer(-(-min(v[0] for v in rest) // 1000))
        else:
            self._waiting.clear()
        if not due:
            return iter(())
        facts = self._facts.get() if self._facts.exists() else ("unsolved", None, None, None, 0, 0, 0)
        for vote in due:
            facts = self._count(facts, vote)
        self._facts.update(facts)
        return iter([pd.DataFrame([(key[0], *facts)], columns=["item", "status", "winner", "corroborated_by", "settled_by", "counted", "own", "late"]).astype({c: "Int64" for c in ("winner", "corroborated_by", "settled_by")})])

    def _count(self, facts: tuple, vote: tuple) -> tuple:
        status, winner, backed, settled, counted, own, late = facts
        _, vote_id, proposal, author, voter, kind = vote
        if status == "confirmed":
            return (*facts[:6], late + 1)
        if voter == author:
            return (*facts[:5], own + 1, late)
        counts = dict(zip(("up", "down", "backing"), self._counts.getValue((proposal,)) if self._counts.containsKey((proposal,)) else (0, 0, 0), strict=True))
        if self._votes.containsKey((proposal, voter)):
            counts[self._votes.getValue((proposal, voter))[0]] -= 1
        counts[kind] += 1
        self._votes.updateValue((proposal, voter), (kind,))
        self._counts.updateValue((proposal,), (counts["up"], counts["down"], counts["backing"]))
        if counts["backing"] >= CORROBORATED:
            if status == "unsolved":
                status, backed = "corroborated", vote_id
            total = sum(counts.values())
            if total >= LEAST_VOTES and counts["down"] <= MOST_DOWN * total:
                status, winner, settled = "confirmed", proposal, vote_id
        return status, winner, backed, settled, counted + 1, own, late


def outcomes(votes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """OUTCOME by item, in update mode, of a stream of votes; those that the watermark has not passed yet wait."""
    timed = votes.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("item").transformWithStateInPandas(VoteProcessor(), OUTCOME, "Update", "EventTime")
