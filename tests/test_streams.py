"""Votes that come out of order, again, too late or from the proposal's own author, with the query stopped and started between files."""

import random

from pyspark.sql import functions as F

from millrace.shared import new_folder
from millrace.streaming import votes

SCHEMA = "vote_id long, item long, proposal long, author long, voter long, vote string, at timestamp"


def simulated(log, upto):
    """The outcome by item of all votes up to a time, in its order."""
    out, votes_of = {}, {}
    for vote_id, item, proposal, author, voter, kind, at in sorted(log, key=lambda v: (v[6], v[0])):
        if at > upto:
            continue
        o = out.setdefault(item, {"status": "unsolved", "winner": None, "corroborated_by": None, "settled_by": None, "counted": 0, "own": 0, "late": 0})
        if o["status"] == "confirmed":
            o["late"] += 1
        elif voter == author:
            o["own"] += 1
        else:
            mine = votes_of.setdefault(proposal, {})
            mine[voter] = kind
            o["counted"] += 1
            n = {k: list(mine.values()).count(k) for k in ("up", "down", "backing")}
            if n["backing"] >= 3 and o["status"] == "unsolved":
                o |= {"status": "corroborated", "corroborated_by": vote_id}
            if n["backing"] >= 3 and len(mine) >= 7 and n["down"] <= 0.25 * len(mine):
                o |= {"status": "confirmed", "winner": proposal, "settled_by": vote_id}
    return out


def test_votes_in_order_of_time(spark, tmp_path):
    rng, log = random.Random(6), []
    base = 1_700_000_000
    for k in range(400):
        item = rng.randrange(6)
        log.append((k, item, item * 2 + rng.randrange(2), item + 100, rng.choice([item + 100, *range(12)]), rng.choice(["up", "up", "down", "backing", "backing"]), base + k * 60 + rng.random() * 10))
    shuffled = [log[i : i + 100] for i in range(0, 400, 100)]
    for part in shuffled:
        rng.shuffle(part)
    for a, b in zip(shuffled, shuffled[1:], strict=False):  # votes that arrive a file late, within the hour that is allowed
        early = [v for v in a if v[6] > max(x[6] for x in a) - 1200][:10]
        for v in early:
            a.remove(v)
            b.append(v)
    folder, where = tmp_path / "in", new_folder(spark, "votes")

    def write(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{where}/out/run={n}")

    for k, part in enumerate(shuffled):
        rows = [(*v[:6], v[6]) for v in part]
        df = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "double")).withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
        df.coalesce(1).write.parquet(f"{folder}/{k}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(folder))
        with votes.rocksdb(spark):
            query = votes.outcomes(stream, "1 hour").writeStream.outputMode("update").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(write).start()
            query.awaitTermination()
    upto = max(v[6] for v in log) - 3600
    upto = int(upto * 1000) / 1000
    last = spark.read.parquet(f"{where}/out").groupBy("item").agg(F.max_by(F.struct(*[c for c in votes.OUTCOME.replace(" long", "").replace(" string", "").split(", ") if c != "item"]), "batch").alias("o")).collect()
    assert {r.item: r.o.asDict() for r in last} == simulated(log, upto)
    assert {o["status"] for o in simulated(log, upto).values()} >= {"confirmed"}
