"""Evidence-weighted review scores of all entities at once. They order records for review; they say nothing about people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scores import EDGE_WEIGHTS, INDICATORS, edge_weight
from millrace.operators.graph import symmetric

TOP_DOCUMENTS = 20


def risk_scores(entities: DataFrame, mentions: DataFrame, edges: DataFrame, indicators: DataFrame) -> DataFrame:
    """(entity, evidence, relations, indicators, score) of entities (entity), mentions (entity, document, weight), edges (a, b, kind), indicators (document, category, value).

    Evidence: the best weight of each of the 20 best documents, a tenth of their sum, up to 2. Relations: weights of the edges of six kinds,
    up to 1.5. Indicators: of each category the largest value times weight, summed, up to 1.5. In all up to 5.
    """
    best = mentions.where("weight IS NOT NULL").groupBy("entity", "document").agg(F.max("weight").alias("w"))
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("w"), "document"))).where(F.col("r") <= TOP_DOCUMENTS)
    evidence = top.groupBy("entity").agg(F.least(F.sum("w") / 10.0, F.lit(2.0)).alias("evidence"))
    kinds = edges.where(F.col("kind").isin(*EDGE_WEIGHTS))
    relations = symmetric(kinds, "a", "b", ("kind",)).groupBy(F.col("src").alias("entity")).agg(F.least(F.sum(edge_weight("kind")), F.lit(1.5)).alias("relations"))
    known = indicators.where(F.col("category").isin(*INDICATORS)).select("document", "category", F.when(F.col("value").rlike(r"^\d+(\.\d+)?$"), F.col("value").try_cast("double")).otherwise(0.0).alias("v"))
    per = mentions.join(known, "document").groupBy("entity", "category").agg(F.max(F.col("v") * F.coalesce("weight", F.lit(0.1))).alias("m"))
    signs = per.groupBy("entity").agg(F.least(F.sum("m"), F.lit(1.5)).alias("indicators"))
    out = entities.select("entity").distinct().join(evidence, "entity", "left").join(relations, "entity", "left").join(signs, "entity", "left").fillna(0.0, ["evidence", "relations", "indicators"])
    total = F.least(F.lit(5.0), F.col("evidence") + F.col("relations") + F.col("indicators"))
    return out.select("entity", F.round("evidence", 3).alias("evidence"), F.round("relations", 3).alias("relations"), F.round("indicators", 3).alias("indicators"), F.round(total, 2).alias("score"))


def explanations(mentions: DataFrame, edges: DataFrame, indicators: DataFrame, documents: int = 5, relations: int = 50) -> DataFrame:
    """What a score is made of: (entity, documents, weights, others, kinds, categories, values), lists in the order of their weight.

    The best documents, the relations that weigh most (the sum is capped at 1.5, so that two or three decide), and each category's largest value. Lists are cut before they are gathered.
    """
    best = mentions.where("weight IS NOT NULL").groupBy("entity", "document").agg(F.max("weight").alias("w"))
    listed = lambda df, order, most, *fields: (
        df.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(*order))).where(F.col("r") <= most).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("r", *fields))).alias("l"))
        .select("entity", *[F.col("l").getField(name).alias(name) for name in fields])
    )
    top = listed(best, (F.desc("w"), "document"), documents, "document", "w")
    linked = symmetric(edges.where(F.col("kind").isin(*EDGE_WEIGHTS)), "a", "b", ("kind",)).select(F.col("src").alias("entity"), F.col("dst").alias("other"), "kind", edge_weight("kind").alias("e"))
    related = listed(linked, (F.desc("e"), "other", "kind"), relations, "other", "kind")
    known = indicators.where(F.col("category").isin(*INDICATORS)).select("document", "category", F.when(F.col("value").rlike(r"^\d+(\.\d+)?$"), F.col("value").try_cast("double")).otherwise(0.0).alias("v"))
    per = mentions.join(known, "document").groupBy("entity", "category").agg(F.round(F.max(F.col("v") * F.coalesce("weight", F.lit(0.1))), 6).alias("value"))
    signs = listed(per, ("category",), len(INDICATORS), "category", "value")
    joined = top.join(related, "entity", "full").join(signs, "entity", "full")
    names = {"document": "documents", "w": "weights", "other": "others", "kind": "kinds", "category": "categories", "value": "values"}
    return joined.select("entity", *[F.coalesce(F.col(k), F.array().cast(dict(joined.dtypes)[k])).alias(v) for k, v in names.items()])
