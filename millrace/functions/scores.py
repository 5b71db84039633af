"""Scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col, lookup

# Edge kinds that count for review, and kinds of indicators.
EDGE_WEIGHTS = {"victim_of": 1.0, "recruited_by": 1.0, "co_defendant": 0.8, "witness_testimony": 0.5, "financial_connection": 0.4, "traveled_with": 0.3}
INDICATORS = ("trafficking", "obstruction", "conspiracy", "financial_crimes", "witness_tampering", "exploitation")


def edge_weight(kind: Column | str) -> Column:
    return lookup(col(kind), EDGE_WEIGHTS, 0.0)


def proposal_confidence(up: Column, down: Column, backing: Column, length_known: Column, length_match: Column, context: Column, graph: Column) -> Column:
    """Votes up to 0.3, length 0.15, context up to 0.35, graph up to 0.2. It can be negative."""
    u, d, b = (F.coalesce(c, F.lit(0)) for c in (up, down, backing))
    votes = F.least((u + b * 2 - d).cast("double") / F.greatest(u + d + b, F.lit(1)).cast("double"), F.lit(1.0)) * 0.3
    length = F.when(length_known & F.coalesce(length_match, F.lit(False)), 0.15).otherwise(0.0)
    return votes + length + F.coalesce(context, F.lit(0.0)) * 0.35 + F.coalesce(graph, F.lit(0.0)) * 0.2


def length_match(text: Column, estimate: Column, slack: int = 3) -> Column:
    """Null without an estimate."""
    return F.abs(F.length(text) - estimate) <= slack


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def priority_score(text: Column | str, keywords: dict[str, float], near: tuple[str, ...], redactions: Column, persons: Column, officials: Column) -> Column:
    """Keywords 0.3, density of redactions (those of persons twice) 0.4, phrases that tell of a redacted person 0.3, officials up to 0.2; in all up to 1.

    keywords: weights by pattern; near: patterns of phrases; both are parameters, and looked for in any case.
    """
    c = F.lower(F.coalesce(col(text), F.lit("")))
    hits = reduce(lambda a, b: a + b, [count_of(c, rf"\b{k}\b") * F.lit(float(w)) for k, w in keywords.items()])
    phrases = reduce(lambda a, b: a + b, [count_of(c, p) for p in near])
    whole = (
        0.3 * F.least(F.lit(1.0), hits / 50.0)
        + 0.4 * F.least(F.lit(1.0), (F.coalesce(redactions, F.lit(0)) + F.coalesce(persons, F.lit(0))) / 20.0)
        + 0.3 * F.least(F.lit(1.0), phrases / 5.0)
        + F.least(F.lit(0.2), 0.05 * F.coalesce(officials, F.lit(0)))
    )
    return F.least(F.lit(1.0), whole)


def evidence_strength(n: Column) -> Column:
    """min(10, 1 + ln n)."""
    return F.least(F.lit(10.0), 1.0 + F.ln(n.cast("double")))
