"""The stages of enrichment: which depend on which, which documents need them, what they cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages with what they depend on and their cost a page.
STAGES: dict[str, tuple[tuple[str, ...], float]] = {
    "ocr": ((), 0.0015),
    "classify": (("ocr",), 0.0002),
    "chunk": (("ocr",), 0.0),
    "contextual_headers": (("chunk",), 0.0005),
    "embed": (("contextual_headers",), 0.0001),
    "visual_embed": (("ocr",), 0.0003),
    "entity_extract": (("chunk",), 0.001),
    "relationship_map": (("entity_extract",), 0.0008),
    "redaction_detect": (("chunk",), 0.0005),
    "timeline_extract": (("entity_extract",), 0.0005),
    "summarize": (("entity_extract",), 0.0003),
    "criminal_indicators": (("entity_extract", "relationship_map"), 0.0008),
    "email_extract": (("entity_extract",), 0.0006),
    "financial_extract": (("entity_extract",), 0.0006),
    "co_flight_links": (("email_extract", "entity_extract"), 0.0),
    "congressional_score": (("criminal_indicators", "redaction_detect"), 0.0),
    "subpoena_extract": (("classify", "chunk"), 0.0),
    "network_metrics": (("co_flight_links",), 0.0),
    "risk_score": (("criminal_indicators", "network_metrics"), 0.0),
}
LETTERS = ("correspondence", "email", "letter", "memo", "fax")
MONEY = ("financial_record", "tax_filing", "trust_document", "corporate_filing", "receipt_invoice")
DATED = ("flight_log", "phone_record", "calendar_schedule", "deposition", "police_report", "fbi_report")


def ordered(stages: dict[str, tuple[tuple[str, ...], float]] = STAGES) -> list[str]:
    """Stages after all that they depend on; a cycle or an unknown name is an error."""
    out: list[str] = []

    def put(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"cycle at {name}")
        if name not in stages:
            raise ValueError(f"unknown stage {name}")
        if name not in out:
            for d in stages[name][0]:
                put(d, (*above, name))
            out.append(name)

    for name in stages:
        put(name, ())
    return out


def _has(kind: Column, tags: Column, kinds: tuple[str, ...]) -> Column:
    return kind.isin(*kinds) | F.arrays_overlap(tags, F.array(*map(F.lit, kinds)))


def routing(kind: Column, tags: Column, flags: dict[str, Column]) -> dict[str, Column]:
    """For each stage whether a document needs it; those without a condition run for all."""
    rules = {
        "visual_embed": _has(kind, tags, ("photograph",)),
        "redaction_detect": flags["has_redaction_markers"],
        "timeline_extract": _has(kind, tags, DATED) | flags["has_date_references"],
        "email_extract": _has(kind, tags, LETTERS) | flags["has_email_headers"],
        "financial_extract": _has(kind, tags, MONEY) | flags["has_financial_amounts"],
        "co_flight_links": _has(kind, tags, ("flight_log", *LETTERS)) | flags["has_email_headers"],
        "subpoena_extract": _has(kind, tags, ("subpoena",)),
    }
    return {s: rules.get(s, F.lit(True)) for s in STAGES}


def with_stage(done: Column, stage: str) -> Column:
    return F.array_union(F.coalesce(done, F.array().cast("array<string>")), F.array(F.lit(stage)))


def process(docs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], needs: dict[str, Column], done: str = "completed_stages") -> DataFrame:
    """Each stage, in order, over all documents that need it, lack it and have what it depends on; a handler keeps the columns. Documents that don't need a stage pass it."""
    for stage in ordered():
        if stage not in handlers:
            continue
        waiting = needs.get(stage, F.lit(True)) & ~F.array_contains(done, stage)
        for d in STAGES[stage][0]:
            if d in handlers:
                waiting = waiting & (F.array_contains(done, d) | ~needs.get(d, F.lit(True)))
        waiting = F.coalesce(waiting, F.lit(False))
        ran = handlers[stage](docs.where(waiting)).withColumn(done, with_stage(F.col(done), stage))
        docs = ran.unionByName(docs.where(~waiting))
    return docs


def costs(pages: Column, needed: dict[str, Column]) -> Column:
    """What the stages that a document needs cost for its pages."""
    return sum((F.when(n, pages * F.lit(STAGES[s][1])).otherwise(0.0) for s, n in needed.items()), F.lit(0.0))
