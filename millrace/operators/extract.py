"""Extraction from texts and from models' answers: pages, riders, JSON, transcripts, images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.text import target_kind

# Page markers, headers of riders, statutes and numbered items.
PAGE_MARK = r"---\s*Page\s+\d+\s*---"
RIDER = r"(?i)RIDER\s*\(Grand\s+Jury\s+Subpoena\s+to\s+(.+?),\s*dated\s+(.+?)\)"
STATUTE = r"(?:18|21|26|28|31)\s+U\.S\.C\.\s*§\s*\d+(?:\([a-z]\))?"
ITEM = r"(?m)^\s*\d+\.\s+(.+)"


def split_pages(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, page, text): parts between page markers that aren't blank, numbered from 1; the markers' own numbers don't count."""
    parts = F.filter(F.transform(F.split(text, PAGE_MARK), lambda p: F.btrim(p, F.lit("\n "))), lambda p: p != "")
    return df.select(id_col, F.posexplode(parts).alias("page", "text")).select(id_col, (F.col("page") + 1).alias("page"), "text")


def classification(answer: Column, kinds: tuple[str, ...]) -> Column:
    """(kind, confidence, tags) from a model's JSON: unknown kinds are other, confidence is held to 0..1, tags need 0.3; no JSON: other, 0.3."""
    parsed = F.from_json(answer, "type string, confidence double, tags array<struct<type: string, confidence: double>>")
    known = parsed["type"].isin(*kinds)
    kind = F.when(known, parsed["type"]).otherwise("other")
    ok = parsed["type"].isNotNull()
    tags = F.transform(F.filter(parsed["tags"], lambda x: (x["confidence"] >= 0.3) & x["type"].isin(*kinds) & (x["type"] != kind)), lambda x: x["type"])
    confidence = F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["confidence"], F.lit(0.3))))).otherwise(0.3)
    return F.struct(F.when(ok, kind).otherwise("other").alias("kind"), confidence.alias("confidence"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))


def prompt_tiers(kind: Column, confidence: Column, tags: Column, tiers: dict[str, str], default: str = "default") -> Column:
    """The tier of a kind's prompt and up to two others of its tags; a confidence under 0.3 takes the default."""
    table = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])
    first = F.when(confidence < 0.3, default).otherwise(F.coalesce(F.try_element_at(table, kind), F.lit(default)))
    others = F.filter(F.array_distinct(F.array_compact(F.transform(tags, lambda x: F.try_element_at(table, x)))), lambda x: x != first)
    return F.struct(first.alias("tier"), F.slice(others, 1, 2).alias("others"))


def post_filter(df: DataFrame, kinds: tuple[str, ...], junk: Column, weight: Column) -> DataFrame:
    """Extracted entities (kind, name, confidence, ...) of known kinds, with confidence held to 0..1 and at least 0.5, that aren't junk, with their evidence weight."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    kept = df.withColumn("confidence", held).where(F.col("kind").isin(*kinds) & (F.col("confidence") >= 0.5) & ~junk)
    return kept.withColumn("evidence_weight", weight * F.col("confidence"))


def prescreen_media(has_audio: Column, has_video: Column, width: Column, height: Column, seconds: Column) -> Column:
    """What a recording is worth: no_audio, surveillance (small pictures, long), speech (short, or no pictures), other."""
    return F.when(~has_audio, "no_audio").when((width <= 640) & (height <= 480) & (seconds > 3000), "surveillance").when((seconds < 600) | ~has_video, "speech").otherwise("other")


def transactions(answer: Column, kinds: tuple[str, ...]) -> Column:
    """A model's list of transfers: unknown kinds are other, an amount that is no number is null, the currency defaults to USD."""
    parsed = F.from_json(answer, "array<struct<from: string, to: string, amount: string, currency: string, type: string>>")
    return F.transform(parsed, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["amount"].try_cast("decimal(15,2)").alias("amount"), F.coalesce(x["currency"], F.lit("USD")).alias("currency"), F.when(x["type"].isin(*kinds), x["type"]).otherwise("other").alias("type")))


def riders(df: DataFrame, id_col: str, text: str, pages: str) -> DataFrame:
    """Rider sections: target, its kind, date, statutes in order without repeats, numbered items of 6 to 499 characters, pages by place in the text.

    A section runs from its header to the next or the end. A text without headers that has statutes or items gives one row, with up to 20 items.
    """
    c = F.col(text)
    marked = F.regexp_replace(c, RIDER, "\u0001$0")
    parts = F.split(marked, "\u0001")
    sections = df.select(id_col, pages, text, F.posexplode(parts).alias("_i", "_s"), F.transform(parts, lambda p: F.length(p)).alias("_n"))
    start = F.aggregate(F.slice("_n", F.lit(1), F.col("_i")), F.lit(0), lambda a, x: a + x)
    per_page = F.length(c) / F.greatest(F.col(pages), F.lit(1))
    statutes = lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit(STATUTE), F.lit(0)))
    items = lambda s: F.filter(F.transform(F.regexp_extract_all(s, F.lit(ITEM), F.lit(1)), lambda x: F.trim(x)), lambda x: (F.length(x) > 5) & (F.length(x) < 500))
    s = F.col("_s")
    named = F.trim(F.regexp_extract(s, RIDER, 1))
    found = sections.where("_i > 0").select(
        id_col, named.alias("target"), target_kind(named).alias("target_kind"), F.nullif(F.trim(F.regexp_extract(s, RIDER, 2)), F.lit("")).alias("dated"), statutes(s).alias("statutes"), items(s).alias("items"),
        (F.floor(start / per_page) + 1).cast("int").alias("first_page"), F.least(F.col(pages), (F.floor((start + F.length(s)) / per_page) + 1).cast("int")).cast("int").alias("last_page"),
    )
    bare = df.where(~c.rlike(RIDER)).where((F.size(statutes(c)) > 0) | (F.size(items(c)) > 0))
    rest = bare.select(
        id_col, F.lit("unknown").alias("target"), F.lit("other").alias("target_kind"), F.nullif(F.regexp_extract(c, r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}", 0), F.lit("")).alias("dated"),
        statutes(c).alias("statutes"), F.slice(items(c), 1, 20).alias("items"), F.lit(1).alias("first_page"), F.col(pages).cast("int").alias("last_page"),
    )
    return found.unionByName(rest)


def pack_segments(df: DataFrame, key: str, start: str, end: str, text: str, most: int = 1000) -> DataFrame:
    """Transcript chunks (key, chunk, start, end, text): segments in order, joined by spaces until more than `most` characters are there.

    A fold over each recording's ordered segments, which pass by one after the other; only the chunk that is open is held. A chunk ends where
    the next segment starts, the last one at its own end.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

    rows = df.select(F.col(key).alias("k"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = StructType([StructField("k", rows.schema["k"].dataType), StructField("chunk", IntegerType()), StructField("s", DoubleType()), StructField("e", DoubleType()), StructField("t", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own, number, began, ended, held = True, None, 0, 0.0, 0.0, ""
        for batch in batches:
            out: list[tuple] = []
            for k, s, e, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or k != own:
                    if held:
                        out.append((own, number, began, ended, held))
                    first, own, number, held = False, k, 0, ""
                joined = f"{held} {t}" if held else t
                if held and len(joined) > most:
                    out.append((own, number, began, s, held))
                    number, held = number + 1, ""
                if not held:
                    began = s
                held, ended = f"{held} {t}" if held else t, e
            if out:
                yield as_batch(out)
        if held:
            yield as_batch([(own, number, began, ended, held)])

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(k).type) for k, c in enumerate(zip(*out, strict=True))], schema=arrow)

    arrow = to_arrow_schema(schema)
    packed = rows.repartition("k").sortWithinPartitions("k", "s", "e", "t").mapInArrow(run, schema)
    return packed.toDF(key, "chunk", "start", "end", "text")


def dark_bars(df: DataFrame, id_col: str, image: str, width: str, height: str) -> DataFrame:
    """(id_col, found, ratio, rows, confidence) of grey images, one byte a pixel: dark is under 30, a dark row is more than half dark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, raw, w, h in batch.itertuples(index=False):
                dark = np.frombuffer(raw, np.uint8)[: w * h].reshape(h, w) < 30
                ratio, rows = float(dark.mean()), int((dark.mean(axis=1) > 0.5).sum())
                out.append((id_, ratio > 0.01 and rows >= 5, ratio, rows, min(1.0, 10 * ratio + rows / 100)))
            yield pd.DataFrame(out, columns=[id_col, "found", "ratio", "rows", "confidence"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, image, width, height).mapInPandas(run, f"{id_col} {kind}, found boolean, ratio double, rows int, confidence double")


def header_inputs(chunks: DataFrame, document: str, order: str, text: str, summaries: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """chunks with input: what a model is asked a chunk's header from: the document's summary (document, summary) where it has one, the chunk's number of how many, and its first `most` characters."""
    n = chunks.groupBy(document).agg(F.count(F.lit(1)).alias("_n"))
    numbered_ = chunks.withColumn("_i", F.row_number().over(Window.partitionBy(document).orderBy(order)))  # the chunks of one document
    joined = numbered_.join(n, document)
    joined = joined.join(summaries.select(document, F.col("summary").alias("_summary")), document, "left") if summaries is not None else joined.withColumn("_summary", F.lit(None).cast("string"))
    about = F.when(F.col("_summary").isNotNull(), F.concat(F.lit("Document summary: "), "_summary", F.lit("\n\n"))).otherwise("")
    whole = F.concat(about, F.lit("Chunk "), "_i", F.lit(" of "), "_n", F.lit(":\n"), F.substring(text, 1, most))
    return joined.withColumn("input", whole).drop("_i", "_n", "_summary")
