"""Structure-aware chunks of documents."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.functions.text import chunk_flags


@dataclass(frozen=True)
class Sizes:
    """Characters: chunks hold `most`, a last one under `least` joins the one before, neighbours share `overlap`."""

    least: int = 400
    most: int = 1500
    overlap: int = 100


PAGE = re.compile(r"---\s*Page\s+(\d+)\s*---")
HEADING = re.compile(r"^(#{1,4})\s+(.+)$")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def sections(text: str) -> list[dict]:
    """Sections with title, level, page and body; blank ones go. Page markers set the page and aren't text."""
    found, page = [{"title": "Document Start", "level": 1, "page": 1, "lines": []}], 1
    for line in text.split("\n"):
        if mark := PAGE.search(line):
            page = int(mark[1])
        elif head := HEADING.match(line):
            found.append({"title": head[2].strip(), "level": len(head[1]), "page": page, "lines": []})
        else:
            found[-1]["lines"].append(line)
    out = [s | {"body": "\n".join(s["lines"]).strip()} for s in found]
    return [s for s in out if s["body"]]


def hierarchy(all_sections: list[dict], at: int) -> list[str]:
    """Titles from the top to this section: going back, each that is shallower than all since."""
    path, level = [all_sections[at]["title"]], all_sections[at]["level"]
    for s in reversed(all_sections[:at]):
        if level == 1:
            break
        if s["level"] < level:
            path.append(s["title"])
            level = s["level"]
    return path[::-1]


def pieces(paragraph: str, most: int) -> Iterator[str]:
    """A paragraph, or its sentences packed to the limit; a sentence that is too long is cut hard."""
    if len(paragraph) <= most:
        yield paragraph
        return
    held = ""
    for sentence in SENTENCE.split(paragraph):
        for at in range(0, len(sentence), most):
            part = sentence[at : at + most]
            if held and len(held) + 1 + len(part) > most:
                yield held
                held = part
            else:
                held = f"{held} {part}" if held else part
    if held:
        yield held


def split_section(body: str, sizes: Sizes) -> list[str]:
    """Paragraphs packed to the limit, each chunk after the first with the end of the one before."""
    if len(body) <= sizes.most:
        return [body]
    room, chunks, held = sizes.most - sizes.overlap - 2, [], ""
    for paragraph in re.split(r"\n\s*\n", body):
        for part in pieces(paragraph.strip(), room):
            if held and len(held) + 2 + len(part) > room:
                chunks.append(held)
                held = part
            else:
                held = f"{held}\n\n{part}" if held else part
    if held:
        chunks.append(held)
    if len(chunks) > 1 and len(chunks[-1]) < sizes.least and len(chunks[-2]) + 2 + len(chunks[-1]) <= sizes.most:
        last = chunks.pop()
        chunks[-1] += "\n\n" + last
    tail = lambda s: s[-sizes.overlap :].strip()
    return [c if k == 0 or not sizes.overlap else f"{tail(chunks[k - 1])}\n\n{c}" for k, c in enumerate(chunks)]


def chunk_text(text: str, sizes: Sizes = Sizes()) -> list[dict]:
    out, found = [], sections(text or "")
    for at, s in enumerate(found):
        for content in split_section(s["body"], sizes):
            out.append({"chunk_index": len(out), "content": content, "section_title": s["title"], "page_number": s["page"], "hierarchy_path": hierarchy(found, at), "char_count": len(content), "token_estimate": math.ceil(len(content) / 4)})
    return out


SCHEMA = "chunk_index int, content string, section_title string, page_number int, hierarchy_path array<string>, char_count int, token_estimate int"


def chunk_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks with their flags. Overlap and the last chunk's fate depend on what came before, so that each document is one pass in Python; flags stay in the JVM."""

    return per_document(df, id_col, text, SCHEMA, lambda t: chunk_text(t, sizes)).select("*", *[f.alias(k) for k, f in chunk_flags("content").items()])


def section_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The sections of each document, numbered from 0, with their titles' path."""

    def rows(t: str | None) -> list[dict]:
        found = sections(t or "")
        return [{"section": at, "title": s["title"], "level": s["level"], "page": s["page"], "body": s["body"], "path": hierarchy(found, at)} for at, s in enumerate(found)]

    return per_document(df, id_col, text, "section int, title string, level int, page int, body string, path array<string>", rows)


def per_document(df: DataFrame, id_col: str, text: str, schema: str, rows: Callable[[str | None], list[dict]]) -> DataFrame:
    """id_col and the rows that a function makes of each whole text."""
    full = StructType([df.schema[id_col], *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, made = [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    found = rows(t)
                    own += [k] * len(found)
                    made += found
                columns = [pa.array([m[f.name] for m in made], f.type) for f in list(arrow)[1:]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())).cast(arrow.field(0).type), *columns], schema=arrow)

    return df.select(id_col, text).mapInArrow(run, full)


def document_flags(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A document has a flag if one of its chunks has it."""
    names = list(chunk_flags("content"))
    return chunks.groupBy(id_col).agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in names])
