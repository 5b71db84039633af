"""Load files, logs, messages and listings as DataFrames of lines or of whole files. Nothing is read by the driver."""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.dates import parse_date
from millrace.functions.text import col
from millrace.operators.graph import cut

# The delimiters of DAT files.
QUOTE, FIELD = "þ", "þ\u0014þ"


def numbered_lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """(file, line_no, line) of text files of any size, lines without text left out; numbers count all lines of a file from 0, or those of all files in the order of their paths.

    A large file is read in splits at line ends. A line's number is its place in its split, and the lines of the splits before it: one row a split (128 MB, say) is
    summed up and sent to all tasks; the lines themselves stay where they are read.
    """
    where = F.col("_metadata")
    lines = spark.read.text(path).select(where["file_path"].alias("file"), where["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    order = (Window.orderBy("file", "start") if across else Window.partitionBy("file").orderBy("start")).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(splits.select("file", "start", (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("first")).alias("_shift")))
    return lines.join(F.broadcast(starts), ["file", "start"]).select("file", (F.col("at") + F.col("_shift")).alias("line_no"), "line").where("line <> ''")


def csv_fields(line: Column | str) -> Column:
    """Fields of a comma-separated line, trimmed; quotes toggle, and doubled quotes aren't an escape."""
    return F.transform(F.split(col(line), r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda f: F.trim(F.replace(f, F.lit('"'), F.lit(""))))


def opt_rows(lines: DataFrame) -> DataFrame:
    """(file, line_no, bates, volume, path, starts, pages) of OPT lines; lines of fewer than four fields go."""
    f = lines.withColumn("f", csv_fields("line")).where(F.size("f") >= 4)
    number = lambda k: F.get("f", F.lit(k)).try_cast("int")
    return f.select("file", "line_no", F.get("f", F.lit(0)).alias("bates"), F.get("f", F.lit(1)).alias("volume"), F.replace(F.get("f", F.lit(2)), F.lit("\\"), F.lit("/")).alias("path"), (F.upper(F.get("f", F.lit(3))) == "Y").alias("starts"), F.coalesce(number(6), number(5), F.lit(1)).alias("pages"))


def opt_documents(rows: DataFrame) -> DataFrame:
    """(file, doc_no, first, last, pages): a row with the flag starts a document; rows before the first flag are one too.

    The flags so far are summed within ranges of lines, and over the ranges: a file may be of any length.
    """
    ranged = cut(rows.select("file", "line_no", "bates", F.col("starts").cast("int").alias("starts")).repartitionByRange("file", "line_no").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("file", "_range").agg(F.sum("starts").alias("_n"))
    ranges = totals.select("file", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("file", "_range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = ranged.withColumn("_own", F.sum("starts").over(within)).join(ranges, ["file", "_range"]).withColumn("doc_no", F.col("_before") + F.col("_own"))
    return grouped.groupBy("file", "doc_no").agg(F.min_by("bates", "line_no").alias("first"), F.max_by("bates", "line_no").alias("last"), F.count(F.lit(1)).alias("pages"))


def dat_fields(line: Column | str) -> Column:
    c = F.regexp_replace(col(line), f"^﻿?{QUOTE}|{QUOTE}\\s*$", "")
    return F.split(c, FIELD, -1)


def dat_records(lines: DataFrame, header: list[str]) -> DataFrame:
    """DAT lines without the header line as columns; missing last values are ''."""
    f = lines.where(F.trim("line") != "").withColumn("f", dat_fields("line"))
    return f.select("file", "line_no", *[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(name.strip()) for i, name in enumerate(header)])


def json_records(texts: DataFrame, text: str, schema: str) -> DataFrame:
    """Records of whole files: JSON lines if there are several lines and the first starts with {, else an array or one object. Bad lines go."""
    c = F.trim(F.col(text))
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != "")
    jsonl = (F.size(lines) > 1) & F.startswith(F.ltrim(F.get(lines, F.lit(0))), F.lit("{")) & F.endswith(F.rtrim(F.get(lines, F.lit(0))), F.lit("}"))
    one = lambda x: F.from_json(x, schema, {"mode": "PERMISSIVE"})
    array = F.from_json(F.when(F.startswith(c, F.lit("[")), c).otherwise(F.concat(F.lit("["), c, F.lit("]"))), f"array<struct<{_as_struct(schema)}>>")
    rows = texts.select(*[x for x in texts.columns if x != text], F.explode(F.when(jsonl, F.transform(F.filter(lines, lambda x: F.try_parse_json(x).isNotNull()), one)).otherwise(array)).alias("r"))
    return rows.select(*[x for x in texts.columns if x != text], "r.*")


def _as_struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def first_field(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of these columns that df has and that isn't null or ''."""
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def variant_field(value: Column, names: tuple[str, ...], under: tuple[str, ...] = ("", "data", "attributes")) -> Column:
    """The first of these names in a variant, at the top or inside data or attributes."""
    paths = [f"$.{u}.{n}" if u else f"$.{n}" for n in names for u in under]
    return F.coalesce(*[F.nullif(F.try_variant_get(value, p, "string"), F.lit("")) for p in paths])


def person_list(text: Column | str) -> Column:
    """A list of names from a JSON array, else split at ; and else at commas."""
    c = F.trim(col(text))
    parsed = F.from_json(c, "array<string>")
    split = F.when(c.contains(";"), F.split(c, ";")).otherwise(F.split(c, ","))
    return F.filter(F.transform(F.when(F.startswith(c, F.lit("[")) & parsed.isNotNull(), parsed).otherwise(split), lambda x: F.trim(x)), lambda x: x != "")


def flight_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, day, departure, arrival, tail, passengers) of delimited flight logs; lines without a date go."""
    f = lines.withColumn("f", F.transform(F.split("line", r"[\t,|]"), lambda x: F.trim(x)))
    day = parse_date(F.get(F.filter("f", lambda x: x.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$")), F.lit(0)))
    places = F.filter("f", lambda x: x.rlike(r"^[A-Z]{3}$"))
    tail = F.nullif(F.regexp_extract("line", r"\b(N\d+[A-Z]*)\b", 1), F.lit(""))
    people = F.filter("f", lambda x: x.rlike(r"^[A-Za-z .'-]{4,}$"))
    return f.select("file", "line_no", day.alias("day"), F.get(places, F.lit(0)).alias("departure"), F.get(places, F.lit(1)).alias("arrival"), tail.alias("tail"), people.alias("passengers")).where("day IS NOT NULL")


def messages(texts: DataFrame, text: str) -> DataFrame:
    """Messages with headers up to the first blank line: from, to and cc as lists, subject, date as written, body."""
    c = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    head, body = F.split_part(c, F.lit("\n\n"), F.lit(1)), F.when(F.instr(c, "\n\n") > 0, F.substring(c, F.instr(c, "\n\n") + 2, F.length(c)))
    one = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}\s*:(.*)$", 1)), F.lit(""))
    many = lambda name: F.filter(F.transform(F.split(F.coalesce(one(name), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    keep = [x for x in texts.columns if x != text]
    return texts.select(*keep, one("from").alias("from"), many("to").alias("to"), many("cc").alias("cc"), one("subject").alias("subject"), one("date").alias("date"), F.coalesce(body, F.lit("")).alias("body"))


def listing(lines: DataFrame) -> DataFrame:
    """(path, size, modified) of object-store listings; a bare path has size 0."""
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+(\d+)\s+(.+)$"
    full = F.col("line").rlike(pattern)
    get = lambda k: F.regexp_extract("line", pattern, k)
    return lines.select(F.when(full, get(3)).otherwise(F.trim("line")).alias("path"), F.when(full, get(2).try_cast("long")).otherwise(F.lit(0).cast("long")).alias("size"), F.when(full, F.try_to_timestamp(get(1))).alias("modified"))


# Extensions by kind.
EXTENSIONS = {"image": ("jpg", "jpeg", "png", "gif", "tif", "tiff", "bmp", "webp"), "video": ("mp4", "mov", "avi", "mkv", "wmv", "m4v", "mpg"), "audio": ("mp3", "wav", "m4a", "aac", "ogg", "flac", "wma")}


def media_kind(path: Column | str) -> Column:
    """image, video, audio or null by extension; .ts is video only under /NATIVES/."""
    c = col(path)
    ext = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when((ext == "ts") & c.contains("/NATIVES/"), "video")
    for kind, known in EXTENSIONS.items():
        out = out.when(ext.isin(*known), kind)
    return out


def walk(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, extension) of all files under a folder; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.nullif(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), extension.alias("extension"))


def from_footers(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of which count(*), and min and max of plain columns without a filter, are taken from the files' footers: no row is read."""
    listed, key = spark.conf.get("spark.sql.sources.useV1SourceList"), "spark.sql.sources.useV1SourceList"
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(key, ",".join(x for x in listed.split(",") if x != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(key, listed)


def manifest(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(path, size, sha256) of files; those in known (path) are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if known is not None:
        files = files.join(known.select("path"), "path", "left_anti")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def entities_and_flights(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Of files with one JSON record or an array of them: entities (name, entity_type, location) and flights (flight_date, departure, arrival, passengers). A record may be both."""
    keep = [x for x in texts.columns if x != text]
    kind = ", ".join(f"{k} string" for k in ("name", "person", "entity_type", "location", "flight_date", "date", "departure", "from", "arrival", "to")) + ", passengers array<string>, manifest array<string>"
    c = F.trim(F.col(text))
    array = F.from_json(F.when(F.startswith(c, F.lit("[")), c).when(F.startswith(c, F.lit("{")), F.concat(F.lit("["), c, F.lit("]"))), f"array<struct<{_as_struct(kind)}>>")
    r = texts.select(*keep, F.explode(array).alias("r")).select(*keep, "r.*")
    either = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    entities = r.select(*keep, either("name", "person").alias("name"), F.coalesce("entity_type", F.lit("person")).alias("entity_type"), "location").where("name IS NOT NULL")
    people = F.coalesce("passengers", "manifest", F.array().cast("array<string>")).alias("passengers")
    return entities, r.select(*keep, either("flight_date", "date").alias("flight_date"), either("departure", "from").alias("departure"), either("arrival", "to").alias("arrival"), people).where("flight_date IS NOT NULL")


def local_path(path: str) -> str:
    """What sqlite3 opens: a path of a shared file system that every machine mounts."""
    return re.sub(r"^file:/+", "/", path)


def write_sqlite(rows: DataFrame, folder: str) -> DataFrame:
    """(path) of SQLite files in a mounted folder, one a task, with the rows (table, column, name); a file has its name only once it is whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(local_path(folder), exist_ok=True)
        path = f"{local_path(folder)}/{uuid.uuid4().hex}.db"
        db = sqlite3.connect(path + ".part")
        for batch in batches:
            for (table, column), part in batch.groupby(["table", "column"]):
                db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ("{column}" TEXT)')
                db.executemany(f'INSERT INTO "{table}" VALUES (?)', [(x,) for x in part["name"]])
        db.commit()
        db.close()
        os.rename(path + ".part", path)
        yield pd.DataFrame({"path": [path]})

    from millrace.operators.graph import cut

    return cut(rows.mapInPandas(run, "path string"))


def sqlite_names(spark: SparkSession, paths: str | DataFrame, wanted: str = "entit|person|organization") -> DataFrame:
    """(table, name) of the tables of SQLite files (a path, or rows of path) whose name fits; tasks open the files, which must be on paths that they see."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch["path"]:
                with sqlite3.connect(local_path(p)) as db:
                    for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'").fetchall():
                        if not re.search(wanted, table, re.I):
                            continue
                        columns = [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]
                        name = next((k for k in ("name", "full_name", "entity", "title") if k in columns), None)
                        if name:
                            rows = db.execute(f'SELECT "{name}" FROM "{table}"')
                            while part := rows.fetchmany(10_000):
                                yield pd.DataFrame({"table": table, "name": [r[0] for r in part]})

    files = spark.createDataFrame([(paths,)], "path string") if isinstance(paths, str) else paths
    return files.mapInPandas(run, "table string, name string")
