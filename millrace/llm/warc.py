"""WARC archives: an index first, then coalesced reads of the selected records.

Writing gives every page a record in a gzip member of its own, after a warcinfo record a file, and an index row: file, offset, length, URL, digest. Of records with equal
payloads of at least LEAST bytes the one with the largest id holds the payload (response); the others point to it (revisit). A response is an HTTP
message, header and payload; digests are of the payload. Record ids are UUIDs made of the file's name and the record's place.
Reading takes index rows, sorts them by file and offset, joins ranges that touch or lie near, reads each range once, and takes the
records out of it. Files are written under a name of the attempt's own and then renamed, so that a task that runs again, or twice,
leaves one whole file; the index is a Parquet table, which is complete or not there.

Only payloads that a Bloom filter of the repeated digests passes are moved; readers are as many as the archive's bytes ask for.
Files lie in the shared folder, and are reached through pyarrow's file systems.

Defined cases: a null payload is empty, a null URL stays null in the index and gives a record without WARC-Target-URI. Ids are of any type that
strings can be cast to; line ends in them and in URLs are escaped in records. Rows that repeat an id are records each; of repeated rows with the
largest id the response is every one. A null id is absent in the record and sorts before all others. Empty tables give empty archives.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import named, new_path, slices, table, written
from millrace.llm.urlfilter import build_filter, maybe_listed

LEAST = 1000
#: Ranges of a file that are at most this far apart are read together, up to READ bytes at once.
GAP, READ = 1 << 16, 8 << 20
#: A writer starts a new file after so many bytes; a reader task takes about so many.
FILE_BYTES, READER_BYTES = 32 << 20, 8 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def escaped(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unescaped(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(kind: str, name: str, fields: dict[str, str], block: bytes, content: str) -> bytes:
    """A WARC/1.1 record; name: what its id is made of."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>", f"WARC-Date: {DATE}"]
    head += [f"{k}: {v}" for k, v in fields.items()]
    head += [f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(kind: str, name: str, id_: str | None, url: str | None, payload: bytes, digest: str, full: int, refers_to: str | None) -> bytes:
    """A page's record: an HTTP message, of which a revisit has only the header."""
    fields = {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(full)}
    if id_ is not None:
        fields["X-Page-ID"] = escaped(id_)
    if url is not None:
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if kind == "revisit":
        fields |= {"WARC-Profile": REVISIT, "X-Refers-To-Page-ID": escaped(refers_to)}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    return record(kind, name, fields, http + (payload if kind == "response" else b""), "application/http; msgtype=response")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The header's fields, and the payload: what follows the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def zipped(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """id, url, payload, digest, n, kind, refers_to. Digests are aggregated; only payloads that may repeat are joined to the row that keeps them."""
    raw = F.coalesce(named(payload), F.lit("")).cast("binary")
    rows = pages.select(named(id_col).alias("id"), named(url).alias("url"), raw.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    known = F.struct(F.col("id").isNotNull().alias("known"), "id")
    long_ = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max(known).alias("k"), F.count(F.lit(1)).alias("many")).where("many > 1").select("digest", F.col("k.id").alias("keeper"))
    keepers = written(long_, "keepers")
    passes = maybe_listed(build_filter(keepers.select(F.col("digest").alias("key"))))
    asked = rows.withColumn("asked", (F.col("n") >= least) & passes(F.xxhash64("digest")))
    alone = asked.where(~F.col("asked")).select("id", "url", "payload", "digest", "n", F.lit("response").alias("kind"), F.lit(None).cast(rows.schema["id"].dataType).alias("refers_to"))
    joined = asked.where("asked").join(keepers.withColumn("has", F.lit(True)), "digest", "left")
    points = F.coalesce("has", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("keeper"))
    return alone.unionByName(joined.select("id", "url", F.when(~points, F.col("payload")).alias("payload"), "digest", "n", F.when(points, "revisit").otherwise("response").alias("kind"), F.when(points, F.col("keeper")).alias("refers_to")))


def write_archives(marked: DataFrame, path: str) -> DataFrame:
    """Writes path/*.warc.gz and the index at path/index; the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        attempt, out, at, file = f"{root}/.{uuid.uuid4().hex}", None, 0, ""
        rows: list[tuple] = []

        def closed() -> pa.RecordBatch:
            out.close()
            fs.move(attempt, f"{root}/{file}")
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return done

        for part in slices(batches, 64):
            for id_, url, payload, digest, n, kind, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    file = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(attempt)
                    info = zipped(record("warcinfo", file, {"WARC-Filename": file}, b"format: WARC File Format 1.1\r\n", "application/warc-fields"))
                    out.write(info)
                    at = len(info)
                member = zipped(page_record(kind, f"{file}:{at}", id_, url, payload, digest, n, refers_to))
                out.write(member)
                rows.append((id_, file, at, len(member), url, digest, n, kind, refers_to))
                at += len(member)
                if at >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    names = ["id", "file", "offset", "length", "url", "digest", "payload_bytes", "kind", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    texts = marked.select(F.col("id").cast("string"), "url", "payload", "digest", "n", "kind", F.col("refers_to").cast("string"))
    index = texts.mapInArrow(run, ", ".join(f"{k} {'bigint' if t == pa.int64() else 'string'}" for k, t in zip(names, kinds, strict=True)))
    kind = marked.schema["id"].dataType
    index = index.withColumns({k: F.col(k).cast(kind) for k in ("id", "refers_to")})
    index.write.parquet(f"{path}/index")
    return marked.sparkSession.read.schema(index.schema).parquet(f"{path}/index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int]]:
    """(offset, length, how many of the sorted ranges): those that lie near are read at once."""
    out: list[list[int]] = []
    for at, n in ranges:
        if out and at <= out[-1][0] + out[-1][1] + gap and at + n - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], at + n - out[-1][0])
            out[-1][2] += 1
        else:
            out.append([at, n, 1])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records of these index rows: id, url, kind, digest, payload_bytes, refers_to, payload_sha1 (of what was read), and the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        opened, name = None, None
        for part in slices(batches, 1024):
            wanted = list(zip(*(part.column(k).to_pylist() for k in range(4)), strict=True))
            at = 0
            while at < len(wanted):
                file = wanted[at][1]
                end = next((k for k in range(at, len(wanted)) if wanted[k][1] != file), len(wanted))
                if file != name:
                    if opened is not None:
                        opened.close()
                    opened, name = fs.open_input_file(f"{root}/{file}"), file
                for start, n, many in coalesced([(w[2], w[3]) for w in wanted[at:end]]):
                    data = opened.read_at(n, start)
                    found = [parse(zlib.decompress(data[w[2] - start : w[2] - start + w[3]], 31)) for w in wanted[at : at + many]]
                    yield batch(wanted[at : at + many], found)
                    at += many

    def batch(wanted: list[tuple], found: list[tuple[dict, bytes]]) -> pa.RecordBatch:
        back = lambda x: None if x is None else unescaped(x)
        columns = [
            [back(f.get("X-Page-ID")) for f, _ in found],
            [f.get("WARC-Target-URI") for f, _ in found],
            [f["WARC-Type"] for f, _ in found],
            [f["WARC-Payload-Digest"].removeprefix("sha1:") for f, _ in found],
            [int(f["X-Payload-Length"]) for f, _ in found],
            [back(f.get("X-Refers-To-Page-ID")) for f, _ in found],
            [hashlib.sha1(p).hexdigest() if f["WARC-Type"] == "response" else None for f, p in found],
        ]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        if with_payload:
            arrays.append(pa.array([p if f["WARC-Type"] == "response" else None for f, p in found], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["id", "url", "kind", "digest", "payload_bytes", "refers_to", "read_sha1"] + ["payload"] * with_payload
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    schema = "id string, url string, kind string, digest string, payload_bytes bigint, refers_to string, read_sha1 string" + ", payload binary" * with_payload
    size = index.agg(F.sum("length")).first()[0] or 0
    rows = index.select("id", "file", "offset", "length")
    dealt = rows.repartition(max(1, -(-size // READER_BYTES)), "file")  # by the archive's bytes, not the index's
    found = dealt.sortWithinPartitions("file", "offset").mapInArrow(run, schema)
    kind = index.schema["id"].dataType
    return found.withColumns({k: F.col(k).cast(kind) for k in ("id", "refers_to")})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, reads all records back; a response whose payload doesn't have its digest is an error."""
    path = new_path(spark, "warc")
    index = write_archives(mark_revisits(table(spark, sf_dir, "pages")), path)
    found = read_records(index, path, with_payload=False)
    whole = F.when(F.col("read_sha1").isNull() | (F.col("read_sha1") == F.col("digest")), F.col("digest")).otherwise(F.raise_error(F.lit("a payload isn't the one that was written")))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", whole.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM k
"""
