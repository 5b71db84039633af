"""Byte-level BPE encoding and decoding, every distinct word merged once.

Texts are cut into words (pre-tokens) by the vocabulary's pattern. A block of documents sends each of its distinct words once, with the places in the block where it stands, so
that frequent words are summed up before anything moves. Words are dealt out by their hash, those of a block and a bucket packed into one row: of all blocks they meet in
their bucket, where each is merged once. The ids then go back to the block, are put where the places say, and cut into documents again. Places don't move: they lie in a table that
is bucketed by block, and only words and ids are shuffled. Decoding joins the ids of a batch with the table of token bytes, which has a row a token and is in every task.

Ids equal tiktoken's encode_ordinary: a word that is a token is that token; otherwise the adjacent pair of least rank, leftmost first, is merged again and again.

A block holds whole documents, BLOCK words or one document at least; a text whose ids fit into a row is never cut. No word is sent more often than there are blocks.

Defined cases: a null text has null ids, and they decode to null; '' has no ids. Long words are merged through a heap. Rows repeated keep a row each; an empty table gives an
empty result. Other columns are ignored, or kept by name if asked for. Ids that the vocabulary lacks are an error.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from millrace.llm.base import bucketed, named, slices, table

#: Words of a block, at which it is closed; bytes from which a word is merged through a heap; characters from which a text's words are not listed at once.
BLOCK, LONG, LISTED = 2_000_000, 256, 1 << 20


class Vocabulary:
    """Ranks of byte strings, and the pattern that cuts words. It travels as the bytes of its file, and is read in each task."""

    def __init__(self, file: bytes, pattern: str):
        self.file, self.pattern = file, pattern
        self._load()

    def _load(self) -> None:
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.file.splitlines())}
        self.split = regex.compile(self.pattern)
        top = max(self.ranks.values())
        self.type = np.dtype("<u2" if top < 1 << 16 else "<i4")
        by_id = [b""] * (top + 1)
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(by_id), np.uint8)

    def __getstate__(self) -> dict:
        return {"file": self.file, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._load()

    def words(self, text: str) -> Iterator[str]:
        return iter(self.split.findall(text)) if len(text) < LISTED else (m.group() for m in self.split.finditer(text))

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        if len(word) > LONG:
            return self._merged_long(word)
        rank, never = self.ranks.get, 1 << 62
        ends = list(range(len(word) + 1))
        pairs = [rank(word[i : i + 2], never) for i in range(len(word) - 1)]
        while pairs and (best := min(pairs)) < never:
            i = pairs.index(best)
            del ends[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(word[ends[i] : ends[i + 2]], never)
            if i:
                pairs[i - 1] = rank(word[ends[i - 1] : ends[i + 1]], never)
        return [self.ranks[word[a:b]] for a, b in zip(ends, ends[1:], strict=False)]

    def _merged_long(self, word: bytes) -> list[int]:
        n, rank = len(word), self.ranks.get
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))  # of each part's start: where the next part starts, and the one before
        live, heap = bytearray(b"\x01") * n, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := rank(word[i : after[j]])) is not None:
                heapq.heappush(heap, (r, i, after[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not live[i] or (j := after[i]) >= n or after[j] != end:
                continue
            live[j], after[i] = 0, end
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[word[i : after[i]]] for i in range(n) if live[i]]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens one after the other."""
        return spread(self.pool, self.starts, self.sizes, ids)


def spread(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The slices [start, start + size) of pool that are chosen, in that order."""
    many = sizes[chosen]
    ends = np.cumsum(many)
    return pool[np.repeat(starts[chosen] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]


def read_vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a file of ranks; without a path, the public one of 50,256 tokens."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return Vocabulary(file.read(), pattern or public_tokenizers.PATTERN)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 0 or more, seven bits a byte and the low ones first, the last byte of each below 128; and where each ends."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        if not (more := values >= 1 << bits).any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(sizes.max(initial=0)):
        has = np.flatnonzero(sizes > k)
        out[ends[has] - sizes[has] + k] = (values[has] >> (7 * k)) & 127 | np.where(sizes[has] > k + 1, 128, 0)
    return out, ends


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each one's last byte is."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64), last
    starts = np.r_[0, last[:-1] + 1]
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, last - starts + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, starts), last


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


#: What rows of blocks have: a bundle's words of one hash bucket, spelled one after the other, and their lengths; of all words of the block, in the order of buckets, the gaps between
#: their places, and the bytes of gaps that each has.
PARTS = ("spelled", "lengths", "places", "spans")


def cut_by(data: np.ndarray, ends: np.ndarray, upto: np.ndarray) -> pa.Array:
    """One binary for each stretch of items that ends before upto; ends: where the bytes of each item end."""
    return binaries(data, np.r_[0, ends][upto])


def word_bundles(df: DataFrame, vocabulary: Vocabulary, text: str, keep: list[str], block_words: int, buckets: int) -> DataFrame:
    """By block a row for each bucket of its distinct words (spelled, lengths), one of their places, and one for each document (nth, n_words, and the columns to keep as c0, c1, ...)."""
    chosen = df.select(*[named(c).alias(f"c{k}") for k, c in enumerate(keep)], named(text).alias("text"))
    schema = StructType(chosen.schema.fields[:-1] + StructType.fromDDL("block string, bucket int, nth int, n_words bigint, " + ", ".join(f"{x} binary" for x in PARTS)).fields)
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    width = len(keep)

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0

        def fresh() -> tuple:
            return defaultdict(count().__next__), array("i"), [], []

        numbers, places, documents, sizes = fresh()

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            block, made = f"{part}-{made}", made + 1
            n = len(sizes)
            kept = {f"c{k}": pa.concat_arrays([d.column(k) for d in documents]) for k in range(width)}
            yield rows(n, **kept, block=pa.repeat(block, n), nth=pa.array(np.arange(n, dtype=np.int32)), n_words=pa.array(sizes, pa.int64()))
            if not numbers:
                return
            words = [w.encode() for w in numbers]
            bucket = np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
            by_bucket = np.argsort(bucket, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[by_bucket] = np.arange(len(words), dtype=np.int32)
            at = rank[np.frombuffer(places, np.int32)]
            order = np.argsort(at, kind="stable")
            upto = np.cumsum(np.bincount(at, minlength=len(words)))
            first = np.r_[0, upto[:-1]]
            gaps = np.diff(order, prepend=0)
            gaps[first] = order[first]
            gap_bytes, gap_ends = packed(gaps)
            word_ends = gap_ends[upto - 1]  # of each word's gaps
            sizes_ = np.fromiter(map(len, words), np.int64, len(words))[by_bucket]
            spelled = np.frombuffer(b"".join(map(words.__getitem__, by_bucket.tolist())), np.uint8)
            length_bytes, length_ends = packed(sizes_)
            span_bytes, span_ends = packed(np.diff(word_ends, prepend=0))
            used, starts = np.unique(bucket[by_bucket], return_index=True)
            last = np.r_[starts[1:], len(words)]
            yield rows(len(used), block=pa.repeat(block, len(used)), bucket=pa.array(used.astype(np.int32)), spelled=cut_by(spelled, np.cumsum(sizes_), last), lengths=cut_by(length_bytes, length_ends, last))
            yield rows(1, block=pa.array([block]), places=binaries(gap_bytes, gap_ends[-1:]), spans=binaries(span_bytes, span_ends[-1:]))

        for batch in slices(batches, 64):
            at = 0
            for k, text_ in enumerate(batch.column(width).to_pylist()):
                before = len(places)
                if text_ is not None:
                    places.extend(map(numbers.__getitem__, vocabulary.words(text_)))
                sizes.append(-1 if text_ is None else len(places) - before)
                if len(places) >= block_words:
                    documents.append(batch.slice(at, k + 1 - at))
                    yield from closed()
                    at, (numbers, places, documents, sizes) = k + 1, fresh()
            if at < batch.num_rows:
                documents.append(batch.slice(at))
        if sizes:
            yield from closed()

    return chosen.mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK) -> DataFrame:
    """keep, and ids: array<int>."""
    vocabulary, width = vocabulary or read_vocabulary(), len(keep)
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(word_bundles(df, vocabulary, text, list(keep), block_words, buckets), "block")
    bundles = blocks.where("spelled IS NOT NULL").select("block", "bucket", "spelled", "lengths")
    dealt = bundles.repartition("bucket").sortWithinPartitions("bucket")
    schema = StructType.fromDDL("block string, bucket int, ids binary, many binary")
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    kind = vocabulary.type

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in slices(batches, 64):
            ids, many = [], []
            for bucket, spelled, lengths in zip(*(batch.column(x).to_pylist() for x in ("bucket", "spelled", "lengths")), strict=True):
                if bucket != now:
                    now, known = bucket, {}  # all of a word's bundles lie in one bucket
                ends = np.cumsum(unpacked(np.frombuffer(lengths, np.uint8))[0]).tolist()
                found, start = [], 0
                for end in ends:
                    word = spelled[start:end]
                    if (x := known.get(word)) is None:
                        x = known[word] = np.array(vocabulary.merged(word), kind).tobytes()
                    found.append(x)
                    start = end
                ids.append(b"".join(found))
                many.append(packed(np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize)[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block").cast(arrow.field(0).type), batch.column("bucket"), pa.array(ids, pa.binary()), pa.array(many, pa.binary())], schema=arrow)

    out = StructType([*blocks.schema.fields[:width], *StructType.fromDDL("ids array<int>").fields])
    result = to_arrow_schema(out, prefers_large_types=False)

    def reassemble(words: pa.Table, block: pa.Table) -> pa.Table:
        documents = block.filter(pc.is_valid(block["nth"])).sort_by("nth").combine_chunks()
        words = words.sort_by("bucket")
        joined = lambda x: np.frombuffer(b"".join(v for v in (words if x in words.column_names else block)[x].to_pylist() if v), np.uint8)
        sizes = documents["n_words"].to_numpy()
        listed = np.maximum(sizes, 0)
        gaps, last = unpacked(joined("places"))
        upto = np.cumsum(unpacked(joined("spans"))[0])  # bytes of gaps up to each word's end
        first = np.searchsorted(last, np.r_[0, upto[:-1]]) if len(upto) else upto
        times = np.diff(np.r_[first, len(gaps)])
        sums = np.cumsum(gaps)
        places = sums - np.repeat(sums[first] - gaps[first], times)
        lengths = unpacked(joined("many"))[0]
        pool = joined("ids").view(kind)
        if len(places) != listed.sum() or len(lengths) != len(times):
            raise RuntimeError("a block's words are not those of its documents: the input changed between attempts")
        at = np.zeros(len(places), np.int32)
        at[places] = np.repeat(np.arange(len(times), dtype=np.int32), times)
        flat = spread(pool, np.cumsum(lengths) - lengths, lengths, at).astype(np.int32)
        ends = np.r_[0, np.cumsum(lengths[at])][np.r_[0, np.cumsum(listed)]]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array(sizes < 0))
        columns = [documents[f"c{k}"].combine_chunks().cast(result.field(k).type) for k in range(width)]
        return pa.Table.from_arrays([*columns, lists.cast(result.field(width).type)], schema=result)

    merged = dealt.mapInArrow(merge, schema)
    rest = blocks.where("spelled IS NULL").select(*[f"c{k}" for k in range(width)], "block", "nth", "n_words", "places", "spans")
    return merged.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(reassemble, out).toDF(*keep, "ids")


def decode(df: DataFrame, vocabulary: Vocabulary | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and bytes: binary, the text in UTF-8 if the ids are those of a whole one."""
    vocabulary, width = vocabulary or read_vocabulary(), len(keep)
    chosen = df.select(*[named(c).alias(f"c{k}") for k, c in enumerate(keep)], named(ids).cast("array<int>").alias("ids"))
    out = StructType([*chosen.schema.fields[:-1], *StructType.fromDDL("bytes binary").fields])
    arrow = to_arrow_schema(out, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            lists = part.column(width)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
            if len(flat) and (flat.dtype.kind != "i" or flat.min() < 0 or flat.max() >= len(vocabulary.sizes) or not vocabulary.sizes[flat].all()):
                raise ValueError("ids that the vocabulary lacks")
            ends = np.r_[0, np.cumsum(vocabulary.sizes[flat])][offsets - offsets[0]]
            found = binaries(vocabulary.joined(flat), ends[1:])
            if lists.null_count:
                found = pc.if_else(lists.is_null(), pa.scalar(None, pa.binary()), found)
            yield pa.RecordBatch.from_arrays([*[part.column(k).cast(arrow.field(k).type) for k in range(width)], found], schema=arrow)

    return chosen.mapInArrow(run, out).toDF(*keep, "bytes")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes the ids; digests of both."""
    vocabulary = read_vocabulary()
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encode(documents, vocabulary)
    digested = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "ids")
    decoded = decode(digested, vocabulary, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
