"""Line dedup by winnowing: passages that repeat anywhere in the corpus stay where they stand first, and go everywhere else.

A run is RUN_WORDS words in a row; its hash is a polynomial over the words' hashes. Units are lines, cut again where a sentence ends (., ! or ? and a
space). Runs that start with a unit or end with one are kept, and inside units of RUN_WORDS words or more the least of every WINDOW
neighbouring runs. So kept runs cover each passage of MIN_WORDS words that is made of whole units, and a passage of RUN_WORDS + 2 * (WINDOW - 1)
words shares kept runs wherever it is cut: they touch, and WINDOW - 1 words at most lie outside them at either end.
A line of MIN_LINE to RUN_WORDS - 1 words is a run of its own, which meets whole lines only.
A run that stands in several places is matched with the first place (smallest doc_id, then text hash and position).
Matches of one document that touch form a chain; at both of its ends the words beside the first place are compared one by one with the
document's, WINDOW - 1 at most, as no more can lie between a passage's end and its nearest kept run. Chains that touch are merged, and
MIN_WORDS words or more in a row are deleted; of shorter ones the lines of MIN_LINE words or more that they cover from end to end.
Words are what ASCII white space parts, so that indents and line ends of either kind make no difference.

The places of a run pass by in order, and each meets the first one, not its peers; very frequent runs pass by in many tasks. Of rows that repeat a text only the first
one (smallest id) is searched: all words of the others stand in it. Places that overlap the
first one in its own document don't count, nor do words that are part of it. A match is known by the 64 bits of its run's hash; that two texts share it
by chance would show as a chain of RUN_WORDS words that doesn't go on, too short to be deleted.

Defined cases: null, empty and blank texts pass unchanged. Rows that repeat both id and text count as one document and are treated
alike. A null id sorts before all others. A document all of whose words go has the text ''. Empty tables give empty results.
Columns other than id and text are carried along, whatever their names; the new columns' names get further underscores where they are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import positional, slices, table, written
from millrace.llm.urlfilter import build_filter, may_hold, maybe_listed

RUN_WORDS, WINDOW, MIN_WORDS, MIN_LINE = 12, 12, 23, 5
#: Runs of such a share of the runs of about so many sampled documents are dealt over so many tasks.
HOT_SHARE, HOT_SAMPLE, SALTS = 0.001, 2000, 64
#: Bytes of texts that are cut into words at once, but for longer texts.
AT_ONCE = 1 << 18
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
STOP = np.isin(np.arange(256), list(b".!?"))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse, modulo 2^64, to the powers below n."""
    if len(_powers["up"]) < n:
        for way, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[way] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes, hashes and numbers of words of the units that have words."""
    for mark in (b".", b"!", b"?"):
        text = text.replace(mark + b" ", mark + b"\n")
    parts = text.split(b"\n")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    words = np.fromiter((len(p.split()) for p in parts), np.int64, len(parts))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    has = words > 0
    ends[-1] -= 1
    return np.r_[0, ends[:-1]][has], ends[has], hashes[has], words[has]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes, and hashes of the words."""
    codes = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.r_[True, SPACE[codes], True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(codes) + 1)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * down[:-1], dtype=np.uint64)]
    return starts, ends, mixed((sums[ends] - sums[starts]) * up[starts])


def unit_marks(raw: bytes, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: whether it starts a unit, ends one, and stands in one of `least` words or more."""
    codes, flag = np.frombuffer(raw, np.uint8), np.zeros(len(starts) + 1, bool)
    flag[[0, -1]] = True
    flag[np.searchsorted(starts, np.flatnonzero(codes == 10))] = True
    flag[1:-1] |= STOP[codes[ends[:-1] - 1]] & (codes[ends[:-1]] == 32)
    sizes = np.diff(np.flatnonzero(flag))
    return flag[:-1], flag[1:], np.repeat(sizes >= least, sizes)


def slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = op(x[:-step], x[step:]), done + step
    return x


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    return np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes) + 1)[1][:-1], dtype=np.uint64)]


def kept_runs(sums: np.ndarray, marks: tuple[np.ndarray, np.ndarray, np.ndarray], doc: np.ndarray, run_words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the runs that are kept, for the words of several documents one after the other."""
    first = np.flatnonzero(doc[run_words - 1 :] == doc[: max(len(doc) - run_words + 1, 0)])
    if not len(first):
        return first, sums[:0]
    up = powers(len(sums))[0]
    run, own = mixed((sums[first + run_words] - sums[first]) * up[first]), doc[first]
    begins = np.r_[True, own[1:] != own[:-1]]
    at = np.arange(len(run)) + np.cumsum(begins) * (window - 1)  # a window's gap before each document
    laid = np.full(at[-1] + window, np.iinfo(np.uint64).max, np.uint64)
    laid[at] = run
    whole = begins.copy()  # a document of fewer runs has one window
    whole[: max(len(run) - window + 1, 0)] |= own[window - 1 :] == own[: max(len(run) - window + 1, 0)]
    least = np.zeros(len(laid), np.uint64)
    least[at[whole]] = slide(laid, window, np.minimum)[at[whole]]
    opens, closes, long = marks
    keep = (slide(least, window, np.maximum)[at - window + 1] == run) & long[first] | opens[first] | closes[first + run_words - 1]
    return first[keep], run[keep]


def line_starts(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The first words of the lines that have words, and the number of all words."""
    return np.unique(np.r_[0, np.searchsorted(starts, np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)), len(starts)])


def short_lines(raw: bytes, starts: np.ndarray, sums: np.ndarray, least: int, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, hashes and numbers of words of the lines of `least` to run_words - 1 words."""
    edges = line_starts(raw, starts)
    sizes = np.diff(edges)
    first, n = edges[:-1][(sizes >= least) & (sizes < run_words)], sizes[(sizes >= least) & (sizes < run_words)]
    return first, mixed((sums[first + n] - sums[first]) * powers(len(sums))[0][first] ^ n.astype(np.uint64) * np.uint64(BASE)), n


def run_rows(df: DataFrame, run_words: int, window: int, min_line: int, apart: np.ndarray | None = None) -> DataFrame:
    """Kept runs: doc_id, mark (the text's hash), run, and place: 256 times the first word, plus the number of words.

    apart: a filter; rows whose key (mark, other) it may hold are left out. It is asked here, so that a task needs one Python worker, not two.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("doc_id", df.schema["doc_id"].dataType), *(StructField(k, LongType()) for k in ("mark", "run", "place"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if apart is not None:
                part = part.filter(pa.array(~may_hold(apart, part.column(3).to_numpy(zero_copy_only=False))))
            for start, raws in together([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]):
                raw = b"\n".join(raws) + b"\n"
                starts, ends, hashes = words_of(raw)
                if not len(starts):
                    continue
                doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")
                sums = prefix_sums(hashes)
                first, h = kept_runs(sums, unit_marks(raw, starts, ends, run_words), doc, run_words, window)
                lines, of_lines, n = short_lines(raw, starts, sums, min_line, run_words)
                first, h, n = np.r_[first, lines], np.r_[h, of_lines], np.r_[np.full(len(first), run_words), n]
                own = doc[first]
                place = (first - np.searchsorted(doc, own) << 8) + n
                at = pa.array(start + own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), pa.array(h.view(np.int64)), pa.array(place)], names=schema.names)

    asked = [] if apart is None else [F.xxhash64(F.struct("mark", F.xxhash64(F.lit(1), "text").alias("other")))]
    return df.select("doc_id", "text", "mark", *asked).mapInArrow(run, schema)


def documents(df: DataFrame) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Of df (doc_id, text, mark) a filter of the texts that repeat; of the rows that it may hold one for each distinct text, that with the smallest id; and (doc_id, mark) of the other
    ids' rows with the same text. The rows that the filter doesn't hold are texts of their own.

    A text is known by two 64-bit hashes. All of a copy's words stand earlier, in the first row, so that copies need not be searched; only rows of repeated texts, and few others, are moved.
    """
    known = df.withColumn("other", F.xxhash64(F.lit(1), "text"))
    smallest = F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("s")
    more = known.groupBy("mark", "other").agg(F.count(F.lit(1)).alias("n"), smallest).where("n > 1").select("mark", "other", F.col("s.doc_id").alias("first"))
    more = written(more, "runs-rows")
    repeated = build_filter(more.select(F.struct("mark", "other").alias("key")))
    moved = known.where(maybe_listed(repeated)(F.xxhash64(F.struct("mark", "other")))).join(more, ["mark", "other"], "left").withColumn("_first", F.col("first").isNull() & F.col("doc_id").isNull() | (F.col("doc_id") == F.col("first")))
    first = F.coalesce("_first", F.col("first").isNull())
    firsts = moved.where(first).select("doc_id", "text", "mark").dropDuplicates(["doc_id", "mark"])
    return repeated, firsts, moved.where(~first).select("doc_id", "mark").distinct()


def frequent_runs(df: DataFrame, run_words: int, window: int, min_line: int) -> list[int]:
    """The runs that make up HOT_SHARE or more of those of a sample of HOT_SAMPLE documents or so: 1 / HOT_SHARE at most.

    They tell which runs are dealt over several tasks; what is found doesn't depend on them.
    """
    share = min(1.0, HOT_SAMPLE / max(df.count(), 1))
    runs = written(run_rows(df.sample(share, seed=1), run_words, window, min_line).select("run"), "runs-sample")
    least = max(2, runs.count() * HOT_SHARE)
    return [r["run"] for r in runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "run").limit(round(1 / HOT_SHARE)).toLocalIterator()]


def first_places(runs: DataFrame, hot: list[int]) -> DataFrame:
    """doc_id, mark and place of each run's places but the first, beside f_id, f_mark and f_place, the first one.

    The places of a run pass by in order. Those of the runs in hot are dealt over SALTS tasks; the first one of each task's goes on, and the first
    of these, a row for each run in hot, is joined to all of them.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    kind = runs.schema["doc_id"].dataType
    schema = StructType([StructField(p + k, kind if k == "id" else LongType()) for p, ks in (("doc_", ("id",)), ("", ("mark", "place", "run", "salt")), ("f_", ("id", "mark", "place"))) for k in ks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the first place of the last run, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            joined, n = pa.Table.from_batches([*held, batch]).combine_chunks(), len(held)
            keys, salts = (joined.column(k).to_numpy() for k in (2, 4))
            begins = np.r_[True, (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])]
            lead = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
            mine = np.flatnonzero((~begins | (salts > 0)) & (np.arange(len(keys)) >= n))
            one, other = joined.take(pa.array(mine)), joined.take(pa.array(lead[mine]))
            columns = [t.column(k).combine_chunks() for t, ks in ((one, (0, 1, 3, 2, 4)), (other, (0, 1, 3))) for k in ks]
            held = joined.slice(int(lead[-1]), 1).to_batches()
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=schema.names)

    salt = F.when(F.col("run").isin(hot), F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)) + 1).otherwise(F.lit(0)) if hot else F.lit(0)
    dealt = runs.select("doc_id", "mark", "run", "place", salt.cast("long").alias("salt")).repartition(F.col("run"), F.col("salt"))
    found = dealt.sortWithinPartitions("run", "salt", "doc_id", "mark", "place").mapInArrow(run, schema)
    names = ("f_id", "f_mark", "f_place")
    if not hot:
        return found.drop("run", "salt")
    found = written(found, "runs-found")
    least = found.where("salt > 0").groupBy("run").agg(F.min(F.struct(*names)).alias("g"))
    known = found.join(F.broadcast(least), "run", "left")  # a row for each run in hot
    known = known.select("doc_id", "mark", "place", *[F.when(F.col("salt") > 0, F.col(f"g.{k}")).otherwise(F.col(k)).alias(k) for k in names])
    return known.where(~F.struct("doc_id", "mark", "place").eqNullSafe(F.struct(*names)))


def word_of(place: str):
    return F.shiftright(place, 8)


def words_in(place: str):
    return F.col(place).bitwiseAND(F.lit(255))


def neighbours(df: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """f_id, f_mark, f_place, near: 32 bits of the hashes of the `reach` words before each wanted run, nearest first, and after it; 0 outside the text."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    by_doc = written(wanted.groupBy("f_id", "f_mark").agg(F.collect_set("f_place").alias("places")), "runs-wanted")
    passes = maybe_listed(build_filter(by_doc.select(F.struct("f_id", "f_mark").alias("key"))))  # other texts needn't be moved
    docs = df.select(F.col("doc_id").alias("id"), "mark", "text")
    docs = docs.where(passes(F.xxhash64(F.struct(F.col("id").alias("f_id"), F.col("mark").alias("f_mark")))))
    joined = docs.join(by_doc, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("mark") == F.col("f_mark"))).select("f_id", "f_mark", "text", "places")
    schema = StructType([*wanted.select("f_id", "f_mark", "f_place").schema.fields, StructField("near", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own, places, near = [], [], []
            for k, (raw, found) in enumerate(zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist(), strict=True)):
                short = np.pad(short_hashes(words_of(raw)[2]), reach)
                for place in found:
                    at, n = (place >> 8) + reach, place & 255
                    own.append(k)
                    places.append(place)
                    near.append(np.r_[short[at - reach : at][::-1], short[at + n : at + n + reach]].tobytes())
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(places, pa.int64()), pa.array(near, pa.binary())], names=schema.names)

    return joined.mapInArrow(run, schema).dropDuplicates(["f_id", "f_mark", "f_place"])


def short_hashes(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def chains_of(found: DataFrame) -> DataFrame:
    """doc_id, mark, a, b, side, and the place beside its first (side 0) and its last run (side 1), of each chain of runs that touch.

    A document's matches pass by in their order; those of one document at a time are held, which are no more than its words.
    """
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    fields = {f.name: f.dataType for f in found.schema}
    names = ["doc_id", "mark", "a", "b", "side", "f_id", "f_mark", "f_place", "reach"]
    schema = StructType([StructField(k, IntegerType() if k == "side" else fields.get(k, LongType())) for k in names])

    def made(t: pa.Table, opens: np.ndarray) -> pa.RecordBatch:
        at, end = t["at"].to_numpy(), t["end"].to_numpy()
        shift = (np.cumsum(opens) - 1) * (int(end.max()) + 1)  # so that a document's places lie beyond those of the one before
        upto = np.maximum.accumulate(end + shift)
        heads = np.flatnonzero(np.r_[True, at[1:] + shift[1:] > upto[:-1]])
        farthest = np.maximum.accumulate(np.where(np.r_[True, upto[1:] > upto[:-1]], np.arange(len(end)), 0))[np.r_[heads[1:], len(end)] - 1]
        n, both = len(heads), pa.array(np.r_[heads, farthest])
        own = {"a": np.tile(at[heads], 2), "b": np.tile(end[farthest], 2), "side": np.repeat(np.arange(2, dtype=np.int32), n)}
        return pa.RecordBatch.from_arrays([pa.array(own[k]) if k in own else t[k].take(both).combine_chunks() for k in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            ids, marks = t["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), t["mark"].to_numpy()
            opens = np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])]
            last = int(np.flatnonzero(opens)[-1])
            if last:
                yield made(t.slice(0, last), opens[:last])
            held = t.slice(last).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield made(t, np.r_[True, np.zeros(t.num_rows - 1, bool)])

    sorted_ = found.repartition("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "at", "end")
    return sorted_.mapInArrow(run, schema)


def repeats(df: DataFrame, run_words: int, window: int, min_line: int) -> tuple[np.ndarray, DataFrame]:
    """A filter of the texts (doc_id, mark) that have any match, and of these doc_id, mark, found: whether all of the text stands in another row (whole), else the chains of matches (first word, and the one after the last), each twice, with what
    stands beside the first place of its first and of its last run, and how many of those words may count. A document's chains are no more than its words."""
    repeated, firsts, copies = documents(df)
    copies = written(copies, "runs-copies")
    runs = run_rows(df, run_words, window, min_line, repeated).unionByName(run_rows(firsts, run_words, window, min_line))
    found = first_places(runs, frequent_runs(df, run_words, window, min_line))
    own = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("mark") == F.col("f_mark"))
    apart = F.when(own, word_of("place") - word_of("f_place") - words_in("f_place")).otherwise(F.lit(window - 1))
    first = F.struct("f_id", "f_mark", "f_place", F.least(apart, F.lit(window - 1)).alias("reach"))
    found = found.select("doc_id", "mark", word_of("place").alias("at"), (word_of("place") + words_in("place")).alias("end"), first.alias("f")).where("f.reach >= 0")
    rows = written(chains_of(found.select("doc_id", "mark", "at", "end", "f.*")), "runs-met")
    near = neighbours(df, rows.select("f_id", "f_mark", "f_place").distinct(), window - 1).withColumnsRenamed({"f_id": "_id", "f_mark": "_mark", "f_place": "_place"})
    known = rows.join(near, F.col("f_id").eqNullSafe(F.col("_id")) & (F.col("f_mark") == F.col("_mark")) & (F.col("f_place") == F.col("_place")))
    chains = known.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "b", "side", "reach", "near")).alias("chains"))
    whole = copies.withColumn("chains", F.lit(None).cast(chains.schema["chains"].dataType))
    both = chains.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True)))
    key = F.struct("doc_id", "mark").alias("key")
    return build_filter(rows.select(key).distinct().unionByName(copies.select(key))), both.select("doc_id", "mark", F.struct("whole", "chains").alias("found"))


def together(raws: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in groups of about AT_ONCE bytes, with the number of each group's first one."""
    start, size = 0, 0
    for k, raw in enumerate(raws):
        if k > start and size + len(raw) > AT_ONCE:
            yield start, raws[start:k]
            start, size = k, 0
        size += len(raw)
    if raws:
        yield start, raws[start:]


def widened(spans: list[list], short: np.ndarray, base: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all chains, and the words after their last ones, each chain grown by the words at its end that are like those beside its first place.

    short: of the words of several documents one after the other; base and upto: where each document's words start and end among them.
    """
    each = [(k, x["a"], x["b"], x["side"], x["reach"]) for k, s in enumerate(spans) for x in s]
    if not each:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, a, b, side, reach = np.array(each, np.int64).T
    near = np.frombuffer(b"".join(x["near"] for s in spans for x in s), np.uint32).reshape(len(each), 2, -1)
    theirs, beside = near[np.arange(len(each)), side], np.arange(near.shape[2])
    a, b = a + base[doc], b + base[doc]
    at = np.where(side[:, None] == 1, b[:, None] + beside, a[:, None] - 1 - beside)
    inside = (at >= base[doc][:, None]) & (at < upto[doc][:, None]) & (beside < reach[:, None])
    same = inside & (short[np.where(inside, at, 0)] == theirs)
    more = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    return a - np.where(side == 0, more, 0), b + np.where(side == 1, more, 0)


def cut_texts(raws: list[bytes], spans: list[list | None], min_words: int, min_line: int) -> list[tuple[bytes, int, int]]:
    """Each text without the merged chains that have min_words words and the whole lines in shorter ones, and the whole units and the words that went.

    Of a text whose spans are None every word is covered. The texts are looked at together, so that small ones don't cost an array each.
    """
    raw = b"\n".join(raws) + b"\n"
    starts, ends, hashes = words_of(raw)
    begin = np.cumsum([0, *(len(r) + 1 for r in raws)])
    doc = np.searchsorted(begin[1:], starts, side="right")
    base = np.searchsorted(doc, np.arange(len(raws)))
    upto = np.r_[base[1:], len(doc)]
    a, b = widened([s or [] for s in spans], short_hashes(hashes), base, upto)
    full = np.flatnonzero([s is None for s in spans])
    step = np.zeros(len(doc) + 1, np.int64)
    np.add.at(step, np.r_[a, base[full]], 1)
    np.add.at(step, np.r_[b, upto[full]], -1)
    covered, opens = np.cumsum(step[:-1]) > 0, np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
    run = np.flatnonzero(opens | np.r_[True, covered[1:] != covered[:-1]][: len(doc)])
    sizes = np.diff(np.r_[run, len(doc)])
    gone = covered & np.repeat(sizes >= min_words, sizes)
    if len(doc):
        lines = line_starts(raw, starts)
        sizes = np.diff(lines)
        gone |= np.repeat((np.add.reduceat(covered.astype(np.int64), lines[:-1]) == sizes) & (sizes >= min_line), sizes)
        first = np.flatnonzero(unit_marks(raw, starts, ends, 1)[0])
        whole = np.add.reduceat(gone.astype(np.int64), first) == np.diff(np.r_[first, len(doc)])
        units_gone, words_gone = np.bincount(doc[first[whole]], minlength=len(raws)), np.bincount(doc[gone], minlength=len(raws))
    else:
        units_gone = words_gone = np.zeros(len(raws), np.int64)
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)) | np.r_[opens, True] & np.r_[False, gone] & np.r_[gone, False])
    out, cuts = list(raws), {}
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if gone[x]:
            cuts.setdefault(int(doc[x]), []).append((x, y))
    for k, mine in cuts.items():
        kept, at, low, high = [], int(begin[k]), int(base[k]), int(upto[k])
        stop = int(begin[k + 1]) - 1
        for x, y in mine:
            before, after = int(ends[x - 1]) if x > low else int(begin[k]), int(starts[y]) if y < high else stop
            left, right = raw[before : starts[x]], raw[ends[y - 1] : after]
            kept += [raw[at:before], right if b"\n" in right and b"\n" not in left else left]  # what parts lines stays
            at = after
        left = b"".join([*kept, raw[at:stop]])
        out[k] = left if left.strip() else b""
    return list(zip(out, units_gone.tolist(), words_gone.tolist(), strict=True))


def fresh(name: str, taken: list[str]) -> str:
    return fresh(name + "_", taken) if name in taken else name


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, window: int = WINDOW, min_words: int = MIN_WORDS, min_line: int = MIN_LINE) -> DataFrame:
    """df with its text cut, and _units_removed, _words_removed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    flat, at = positional(df), df.columns.index(text)
    own = flat.withColumn("m", F.xxhash64(f"c{at}"))
    plain = own.select(F.col(f"c{df.columns.index(id_col)}").alias("doc_id"), F.col(f"c{at}").alias("text"), F.col("m").alias("mark"))
    filter_, found = repeats(plain, run_words, window, min_line)
    passes = maybe_listed(filter_)(F.xxhash64(F.struct(F.col(f"c{df.columns.index(id_col)}").alias("doc_id"), F.col("m").alias("mark"))))
    joined = own.where(passes).join(found, F.col(f"c{df.columns.index(id_col)}").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")), "left").select(*flat.columns, "found")
    schema = StructType([*flat.schema.fields, StructField("units", LongType()), StructField("words", LongType())])
    arrow, many = to_arrow_schema(schema), len(flat.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            has = part.column(many).is_valid()
            columns = [part.column(i).cast(arrow.field(i).type) for i in range(many)]
            found = [None if s["whole"] else s["chains"] for s in part.column(many).filter(has).to_pylist()]
            raws = [t or b"" for t in part.column(at).filter(has).cast(pa.binary()).to_pylist()]
            cut = [c for start, some in together(raws) for c in cut_texts(some, found[start : start + len(some)], min_words, min_line)]
            removed = np.zeros((2, part.num_rows), np.int64)
            if cut:  # the other texts never leave their column
                new = pa.array([c[0] for c in cut], pa.binary()).cast(arrow.field(at).type)
                columns[at] = pc.replace_with_mask(columns[at], has, pc.if_else(part.column(at).filter(has).is_null(), pa.scalar(None, arrow.field(at).type), new))
                removed[:, has.to_numpy(zero_copy_only=False)] = [[c[k] for c in cut] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed[0]), pa.array(removed[1])], schema=arrow)

    names = [*df.columns, *(fresh(k, df.columns) for k in ("_units_removed", "_words_removed"))]
    stay = own.where(~passes).select(*flat.columns, F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("words"))  # texts without a match are not moved
    return joined.mapInArrow(run, schema).unionByName(stay).toDF(*names)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("_units_removed").alias("units_removed"), F.col("_words_removed").alias("words_removed"), F.length("text").cast("long").alias("chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
