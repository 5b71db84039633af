"""Document fingerprints by locally consistent parsing.

A text's code points are named by hashes. On each level neighbours that are equal are joined to one phrase, and deterministic coin
tossing labels the others: a symbol's label is the lowest bit in which its name differs from the one before, and that bit's value; three
rounds leave labels under 8, different between neighbours. Phrases end where a label is a local maximum, so they have 2 to about a dozen symbols, and where
they end depends on a dozen neighbours only: equal substrings share all but a few phrases at their edges, whatever their offset. A phrase's name
is the hash of its symbols' names, and the phrases are the next level's symbols, until one is left.

The fingerprint samples the phrase names of all levels that are long enough to be telling: the SKETCH smallest hashes, a bottom-k
sketch, so that the likeness of two fingerprints estimates the Jaccard coefficient of their phrases. Short texts keep all of theirs.

Defined cases: a null text counts as empty; empty texts have the fingerprint '' and are alike. Rows repeated keep a row each. In the order of
documents a null id comes first, and rows that share an id are ordered by their text's hash. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import slices, table, written

SKETCH, LEAST_LEVEL, MAX_LEVELS = 64, 2, 40
#: Code points that are parsed together; a longer text is parsed alone, in some 60 bytes a code point.
BATCH = 1 << 17
#: Ranges of ids that the query's edited texts are made in: at least RANGES, one for ROWS_PER_RANGE rows, at most MAX_RANGES.
RANGES, ROWS_PER_RANGE, MAX_RANGES = 512, 1000, 1 << 14
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The lowest set bit's number, through a de Bruijn sequence.
DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)
_BITS = np.zeros(64, np.uint8)
for _k in range(64):
    _BITS[((0x03F79D71B4CB0A89 << _k) & (2**64 - 1)) >> 58] = 2 * _k
#: A round of coin tossing on labels under 128, at 128 times the label before plus the label itself.
_a, _b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
_low = (_a ^ _b) & -(_a ^ _b)
_ROUND = np.where(_a == _b, 0, 2 * np.log2(np.maximum(_low, 1)).astype(np.int64) + ((_b & np.maximum(_low, 1)) > 0)).astype(np.uint8).ravel()


def labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels under 8 of names of which no two neighbours are equal; they depend on three names before at most. first: where texts start."""
    differ = names[1:] ^ names[:-1]
    low = differ & (~differ + np.uint64(1))
    out = np.empty(len(names), np.uint8)
    out[1:] = _BITS[((low * DE_BRUIJN) >> np.uint64(58)).astype(np.uint8)]
    out[1:] += (names[1:] & low) > 0
    own = (names[first] & np.uint64(1)).astype(np.uint8)
    out[first] = own
    for _ in range(2):
        out[1:] = _ROUND[(out[:-1].astype(np.uint16) << np.uint16(7)) + out[1:]]
        out[first] = own
    return out


def phrases(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the phrases of these symbols start. Runs of equal names are phrases; between them local maxima of the labels end one."""
    change = np.empty(len(names), bool)
    change[0] = True
    np.not_equal(names[1:], names[:-1], out=change[1:])
    change[first] = True
    heads = np.flatnonzero(change)
    at = np.searchsorted(heads, first)
    single = np.diff(np.append(heads, len(names))) == 1
    label = labels(names[heads], at)
    begin = np.zeros(len(heads) + 1, bool)  # after a maximum; at a run, and after it
    begin[2:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    begin[at] = True
    begin[np.minimum(at + 1, len(heads))] = False  # a text's first symbol is no maximum
    begin[at] = True
    begin[:-1] |= ~single
    begin[1:] |= ~single
    return heads[begin[:-1]]


def sketches(texts: list[str], size: int = SKETCH) -> list[np.ndarray]:
    """Of each text the smallest names of its phrases on the telling levels; of a short text those of its highest level. All texts' levels are parsed together."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    doc = np.array([k for k, c in enumerate(codes) if len(c)], np.int64)
    if not len(doc):
        return [np.zeros(0, np.uint64) for _ in texts]
    names = mixed(np.concatenate(codes).astype(np.uint64) * BASE + np.uint64(1))
    lengths = np.array([len(codes[k]) for k in doc], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(1, MAX_LEVELS):
        done = lengths == 1
        if level <= LEAST_LEVEL and done.any():  # too short for a telling level
            first = np.cumsum(lengths) - lengths
            found.append((doc[done], names[first[done]]))
        if done.any():
            names, doc, lengths = names[np.repeat(~done, lengths)], doc[~done], lengths[~done]
        if not len(doc):
            break
        first = np.cumsum(lengths) - lengths
        starts = phrases(names, first)
        sizes = np.diff(np.append(starts, len(names)))
        inside = np.arange(len(names), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), sizes)
        turned = mixed(names + inside * BASE)  # a symbol's share depends on its place in the phrase
        names = mixed(np.add.reduceat(turned, starts) + sizes.astype(np.uint64) + np.uint64(level << 32))
        lengths = np.diff(np.append(np.searchsorted(starts, first), len(starts)))
        if level >= LEAST_LEVEL:
            found.append((np.repeat(doc, lengths), names))
    whose, what = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((what, whose))
    whose, what = whose[order], what[order]
    new = np.r_[True, (whose[1:] != whose[:-1]) | (what[1:] != what[:-1])]
    whose, what = whose[new], what[new]
    cuts = np.searchsorted(whose, np.arange(len(texts) + 1))
    return [what[a : min(b, a + size)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def in_batches(texts: list[str], size: int = SKETCH) -> list[np.ndarray]:
    """sketches() of about BATCH code points at once."""
    out, part, n = [], [], 0
    for t in texts:
        if part and n + len(t) > BATCH:
            out += sketches(part, size)
            part, n = [], 0
        part.append(t)
        n += len(t)
    return out + sketches(part, size)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Of the smallest names of both sketches together, the part that is in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.union1d(a, b)[:size]
    return float(np.isin(low, a, assume_unique=True)[np.isin(low, b, assume_unique=True)].sum() / len(low))


def as_string(sketched: np.ndarray) -> str:
    return sketched.astype(">u8").tobytes().hex()


def fingerprint_rows(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and fingerprint: the sketch as hexadecimal digits, 16 a name."""
    from millrace.llm.base import map_texts

    return map_texts(df, text, "fingerprint string", lambda texts: {"fingerprint": [as_string(x) for x in in_batches([t or "" for t in texts])]}, list(keep))


def ranged_with_next(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, range, th, own: rows dealt into ranges of (doc_id, th, the text's hash), null ids first; each range also has, last and not its own, the row that follows it.

    Only range bounds reach the driver; of the texts none is shuffled twice, but for one a range. An id that many rows share, or null, fills several
    ranges, parted by the hash.
    """
    plain = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = plain.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    ranges = ranges or min(MAX_RANGES, max(RANGES, ids["n"] // ROWS_PER_RANGE))
    shares = F.split(F.lit(" ".join(str(k / ranges) for k in range(1, ranges)) or "0.5"), " ").cast("array<double>")  # one literal, once it is folded
    steps = plain.agg(F.percentile_approx("doc_id", shares, F.lit(10 * ranges)).alias("steps")).first()["steps"] or []
    nulls = (ids["n"] - ids["known"]) * ranges // max(ids["n"], 1)
    hashed = plain.withColumn("th", F.xxhash64("text"))
    hashed = hashed.withColumn("range", _range_of(steps, nulls)(F.col("doc_id"), F.col("th")))
    heads = written(hashed.select("range", "doc_id", "th").groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th")).alias("head")), "heads")
    firsts = sorted((r["range"], r["head"]["doc_id"], r["head"]["th"]) for r in heads.toLocalIterator())  # one row a range
    if not firsts:
        return hashed.withColumn("own", F.lit(True))
    before = {firsts[k][0]: firsts[k - 1 if k else len(firsts) - 1][0] for k in range(len(firsts))}
    rows = [(r, d, t, before[r]) for r, d, t in firsts]
    spark = df.sparkSession
    marks = F.broadcast(spark.createDataFrame(rows, "hr int, hd bigint, ht bigint, hp int"))  # one row a range
    ghosts = hashed.join(marks, (F.col("range") == F.col("hr")) & F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("th") == F.col("ht"))).dropDuplicates(["hr"])
    ghosts = ghosts.select("doc_id", "text", F.col("hp").alias("range"), "th", F.lit(False).alias("own"))
    return hashed.select("doc_id", "text", "range", "th", F.lit(True).alias("own")).unionByName(ghosts)


def _range_of(steps: list[int], nulls: int):
    """A column function: the range of an id and a text's hash. An id that is several steps has as many ranges of equal shares of the hashes, and null has `nulls`."""
    known, many = np.unique(np.array(steps, np.int64), return_counts=True)
    starts = max(nulls, 1) + np.r_[0, np.cumsum(np.maximum(many, 1))]

    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, hashes in batches:
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            share = hashes.to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5
            share = np.clip(share, 0, np.nextafter(1, 0))
            own = ids.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(known, own)
            hit = np.r_[known, 0][at] == own if len(known) else np.zeros(len(own), bool)
            hit &= at < len(known)
            inside = np.where(hit, (share * np.r_[many, 1][at]).astype(np.int64), 0)  # an id between two steps lies in the first range of the later one
            yield pa.array(np.where(there, starts[at] + inside, (share * max(nulls, 1)).astype(np.int64)).astype(np.int32))

    return F.arrow_udf(find, "int")


def op7_fingerprints(spark: SparkSession, sf_dir: str, ranges: int | None = None) -> DataFrame:
    rows = ranged_with_next(table(spark, sf_dir, "documents"), ranges)
    sorted_rows = rows.repartition(F.col("range")).sortWithinPartitions("range", F.desc("own"), F.col("doc_id").asc_nulls_first(), "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is awaited: range, doc_id, text, sketch
        for part in slices(batches):
            ids, texts, ranges_, owns = (part.column(k).to_pylist() for k in (0, 1, 2, 4))
            pairs = []
            for d, text, r, own, mine in zip(ids, texts, ranges_, owns, in_batches(texts), strict=True):
                if held is not None and held[0] == r:
                    cut = len(held[2]) // 4
                    pairs.append((held, held[2][: len(held[2]) - cut] + text[:cut], mine))
                held = (r, d, text, mine) if own else None
            if pairs:
                theirs = in_batches([edited for _, edited, _ in pairs])
                yield batch([finished(*pair, new) for pair, new in zip(pairs, theirs, strict=True)])

    def finished(held: tuple, edited: str, following: np.ndarray, theirs: np.ndarray) -> tuple:
        _, d, text, mine = held
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return d, len(text), digest, as_string(mine), as_string(theirs), likeness(mine, theirs), likeness(mine, following)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return sorted_rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
