"""URL filters: a blocked Bloom filter of the listed canonical URLs passes possible hits to an exact hash join.

Rules are (host, path) prefixes that allow or block a host and all its subdomains; the longest that fits wins. The rest is judged by
a list of canonical URLs. Every URL offers a few keys: each suffix of its host that has as many labels as rules have, with each path prefix of a
length that rules have, and its canonical form. Keys that the filter rules out are dropped in the scan; only the possible hits are shuffled, and the join on
the whole key takes the filter's false positives out. The filter has BITS bits a key in blocks of 256 bits, MAX_BLOCKS at most. A list of so many keys that fewer than
LEAST_BITS were left for each gets no filter, which then would spare nothing: all keys go to the join, and the answers are the same.

Defined cases: a null URL, or one without ://, has an empty host and path, fits no rule, and is allowed. A host ends at /, ?, # or
the end; its labels, and a path's characters, may be many. Repeated rows keep a row each. With rules of equal length on one key, block wins.
Empty tables, lists and rules give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import named, table, written

#: A filter has BITS bits a key, and at most MAX_BLOCKS blocks, which are 16 MB; beyond 33 million keys there are fewer than LEAST_BITS.
WORDS, BITS, MAX_BLOCKS, LEAST_BITS = 8, 16, 1 << 19, 4
#: Odd multipliers that choose one bit in each of a block's eight words.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint64)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: The query's list, which stands in for one that is published: the canonical URL of every LISTED_SHARE-th page by the URL's hash.
LISTED_SHARE = 16


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str | Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: str | Column) -> Column:
    """The query string with its question mark; '' where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]+)", 1), F.lit(""))


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Host without www. and the usual ports, path without a last slash or an index page, the query string as it is; fragments are gone already."""
    bare = F.regexp_replace(host, r"\A(?:www\.)|:(?:80|443)\z", "")
    return F.concat(bare, F.regexp_replace(path, r"(?:/index\.html?|/)\z", ""), query)


def _spots(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and its bit in each of the block's words."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    bits = (((h & np.uint64(0xFFFFFFFF))[:, None] * SALTS) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return block, np.uint32(1) << bits.astype(np.uint32)


def build_filter(keys: DataFrame, blocks: int | None = None) -> np.ndarray:
    """The filter of the column key: each task ORs its keys into blocks, the blocks of all tasks are ORed; at most `blocks` rows reach the driver.

    blocks: as many as BITS bits a key ask for, a power of two up to MAX_BLOCKS, if it isn't given.
    """
    blocks = blocks or min(MAX_BLOCKS, max(64, 1 << math.ceil(math.log2(keys.count() * BITS / (32 * WORDS) + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros((blocks, WORDS), np.uint32)
        for batch in batches:
            block, bits = _spots(batch.column(0).to_numpy(zero_copy_only=False), blocks)
            np.bitwise_or.at(filled, block, bits)
        used = np.flatnonzero(filled.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(filled[used, k].astype(np.int64)) for k in range(WORDS))], names=["block", *(f"w{k}" for k in range(WORDS))])

    parts = keys.select(F.xxhash64("key")).mapInArrow(run, "block bigint, " + ", ".join(f"w{k} bigint" for k in range(WORDS)))
    out = np.zeros((blocks, WORDS), np.uint32)
    for row in parts.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]).toLocalIterator():
        out[row["block"]] = [row[f"w{k}"] for k in range(WORDS)]
    return out


def may_hold(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the keys with these hashes (Spark's xxhash64) the filter may hold. For use within a task that has a Python worker anyway: maybe_listed() takes one more."""
    block, bits = _spots(hashes, len(filter_))
    return ((filter_[block] & bits) == bits).all(axis=1)


def maybe_listed(filter_: np.ndarray):
    """A column function of an array of keys: those that the filter may hold."""
    shared = filter_

    def probe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for hashes in batches:
            yield pa.array(may_hold(shared, hashes.to_numpy(zero_copy_only=False)))

    return F.arrow_udf(probe, "boolean")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, blocks: int | None = None, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict, listed. rules: host, path, verdict. listed: key, a canonical URL."""
    dots = lambda h: F.size(F.split(h, r"\.", -1))
    named_ = rules.select(F.concat(F.col("host"), F.col("path")).alias("key"), F.length("path").alias("n"), dots("host").alias("labels"), F.col("verdict").alias("v"))
    shapes = sorted((r["labels"], r["n"]) for r in named_.select("labels", "n").distinct().toLocalIterator())  # the rules' shapes: bounded by the longest rule
    every = named_.select("key", "v").unionByName(listed.select("key", F.lit(None).cast("string").alias("v"))).distinct()
    every = written(every.groupBy("key").agg(F.max("v").alias("v"), F.max(F.col("v").isNull()).alias("on_list")), "url-keys")
    fits = blocks or every.count() * LEAST_BITS <= MAX_BLOCKS * 32 * WORDS
    passes = maybe_listed(build_filter(every, blocks)) if fits else lambda _: F.lit(True)

    rows = pages.select(named(id_col).alias("id"), host_of(named(url)).alias("host"), path_of(named(url)).alias("path"), query_of(named(url)).alias("query"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "url-rows")  # so that row stays what it is
    offered = [F.struct(F.when(dots("host") >= k, F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n))).alias("key"), F.lit(False).alias("whole")) for k, n in shapes]
    offered.append(F.struct(canonical(F.col("host"), F.col("path"), F.col("query")).alias("key"), F.lit(True).alias("whole")))
    asked = rows.where("host <> ''").select("row", F.explode(F.array_distinct(F.array(*offered))).alias("k")).select("row", "k.key", "k.whole")
    possible = asked.where(F.col("key").isNotNull() & passes(F.xxhash64("key")))
    met = possible.join(every, "key").groupBy("row").agg(
        F.max(F.when(~F.col("whole") & F.col("v").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key"), F.col("v")))).alias("best"),
        F.max(F.col("whole") & F.col("on_list")).alias("on_list"),
    )
    out = rows.join(met, "row", "left")
    hit = F.coalesce("on_list", F.lit(False))
    verdict = F.coalesce(F.col("best.v"), F.when(hit, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"), hit.alias("listed"))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: key, the canonical URL of every LISTED_SHARE-th page by the hash of it."""
    keys = pages.where(host_of("url") != "").select(canonical(host_of("url"), path_of("url"), query_of("url")).alias("key"))
    return keys.where(F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long") % LISTED_SHARE == 0).distinct()


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """A published list, one URL a line, as keys for judge(); blank lines, lines that start with # and those without :// are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''").where(~F.col("url").startswith("#"))
    return lines.where(host_of("url") != "").select(canonical(host_of("url"), path_of("url"), query_of("url")).alias("key")).distinct()


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark), listed_urls(pages)).drop("listed")


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*(\?[^#]+)', 1), '') AS query, row_number() OVER () AS r FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM parts, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
bare AS (
  SELECT r, page_id, host, path, CASE WHEN host = '' THEN '' ELSE regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '(/index\.html?|/)$', '') || query END AS key FROM parts),
listed AS (SELECT DISTINCT key FROM bare WHERE key <> '' AND ('0x' || md5(key)[1:8])::BIGINT % 16 = 0)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM bare LEFT JOIN best USING (r)
"""
