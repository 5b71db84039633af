"""How far the sources of each language lie apart in their words, and which terms a source has more of than its language.

Prices of terms are smoothed shares of a source's words, whole numbers throughout. The distance of two sources is the sum of differences of prices over all the language's kept
terms. It isn't summed term by term: a term that one source has and another lacks costs what its count says, so a histogram of counts a source prices all of these
against the other's price for nothing; terms that neither has cost the same constant each; and where both have a term, a join of the sparse postings corrects what the histograms took for
one-sided. Rows are those of postings and histograms, never of sources times vocabulary.

Texts are counted in bounded dictionaries within tasks and leave them as partial counts, so a source, language or word with a third of all rows is summed up before any shuffle.

Defined cases: null text, lang and source are ''. Rows repeated are documents of their own. A group without terms has the smoothed price of nothing for each kept term. A language
without kept terms has distances of 0. Texts of any length are cut into words piece by piece, at a word's end. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.base import named, slices, table, written

#: Fixed values of the audit: smoothing, scale of prices, documents that a kept term stands in, ranks of terms.
SMOOTHING, SCALE, MIN_DOCS, TOP = 5, 1_000_000_000, 30, 50
#: Counts that a task holds at most before it passes them on, and bytes of a text that are cut into words at once.
HELD, PIECE = 400_000, 1 << 22
#: In UTF-8, letters of ASCII in lower case and all bytes beyond ASCII; the rest are blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a bounded piece each."""
    clean, at = text.encode("utf-8", "replace").translate(LETTERS), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    empty = lambda c, name: F.coalesce(named(c).cast("string"), F.lit("")).alias(name)
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang_, source_), (n, docs) in held.items():
                terms = pa.array(n, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang_, len(n)), pa.repeat(source_, len(n)), terms, pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())], names)
            held.clear()

        for part in slices(batches, 64):
            for lang_, source_, text_ in zip(*(c.to_pylist() for c in part.columns), strict=True):
                n, docs = held.setdefault((lang_, source_), (Counter(), Counter()))
                before, own = len(n), set()
                for words in terms_of(text_):
                    n.update(words)
                    own.update(words)
                docs.update(own)
                size += len(n) - before
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    partial = df.select(empty(lang, "lang"), empty(source, "source"), empty(text, "text")).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column | str, size: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (size + SMOOTHING * terms)), exactly; null where nothing is kept."""
    whole = lambda c: c.cast("decimal(20,0)")
    n = F.col(n) if isinstance(n, str) else n
    over = F.lit(SCALE).cast("decimal(10,0)") * whole(n + SMOOTHING)
    under = F.nullif(whole(F.col(size) + F.lit(SMOOTHING) * F.col(terms)), F.lit(0).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: 'pair' has each other source of the language by distance, 'term' the terms that the source has more of, to rank top."""
    counts = written(term_counts(df, lang, source, text), "counts")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_size"))
    postings = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all")
    postings = written(postings, "postings")
    empty = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    present = df.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct()
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("has"))
    groups = present.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "has", "terms", "lang_size"])
    groups = written(groups.withColumn("none", price(F.lit(0), "size", "terms")), "groups")

    priced = postings.join(groups, ["lang", "source"]).withColumns({"p": price("n", "size", "terms"), "q": price("all", "lang_size", "terms")})
    priced = written(priced.select("lang", "source", "term", "n", "p", "q", "none"), "priced")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    more = priced.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("has").alias("_has"), F.col("none").alias("_none"))
    pairs = groups.select("lang", "source", "terms", "has", "none").join(other, "lang").where(F.col("source") != F.col("item"))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    neither = pairs.select("lang", "source", "item", F.coalesce((F.col("terms") - F.col("has") - F.col("_has")) * gap("none", "_none"), F.lit(0)).alias("value"))
    histogram = priced.groupBy("lang", "source", "n", "p").agg(F.count(F.lit(1)).alias("many"))
    sided = histogram.join(pairs.select("lang", "source", "item", "_none"), ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("many") * gap("p", "_none")).alias("value"))
    posting = priced.select("lang", "term", "source", "p", "none")
    partner = posting.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("_p"), F.col("none").alias("_none"))
    correction = gap("p", "_p") - gap("p", "_none") - gap("none", "_p") + gap("none", "_none")
    both = posting.join(partner, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(correction).alias("value"))
    each_way = lambda d: d.unionByName(d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    far = neither.unionByName(each_way(written(sided, "sided"))).unionByName(each_way(written(both, "overlaps"))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    far = far.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return far.unionByName(more)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS size, count(*)::HUGEINT AS terms, sum(lang_n)::HUGEINT AS lang_size FROM dense GROUP BY lang, source),
priced AS (
  SELECT d.lang, d.source, d.term, d.n, (1 + 1000000000 * (d.n::HUGEINT + 5) // (s.size + 5 * s.terms))::BIGINT AS p, (1 + 1000000000 * (d.lang_n::HUGEINT + 5) // (s.lang_size + 5 * s.terms))::BIGINT AS q
  FROM dense d JOIN sizes s ON s.lang = d.lang AND s.source = d.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM priced a JOIN priced b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN far f ON f.lang = g.lang AND f.source = g.source AND f.item = o.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
