"""Search queries over documents and their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ann, resolve, retrieval
from millrace.operators.paging import first_by
from millrace.operators.postings import NameIndex, built
from millrace.plans.base import Registry

query = Registry()
COS = "round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))), 6)"


def chunks(t):
    """documents as chunks: half of them have a vector."""
    docs, vectors = t("documents").select("doc_id", "text", "lang", "source"), t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id", "left")


def vector_of(t, vec_id: int) -> list[float]:
    return list(t("embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@query("r2_multimodal_rrf", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 3),
e AS (SELECT vec_id AS id, label, {COS.format(a="embedding", b="v")} AS s FROM embeddings, q),
r AS (SELECT CASE label % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'document' WHEN 2 THEN 'image' ELSE 'video' END AS modality, id, s FROM e),
n AS (SELECT modality, id, row_number() OVER (PARTITION BY modality ORDER BY s DESC, id) AS rank FROM r)
SELECT modality, id, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM n WHERE rank <= 20 ORDER BY score DESC, modality, id LIMIT 20""")
def multimodal(t):
    scored = retrieval.with_similarity(t("embeddings"), "embedding", vector_of(t, 3), "score").select(F.col("vec_id").alias("id"), "label", "score")
    names = {"audio": 0, "document": 1, "image": 2, "video": 3}
    return retrieval.multimodal({m: scored.where(F.col("label") % 4 == k).select("id", "score") for m, k in names.items()})


@query("r3_similar_items", f"""
WITH q AS (SELECT vec_id, embedding AS v, label AS l, vec_id % 10 AS n FROM embeddings WHERE vec_id = 5)
SELECT e.vec_id, {COS.format(a="embedding", b="v")} AS similarity FROM embeddings e, q
WHERE e.vec_id <> q.vec_id AND label = l AND abs(e.vec_id % 10 - n) <= 3 AND {COS.format(a="embedding", b="v")} >= 0.1
ORDER BY similarity DESC, vec_id LIMIT 50""")
def similar_items(t):
    rows = t("embeddings")
    source = rows.where("vec_id = 5").first()
    near = rows.where((F.col("vec_id") != 5) & (F.col("label") == source["label"]) & (F.abs(F.col("vec_id") % 10 - 5) <= 3))
    return retrieval.nearest(near, "vec_id", "embedding", list(source["embedding"]), 50, 0.1).select("vec_id", "similarity")


@query("r4_nearest_vectors", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 11)
SELECT vec_id, label, {COS.format(a="embedding", b="v")} AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 10""")
def nearest_vectors(t):
    return retrieval.nearest(t("embeddings"), "vec_id", "embedding", vector_of(t, 11), 10).select("vec_id", "label", "similarity")


TRIGRAMS = r"""list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
SIMILARITY = "round(len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))), 6)"


@query("r5_names_by_trigram", f"""
WITH n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name),
g AS (SELECT name, id, {TRIGRAMS.format(c="name")} AS x, {TRIGRAMS.format(c="'red bolts'")} AS y FROM n)
SELECT id, name, {SIMILARITY.format(a="x", b="y")} AS similarity FROM g WHERE {SIMILARITY.format(a="x", b="y")} > 0.3 ORDER BY similarity DESC, id LIMIT 20""")
def names_by_trigram(t):
    names = t("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    found = built(t.spark, "names of parts", t.path("part"), lambda: NameIndex.create(names, "id", "name")).nearest("red bolts", 20)
    return names.join(F.broadcast(found), "id").select("id", "name", "similarity")  # twenty rows


@query("r5_names_and_aliases", f"""
WITH n AS (SELECT p_partkey AS id, p_name AS name, 'code ' || p_brand AS alias FROM part), g AS (SELECT id, name, {TRIGRAMS.format(c="name")} AS x, {TRIGRAMS.format(c="alias")} AS z, {TRIGRAMS.format(c="'code brand#12'")} AS y FROM n)
SELECT id, name, {SIMILARITY.format(a="x", b="y")} AS similarity FROM g WHERE {SIMILARITY.format(a="x", b="y")} > 0.8 OR {SIMILARITY.format(a="z", b="y")} > 0.8 ORDER BY similarity DESC, id LIMIT 20""")
def names_and_aliases(t):
    """Found by an alias, ordered by the name."""
    names = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("code "), "p_brand")).alias("aliases"))
    found = built(t.spark, "names and codes of parts", t.path("part"), lambda: NameIndex.create(names, "id", "name", "aliases")).nearest("code Brand#12", 20, 0.8)
    return names.join(F.broadcast(found), "id").select("id", "name", "similarity")


@query("r6_similar_documents", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 9),
s AS (SELECT doc_id, source, left(text, 300) AS preview, {COS.format(a="embedding", b="v")} AS similarity FROM documents JOIN embeddings ON vec_id = doc_id, q WHERE doc_id <> 9),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, doc_id) AS r FROM s)
SELECT source, doc_id, preview, similarity FROM b WHERE r = 1 ORDER BY similarity DESC, source LIMIT 5""")
def similar_documents(t):
    near = retrieval.with_similarity(chunks(t).where("embedding IS NOT NULL AND doc_id <> 9"), "embedding", vector_of(t, 9))
    rows = near.select("source", "doc_id", F.substring("text", 1, 300).alias("preview"), "similarity")
    return retrieval.best_per_group(rows, "source", "similarity", "doc_id", 5)


@query("r8_keyword_modalities", """
SELECT 'page' AS kind, page_id AS id FROM pages WHERE contains(lower(html), 'trash')
UNION ALL SELECT 'turn', conv_id * 1000 + turn FROM conversations WHERE contains(lower(text), 'trash')
UNION ALL SELECT 'document', doc_id FROM documents WHERE contains(lower(text), 'trash')""")
def keyword_modalities(t):
    hit = lambda c: F.lower(c).contains("trash")
    pages = t("pages").where(hit("html")).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"))
    turns = t("conversations").where(hit("text")).select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return pages.unionByName(turns).unionByName(t("documents").where(hit("text")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")))


@query("r11_cosine_pairs", f"""
SELECT a.vec_id AS a, b.vec_id AS b, {COS.format(a="a.embedding", b="b.embedding")} AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 10 = b.vec_id % 10 AND a.vec_id < b.vec_id
WHERE {COS.format(a="a.embedding", b="b.embedding")} >= 0.2""")
def cosine_pairs(t):
    rows = t("embeddings").where("label IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").alias("vector"), F.xxhash64(F.size("embedding"), "label", F.col("vec_id") % 10).alias("group"))
    found = ann.alike(rows.withColumnRenamed("vec_id", "key"), rows.withColumnRenamed("vec_id", "q"), 0.2)
    return found.where("q < key").select(F.col("q").alias("a"), F.col("key").alias("b"), "similarity")


@query("x6_trigram_similarity", f"""
WITH n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, {TRIGRAMS.format(c="a.name")} AS x, {TRIGRAMS.format(c="b.name")} AS y FROM n a JOIN n b ON a.id < b.id)
SELECT a, b, {SIMILARITY.format(a="x", b="y")} AS similarity FROM p WHERE {SIMILARITY.format(a="x", b="y")} > 0.3""")
def trigram_similarity(t):
    """All pairs of distinct names over the threshold of the similarity operator; they meet on rare trigrams."""
    names = t("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return resolve.similar_names(names, "id", "name", None, 0.3, None)


@query("n4_distinct_on", "SELECT DISTINCT ON (source) source, doc_id, n_chars FROM documents ORDER BY source, n_chars DESC, doc_id")
def distinct_on(t):
    return first_by(t("documents").select("source", "doc_id", "n_chars"), ["source"], [-F.col("n_chars"), F.col("doc_id")])


QUERIES, ORACLE = query.queries, query.oracle
