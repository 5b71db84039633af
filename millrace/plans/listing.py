"""Scans, filters, joins, sorting, pages and set operations."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace.operators import paging
from millrace.plans.base import Registry

query = Registry()
c = F.col


@query("s1_projection_scan", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40")
def projection(t):
    return t("part").where("p_size > 40").select("p_partkey", "p_name", "p_size")


@query("s2_embedded_outer", "SELECT c_custkey, c_name, CASE WHEN c_nationkey % 2 = 0 THEN n_name END AS nation, CASE WHEN c_nationkey % 2 = 0 THEN n_regionkey END AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def embedded_outer(t):
    even = t("nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("nation"))
    joined = t("customer").join(even, c("c_nationkey") == c("n_nationkey"), "left")
    return joined.select("c_custkey", "c_name", c("nation.n_name").alias("nation"), c("nation.n_regionkey").alias("region"))


@query("s3_embedded_inner", "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000")
def embedded_inner(t):
    some = t("customer").where("c_mktsegment = 'BUILDING'")
    return t("orders").where("o_totalprice > 300000").join(some, c("o_custkey") == c("c_custkey")).select("o_orderkey", "o_totalprice", "c_name")


@query("s4_same_dim_twice", """
SELECT l_orderkey, l_linenumber, b.n_name AS buyer, s.n_name AS seller FROM lineitem JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation b ON c_nationkey = b.n_nationkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey
WHERE l_quantity > 48""")
def same_dim_twice(t):
    buyer = t("nation").select(c("n_nationkey").alias("bk"), c("n_name").alias("buyer"))
    seller = t("nation").select(c("n_nationkey").alias("sk"), c("n_name").alias("seller"))
    rows = t("lineitem").where("l_quantity > 48").join(t("orders"), c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey"), "left").join(t("supplier"), c("l_suppkey") == c("s_suppkey"), "left")
    return rows.join(buyer, c("c_nationkey") == c("bk"), "left").join(seller, c("s_nationkey") == c("sk"), "left").select("l_orderkey", "l_linenumber", "buyer", "seller")


@query("p1_optional_filters", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def optional_filters(t):
    return paging.optional(t("orders"), o_orderpriority="1-URGENT", o_orderstatus=None).select("o_orderkey", "o_orderstatus")


@query("p2_inclusive_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-03-31'")
def inclusive_range(t):
    return paging.between(t("orders"), "o_orderdate", datetime.datetime(1996, 1, 1), datetime.datetime(1996, 3, 31)).select("o_orderkey", "o_orderdate")


@query("p3_substring", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BOLT%'")
def substring(t):
    return t("part").where(paging.contains_text("p_name", "BOLT")).select("p_partkey", "p_name")


@query("p4_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'r%'")
def prefix(t):
    return t("part").where(F.startswith(F.lower("p_name"), F.lit("r"))).select("p_partkey", "p_name")


@query("p5_like_escape", "SELECT doc_id FROM documents WHERE contains(lower(text), '***') OR contains(text, '%%%')")
def like_escape(t):
    return t("documents").where(paging.any_of(paging.contains_text("text", "***"), paging.contains_text("text", "%%%"))).select("doc_id")


ORDER_SUPPLIERS = "SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS s FROM lineitem GROUP BY l_orderkey"


def order_suppliers(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))


@query("p6_or_over_arrays", f"SELECT l_orderkey FROM ({ORDER_SUPPLIERS}) WHERE l_orderkey = 7 OR list_contains(s, 5)")
def or_over_arrays(t):
    return order_suppliers(t).where(paging.any_of(c("l_orderkey") == 7, F.array_contains("s", F.lit(5).cast("long")))).select("l_orderkey")


@query("p8_array_overlap", f"SELECT l_orderkey, len(s)::INT AS n FROM ({ORDER_SUPPLIERS}) WHERE list_has_any(s, [1, 2, 3])")
def array_overlap(t):
    wanted = F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])
    return order_suppliers(t).where(F.arrays_overlap("s", wanted)).select("l_orderkey", F.size("s").alias("n"))


@query("p9_any_element", """
WITH x AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS p FROM orders GROUP BY o_custkey)
SELECT o_custkey, len(p)::INT AS n FROM x WHERE len(list_filter(p, lambda y: contains(lower(y), 'urgent'))) > 0 ORDER BY o_custkey LIMIT 20""")
def any_element(t):
    rows = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return rows.where(paging.any_contains("p", "URGENT")).orderBy("o_custkey").limit(20).select("o_custkey", F.size("p").alias("n"))


@query("p10_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) = 7")
def json_path(t):
    rows = t("events").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "int"))
    return rows.where("k = 7").select("event_id", "k")


@query("p12_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'")
    return t("customer").join(urgent, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("p13_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def not_exists(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'")
    return t("customer").join(urgent, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("p18_three_valued", """
WITH s AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 10 END AS n FROM embeddings), q AS (SELECT 5 AS n UNION ALL SELECT NULL)
SELECT vec_id, q.n AS wanted FROM s, q WHERE q.n IS NULL OR abs(s.n - q.n) <= 3""")
def three_valued(t):
    rows = t("embeddings").select("vec_id", F.when(c("vec_id") % 4 != 0, c("vec_id") % 10).alias("n"))
    known = rows.where(F.abs(c("n") - 5) <= 3).select("vec_id", F.lit(5).alias("wanted"))
    return known.unionByName(rows.select("vec_id", F.lit(None).cast("int").alias("wanted")))


@query("p20_day_of_year", "SELECT o_orderkey, o_orderdate FROM orders WHERE month(o_orderdate) = 7 AND day(o_orderdate) = 4")
def day_of_year(t):
    return t("orders").where((F.month("o_orderdate") == 7) & (F.dayofmonth("o_orderdate") == 4)).select("o_orderkey", "o_orderdate")


@query("p21_defaults", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN [c_mktsegment] END, []) AS tags FROM customer")
def defaults(t):
    return t("customer").select("c_custkey", F.coalesce(F.when(c("c_custkey") % 3 == 0, F.array("c_mktsegment")), F.array().cast("array<string>")).alias("tags"))


@query("p22_difficulty", """
SELECT doc_id, CASE WHEN n_chars / 500.0 < 5 THEN 'easy' WHEN n_chars / 500.0 <= 20 THEN 'medium' ELSE 'hard' END AS difficulty, round(doc_id % 7 + 0.1::DOUBLE * (n_chars // 500), 6) AS priority
FROM documents ORDER BY priority DESC, doc_id LIMIT 30""")
def difficulty(t):
    pages, exact = F.floor(c("n_chars") / 500), c("n_chars") / 500
    level = F.when(exact < 5, "easy").when(exact <= 20, "medium").otherwise("hard")
    rows = t("documents").select("doc_id", level.alias("difficulty"), F.round(c("doc_id") % 7 + 0.1 * pages, 6).alias("priority"))
    return rows.orderBy(F.desc("priority"), "doc_id").limit(30)


@query("j3_left_extra_predicate", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def left_extra(t):
    opened = t("orders").where("o_orderstatus = 'O'").groupBy(c("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return t("customer").join(opened, c("c_custkey") == c("k"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j4_full_outer", """
SELECT coalesce(a.k, b.k) AS k, a.n AS bought, b.n AS acted FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a
FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b ON a.k = b.k""")
def full_outer(t):
    a = t("orders").groupBy(c("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("bought"))
    b = t("events").groupBy(c("user_id").alias("k")).agg(F.count(F.lit(1)).alias("acted"))
    return a.join(b, "k", "full")


@query("j8_lateral_unnest", f"""
WITH s AS ({ORDER_SUPPLIERS}), x AS (SELECT l_orderkey, CASE WHEN len(s) > 3 THEN s ELSE [] END AS s FROM s), u AS (SELECT l_orderkey, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS k FROM x)
SELECT l_orderkey, s_name FROM u LEFT JOIN supplier ON k = s_suppkey""")
def lateral_unnest(t):
    rows = order_suppliers(t).select("l_orderkey", F.explode_outer(F.when(F.size("s") > 3, c("s")).otherwise(F.array().cast("array<bigint>"))).alias("k"))
    return rows.join(t("supplier"), c("k") == c("s_suppkey"), "left").select("l_orderkey", "s_name")


@query("j9_lateral_json", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")
def lateral_json(t):
    rows = t("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))
    return rows.select("event_id", "key", "value")


@query("j6_disjunctive_join", """
WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b FROM lineitem), f AS (SELECT s_suppkey AS x FROM supplier WHERE s_nationkey = 7)
SELECT x, CASE WHEN a = x THEN b ELSE a END AS neighbour, count(*) AS n FROM e JOIN f ON a = x OR b = x WHERE a <> b GROUP BY 1, 2""")
def disjunctive_join(t):
    from millrace.operators.graph import symmetric

    other = c("l_partkey") % 100
    edges = t("lineitem").select(F.least("l_suppkey", other).alias("a"), F.greatest("l_suppkey", other).alias("b")).distinct()
    frontier = t("supplier").where("s_nationkey = 7").select(c("s_suppkey").alias("x"))
    return symmetric(edges).join(frontier, c("src") == c("x")).groupBy("x", c("dst").alias("neighbour")).agg(F.count(F.lit(1)).alias("n"))


@query("j15_update_from", "SELECT p_partkey, coalesce(q, p_size)::DOUBLE AS size FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey")
def update_from(t):
    known = t("lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.max("l_quantity").alias("q"))
    return t("part").join(known, c("p_partkey") == c("l_partkey"), "left").select("p_partkey", F.coalesce("q", c("p_size").cast("double")).alias("size"))


@query("j17_shared_sets", """
SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_suppkey = 8""")
def shared_sets(t):
    a, b = (t("lineitem").where(c("l_suppkey") == k).select("l_orderkey") for k in (3, 8))
    return a.distinct().join(b, "l_orderkey", "left_semi")


@query("o2_nulls_last", "SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN label END AS label FROM embeddings ORDER BY 2 DESC NULLS LAST, vec_id LIMIT 40")
def nulls_last(t):
    rows = t("embeddings").select("vec_id", F.when(c("vec_id") % 3 > 0, c("label")).alias("label"))
    return paging.page_of(rows, (("label", True), ("vec_id", False)), paging.Page(1, 40))


@query("o3_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page(t):
    return paging.page_of(t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), (("o_totalprice", True), ("o_orderkey", False)), paging.Page(3, 25))


@query("o4_envelope", "SELECT count(*) AS total, 3 AS page, 25 AS per_page, 75 < count(*) AS has_more FROM orders WHERE o_orderstatus = 'F'")
def envelope(t):
    return paging.envelope(t("orders").where("o_orderstatus = 'F'"), paging.Page(3, 25))


@query("o6_merged_feed", """
WITH f AS (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS "at" FROM orders UNION ALL SELECT 'event', event_id, ts FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem) SELECT * FROM f ORDER BY "at" DESC, kind || id LIMIT 50""")
def merged_feed(t):
    orders = t("orders").select(F.lit("order").alias("kind"), c("o_orderkey").alias("id"), c("o_orderdate").cast("timestamp").alias("at"))
    events = t("events").where("event_type = 'purchase'").select(F.lit("event").alias("kind"), c("event_id").alias("id"), c("ts").cast("timestamp").alias("at"))
    lines = t("lineitem").select(F.lit("line").alias("kind"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_shipdate").cast("timestamp").alias("at"))
    tied = [f.withColumn("tie", F.concat("kind", "id")) for f in (orders, events, lines)]
    return paging.merge_feeds(tied, "at", "tie", 50).drop("tie").withColumn("at", c("at").cast("timestamp_ntz"))


@query("o7_random_row", "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 1")
def random_row(t):
    return paging.random_row(t("documents").select("doc_id", "source"), 42, "doc_id")


@query("u5_first_list_wins", """
WITH x AS (SELECT lower(p_name) AS k, p_name AS name, 0 AS o, p_partkey AS id FROM part WHERE p_size < 20 UNION ALL SELECT lower(p_name), upper(p_name), 1, p_partkey FROM part WHERE p_size >= 20)
SELECT DISTINCT ON (k) k, name, id FROM x ORDER BY k, o, id""")
def first_list_wins(t):
    a = t("part").where("p_size < 20").select(F.lower("p_name").alias("k"), c("p_name").alias("name"), F.lit(0).alias("o"), c("p_partkey").alias("id"))
    b = t("part").where("p_size >= 20").select(F.lower("p_name").alias("k"), F.upper("p_name").alias("name"), F.lit(1).alias("o"), c("p_partkey").alias("id"))
    return paging.first_by(a.unionByName(b), ["k"], [c("o"), c("id")]).select("k", "name", "id")


@query("u6_array_union", f"""
WITH s AS ({ORDER_SUPPLIERS}) SELECT l_orderkey, list_sort(list_distinct(list_concat(s, [l_orderkey % 100, 1]))) AS s FROM s""")
def array_union(t):
    return order_suppliers(t).select("l_orderkey", F.sort_array(F.array_union("s", F.array(c("l_orderkey") % 100, F.lit(1).cast("long")))).alias("s"))


@query("q2_15_replies", """
SELECT conv_id, min(turn) AS first_turn, count(*) AS n, count(*) FILTER (role = 'assistant') AS replies FROM conversations GROUP BY conv_id ORDER BY n DESC, conv_id LIMIT 50""")
def replies(t):
    rows = t("conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"), F.count_if(c("role") == "assistant").alias("replies"))
    return paging.page_of(rows, (("n", True), ("conv_id", False)), paging.Page(1, 50))


@query("q2_15_document_bundle", """
SELECT d.doc_id, d.source, l.quality, l.toxic, v.label, c.turns FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings v ON v.vec_id = d.doc_id
LEFT JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) c ON c.conv_id = d.doc_id""")
def document_bundle(t):
    turns = t("conversations").groupBy(c("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("turns"))
    vectors = t("embeddings").select(c("vec_id").alias("doc_id"), "label")
    return t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left").join(vectors, "doc_id", "left").join(turns, "doc_id", "left")


QUERIES, ORACLE = query.queries, query.oracle
