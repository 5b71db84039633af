"""The rest of the inventory: simple joins, aggregates, listings and updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.scores import evidence_strength, length_match
from millrace.functions.vector import cosine_to
from millrace.operators import ann, cascade, graph, ledger, paging, resolve, rollup, views
from millrace.plans import graphs
from millrace.plans.base import Registry
from millrace.plans.graphs import EDGES, START, edges, start
from millrace.plans.retrieval import COS, vector_of

query = Registry()
c = F.col


def one():
    return F.count(F.lit(1))


SUMMARY = "SELECT o_orderstatus AS status, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1"


@query("s5_saved_view", f"SELECT 'saved' AS way, * FROM ({SUMMARY}) UNION ALL SELECT 'live', status, n * 2, last FROM ({SUMMARY})")
def saved_view(t):
    """One summary that is saved and read, though its live computation would now differ, and one that is computed, as none is saved."""
    def live(times):
        return t("orders").groupBy(c("o_orderstatus").alias("status")).agg((one() * times).alias("n"), F.max("o_orderdate").alias("last"))

    spark = t("orders").sparkSession
    folder = views.new_folder(spark)
    views.refresh(live(1), f"{folder}/summary")
    return reduce(DataFrame.unionByName, [views.saved(spark, f"{folder}/{k}", lambda: live(2)).select(F.lit(way).alias("way"), "*") for way, k in (("saved", "summary"), ("live", "none"))])


@query("s9_quoted_csv", "SELECT p_partkey, 'a,b' AS f0, p_name AS f1, 3 AS n FROM part")
def quoted_csv(t):
    from millrace.sources.loadfiles import csv_fields

    f = csv_fields(F.concat(F.lit('"a,b" , '), "p_name", F.lit(", x")))
    return t("part").select("p_partkey", F.get(f, F.lit(0)).alias("f0"), F.get(f, F.lit(1)).alias("f1"), F.size(f).alias("n"))


@query("s11_coalesced_text", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE source || lang END AS text FROM documents")
def coalesced_text(t):
    d = c("doc_id") % 3
    rows = t("documents").select("doc_id", F.when(d == 0, c("source")).otherwise("").alias("text"), F.when(d == 1, c("lang")).alias("content"), F.concat("source", "lang").alias("page_content"))
    from millrace.sources.loadfiles import first_field

    return rows.select("doc_id", first_field(rows, ("text", "content", "chunk", "page_content")).alias("text"))


RECORDS = """CASE c_custkey % 4 WHEN 0 THEN '{"name":"' || c_name || '","location":"' || c_mktsegment || '"}' WHEN 1 THEN '{"date":"2003-05-01","from":"ABC","arrival":"XYZ","person":"' || c_name || '"}'
WHEN 2 THEN '[{"flight_date":"2004-06-02","departure":"QRS","manifest":["A B","C D"]},{"person":"' || c_name || '","entity_type":"place"}]' ELSE 'no record' END"""


@query("s18_entities", f"""
SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 4 = 2 THEN 'place' ELSE 'person' END AS entity_type, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS location FROM customer WHERE c_custkey % 4 < 3""")
def entity_records(t):
    from millrace.sources.loadfiles import entities_and_flights

    return entities_and_flights(t("customer").select("c_custkey", F.expr(RECORDS).alias("text")), "text")[0]


@query("s18_flights", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN '2003-05-01' ELSE '2004-06-02' END AS flight_date, CASE WHEN c_custkey % 4 = 1 THEN 'ABC' ELSE 'QRS' END AS departure, CASE WHEN c_custkey % 4 = 1 THEN 'XYZ' END AS arrival, CASE WHEN c_custkey % 4 = 2 THEN ['A B', 'C D'] ELSE [] END AS passengers
FROM customer WHERE c_custkey % 4 IN (1, 2)""")
def flight_records(t):
    from millrace.sources.loadfiles import entities_and_flights

    return entities_and_flights(t("customer").select("c_custkey", F.expr(RECORDS).alias("text")), "text")[1]


@query("s25_extension_counts", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' ELSE 'video' END AS kind, count(*) AS n, sum(CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS pages FROM part GROUP BY 1")
def extension_counts(t):
    from millrace.sources.loadfiles import media_kind

    name = F.get(F.array(F.lit("a.pdf"), F.lit("b.png"), F.lit("c.mov")), (c("p_partkey") % 3).cast("int"))
    kind = F.coalesce(media_kind(name), F.when(F.endswith(name, F.lit(".pdf")), "pdf"))
    return t("part").select(kind.alias("kind")).groupBy("kind").agg(one().alias("n"), F.sum(F.when(c("kind") == "pdf", 5).when(c("kind") == "image", 1).otherwise(0)).alias("pages"))


@query("s28_lookup_enrichment", "SELECT s_suppkey, n_name AS label, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS descriptions FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = s_nationkey GROUP BY 1, 2")
def lookup(t):
    found = t("customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), "|").alias("descriptions"))
    return t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey")).join(found, c("s_nationkey") == c("c_nationkey"), "left").select("s_suppkey", c("n_name").alias("label"), "descriptions")


@query("w1_valid_rows", "SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_discount NOT BETWEEN 0.01 AND 0.09 THEN 'discount' END, CASE WHEN l_quantity > 45 THEN 'quantity' END], lambda x: x IS NOT NULL) AS errors FROM lineitem")
def valid_rows(t):
    return ledger.checked(t("lineitem"), {"discount": c("l_discount").between(0.01, 0.09), "quantity": c("l_quantity") <= 45}).select("l_orderkey", "l_linenumber", "errors")


@query("w4_find_or_create", """
WITH w AS (SELECT lower(p_name) AS k, p_type, count(*) AS met FROM part GROUP BY 1, 2), f AS (SELECT lower(p_name) AS k, p_type, min(p_partkey::VARCHAR) AS id FROM part WHERE p_size < 10 GROUP BY 1, 2)
SELECT k, p_type, coalesce(id, md5(k || '|' || p_type)) AS id, met, id IS NULL AS created FROM w LEFT JOIN f USING (k, p_type)""")
def find_or_create(t):
    named = t("part").select(F.lower("p_name").alias("k"), "p_type", c("p_partkey").alias("id"), "p_size")
    return resolve.find_or_create(named, named.where("p_size < 10"), ["k", "p_type"])


@query("w6_edge_upsert", f"WITH {EDGES} SELECT a, b, round(least(10.0::DOUBLE, 1 + ln(n)), 6) AS strength, 'seen together ' || n || ' times' AS description FROM e")
def edge_upsert(t):
    return edges(t).select("a", "b", F.round(evidence_strength(c("n")), 6).alias("strength"), F.concat(F.lit("seen together "), "n", F.lit(" times")).alias("description"))


@query("w7_replace_document", "SELECT doc_id, doc_id % 10 AS part, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE source END AS v FROM documents")
def replace_document(t):
    """Delete, then insert: the partitions that come anew are replaced in the stored table, twice with the same outcome."""
    rows = t("documents").select("doc_id", (c("doc_id") % 10).alias("part"), c("source").alias("v"))
    spark = t("documents").sparkSession
    path = f"{views.new_folder(spark)}/documents"
    ledger.overwrite_partitions(rows, path, "part")
    for _ in range(2):
        ledger.overwrite_partitions(rows.where("part = 0").withColumn("v", F.lit("new")), path, "part")
    return spark.read.parquet(path).select("doc_id", c("part").cast("long").alias("part"), "v")


@query("w9_mark_rows", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000 AND doc_id % 5 > 0 ORDER BY doc_id LIMIT 50) OR doc_id % 5 = 0 THEN 'true' END AS validated FROM documents")
def mark_rows(t):
    rows = t("documents").select("doc_id", "n_chars", F.when(c("doc_id") % 5 == 0, "true").alias("validated"))
    return ledger.mark(rows, c("n_chars") > 1000, "validated", "doc_id", 50).select("doc_id", "validated")


@query("w10_backfill_sizes", "SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN page_id * 10 END, length(html))::BIGINT AS size FROM pages")
def backfill_sizes(t):
    stored = t("pages").select(c("page_id").alias("k"), F.length("html").alias("n"))
    rows = t("pages").select("page_id", F.when(c("page_id") % 2 == 0, c("page_id") * 10).alias("size"))
    return rows.join(stored, c("page_id") == c("k"), "left").select("page_id", F.coalesce("size", "n").cast("long").alias("size"))


@query("w13_annotation_votes", "SELECT user_id, count(*) FILTER (event_type = 'click') AS up, count(*) FILTER (event_type = 'view') AS down FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def annotation_votes(t):
    return ledger.tally(t("events").where("event_type IN ('click', 'view')"), "user_id", "event_type", {"up": "click", "down": "view"})


@query("w22_transition", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'done' ELSE o_orderstatus END AS status FROM orders")
def transition(t):
    return t("orders").select("o_orderkey", cascade.transition(c("o_orderstatus"), ("O", "P"), "done").alias("status"))


@query("w26_spend_log", "SELECT CASE WHEN event_type <> 'view' THEN event_type END AS campaign, count(*) AS entries, round(sum(value), 4) AS spent FROM events GROUP BY 1")
def spend_log(t):
    rows = t("events").select("event_id", F.when(c("event_type") != "view", c("event_type")).alias("campaign"), "value")
    counters = ledger.log_spend(rows.where("event_id % 3 > 0"), rows.where("event_id % 3 = 0"), "campaign", "value")[1]
    return counters.withColumn("spent", F.round("spent", 4))


@query("w28_patch_by_file", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND n_chars > 10 THEN left(text, 2000) END AS excerpt FROM documents")
def patch_by_file(t):
    patch = t("documents").where("doc_id % 2 = 0").select(F.concat(F.upper(F.concat(F.lit("d"), "doc_id")), F.lit(".pdf")).alias("file"), F.substring("text", 1, 2000).alias("excerpt")).where(F.length("excerpt") > 10)
    rows = t("documents").select("doc_id", F.concat(F.lit("D"), "doc_id", F.lit(".pdf")).alias("f"))
    return rows.join(patch, c("f") == c("file"), "left").select("doc_id", "excerpt")


@query("p7_array_contains", "SELECT user_id FROM (SELECT user_id, list(event_type) AS l FROM events WHERE value > 30 GROUP BY 1) WHERE list_contains(l, 'signup')")
def array_contains(t):
    return t("events").where("value > 30").groupBy("user_id").agg(F.collect_set("event_type").alias("l")).where(F.array_contains("l", "signup")).select("user_id")


@query("p11_both_ends_inside", f"WITH {EDGES} SELECT a, b FROM e WHERE a % 2 = 0 AND b % 2 = 0")
def both_ends(t):
    inside = t("part").where("p_partkey % 2 = 0").select(c("p_partkey").alias("k"))
    return edges(t).join(inside, c("a") == c("k"), "left_semi").join(inside, c("b") == c("k"), "left_semi").select("a", "b")


@query("p17_vector_threshold", f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 2) SELECT vec_id FROM embeddings, q WHERE {COS.format(a='embedding', b='v')} >= 0.1")
def vector_threshold(t):
    return t("embeddings").where(F.round(cosine_to(c("embedding"), vector_of(t, 2)), 6) >= 0.1).select("vec_id")


@query("p26_needs_stage", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL AND n_chars > 500")
def needs_stage(t):
    return t("documents").where("n_chars > 500").join(t("labels").where("quality IS NOT NULL"), "doc_id", "left_anti").select("doc_id")


@query("j1_inner_equi", "SELECT doc_id, label FROM documents JOIN embeddings ON vec_id = doc_id")
def inner_equi(t):
    return t("documents").select("doc_id").join(t("embeddings").select(c("vec_id").alias("doc_id"), "label"), "doc_id")


@query("j5_scalar_row", "SELECT p_partkey, p_retailprice > (SELECT avg(p_retailprice) FROM part) AS above FROM part")
def scalar_row(t):
    mean = t("part").agg(F.avg("p_retailprice").alias("m"))
    return t("part").join(F.broadcast(mean)).select("p_partkey", (c("p_retailprice") > c("m")).alias("above"))  # one row


@query("j7_other_endpoint", f"WITH {EDGES} SELECT src, sum(dst)::BIGINT AS others FROM s GROUP BY 1")
def other_endpoint(t):
    return graph.symmetric(edges(t)).groupBy("src").agg(F.sum("dst").alias("others"))


@query("j12_pairs_of_set", "WITH m AS (SELECT DISTINCT user_id, event_type AS k FROM events WHERE value > 40) SELECT x.k AS a, y.k AS b, count(*) AS n FROM m x JOIN m y USING (user_id) WHERE x.k < y.k GROUP BY 1, 2")
def pairs_of_set(t):
    from millrace.operators.resolve import cooccurrence

    return cooccurrence(t("events").where("value > 40"), "user_id", "event_type").select("a", "b", "n")


@query("j16_delete_weaker", """
WITH x AS (SELECT o_custkey AS k, o_orderpriority AS kind, max(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT k, s FROM x WHERE kind = '5-LOW' AND NOT EXISTS (SELECT 1 FROM x y WHERE y.k = x.k AND y.kind = '1-URGENT' AND y.s >= x.s)""")
def delete_weaker(t):
    x = t("orders").groupBy(c("o_custkey").alias("k"), c("o_orderpriority").alias("kind")).agg(F.max("o_totalprice").alias("s"))
    low, urgent = x.where("kind = '5-LOW'").alias("l"), x.where("kind = '1-URGENT'").alias("u")
    return low.join(urgent, (c("l.k") == c("u.k")) & (c("u.s") >= c("l.s")), "left_anti").select("k", "s")


@query("j21_resolver", "SELECT 'customer#000000007' AS wanted, c_custkey AS id, 1 AS tier FROM customer WHERE lower(c_name) = 'customer#000000007' UNION ALL SELECT '00001', min(c_custkey), 2 FROM customer WHERE contains(c_name, '00001')")
def resolver(t):
    """By exact name, else by part of the name, the smallest id first."""
    low = F.lower("c_name")
    tiers = reduce(DataFrame.unionByName, [t("customer").where(cond).select(F.lit(w).alias("wanted"), c("c_custkey").alias("id"), F.lit(tier).alias("tier")) for w in ("customer#000000007", "00001") for tier, cond in ((1, low == w), (2, low.contains(w)))])
    return paging.first_by(tiers, ["wanted"], [c("tier"), c("id")])


@query("a3_conditional_mean", "SELECT l_suppkey, coalesce(round(avg(l_discount) FILTER (l_tax > 0.07), 6), 0) AS mean FROM lineitem GROUP BY 1")
def conditional_mean(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.coalesce(F.round(F.avg(F.when(c("l_tax") > 0.07, c("l_discount"))), 6), F.lit(0.0)).alias("mean"))


@query("a5_distinct_kinds", "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1")
def distinct_kinds(t):
    return t("events").where("ts < '2024-01-10'").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"))


@query("a9_dates_in_json", "SELECT user_id, min(make_date(2024, 1, 1 + (CAST(json_extract(props, '$.k') AS INT) % 28))) AS first FROM events GROUP BY 1")
def dates_in_json(t):
    text = F.to_json(F.struct(F.concat(F.lit("2024-01-"), F.lpad((1 + F.try_variant_get(F.parse_json("props"), "$.k", "int") % 28).cast("string"), 2, "0")).alias("date")))
    return t("events").withColumn("j", text).groupBy("user_id").agg(F.min(F.try_to_date(F.get_json_object("j", "$.date"))).alias("first"))


@query("a14_max_then_sum", "SELECT u AS user_id, round(least(sum(m) / 40, 1.5), 6) AS score FROM (SELECT user_id AS u, event_type, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def max_then_sum(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max("value").alias("m")).groupBy("user_id").agg(F.round(F.least(F.sum("m") / 40, F.lit(1.5)), 6).alias("score"))


@query("a16_row_count", "SELECT count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem")
def row_count(t):
    from millrace.sources.loadfiles import from_footers

    return from_footers(t.spark, t.path("lineitem")).agg(one().alias("n"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


@query("a21_network_view", f"WITH {EDGES}, d AS (SELECT src, count(*) AS degree FROM s GROUP BY 1), mm AS (SELECT l_partkey, count(*) AS mentions FROM lineitem GROUP BY 1) SELECT p_partkey AS entity, coalesce(degree, 0) AS degree, coalesce(mentions, 0) AS mentions FROM part LEFT JOIN d ON src = p_partkey LEFT JOIN mm ON l_partkey = p_partkey WHERE mentions > 0 OR degree > 0")
def network_view(t):
    degree = graph.degrees(edges(t))
    mentions = t("lineitem").groupBy(c("l_partkey").alias("k")).agg(one().alias("mentions"))
    rows = t("part").join(degree, c("p_partkey") == c("node"), "left").join(mentions, c("p_partkey") == c("k"), "left").fillna(0, ["degree", "mentions"])
    return rows.where("mentions > 0 OR degree > 0").select(c("p_partkey").alias("entity"), "degree", "mentions")


@query("a22_mention_stats", "SELECT l_orderkey AS document, count(*) AS n, list_sort(list_distinct(list(l_returnflag))) AS kinds, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem WHERE l_suppkey = 4 GROUP BY 1")
def mention_stats(t):
    return t("lineitem").where("l_suppkey = 4").groupBy(c("l_orderkey").alias("document")).agg(one().alias("n"), F.sort_array(F.collect_set("l_returnflag")).alias("kinds"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("a26_counts_by_status", "SELECT CASE o_orderstatus WHEN 'O' THEN 'unsolved' WHEN 'F' THEN 'confirmed' ELSE 'proposed' END AS status, count(*) AS n FROM orders GROUP BY 1")
def counts_by_status(t):
    status = F.when(c("o_orderstatus") == "O", "unsolved").when(c("o_orderstatus") == "F", "confirmed").otherwise("proposed")
    return t("orders").groupBy(status.alias("status")).agg(one().alias("n"))


@query("a29_status_funnel", "SELECT count(*) AS total, count(*) FILTER (n_chars > 0) AS read, count(*) FILTER (n_chars > 1500) AS chunked, count(*) FILTER (label IS NOT NULL) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def status_funnel(t):
    rows = t("documents").join(t("embeddings").select(c("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    return rows.agg(one().alias("total"), F.count_if(c("n_chars") > 0).alias("read"), F.count_if(c("n_chars") > 1500).alias("chunked"), F.count("label").alias("embedded"))


@query("a32_passenger_pairs", "WITH m AS (SELECT DISTINCT l_orderkey AS d, l_suppkey AS e FROM lineitem) SELECT x.e AS a, y.e AS b, 0.8::DOUBLE AS strength, 'flight ' || max(x.d) AS description FROM m x JOIN m y USING (d) WHERE x.e < y.e GROUP BY 1, 2")
def passenger_pairs(t):
    pairs = resolve.cooccurrence(t("lineitem"), "l_orderkey", "l_suppkey")
    return pairs.select("a", "b", F.lit(0.8).alias("strength"), F.concat(F.lit("flight "), "last").alias("description"))


@query("a33_activity_groups", "SELECT event_type, ts::DATE AS day, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1, 2")
def activity_groups(t):
    return t("events").where("user_id = 7").groupBy("event_type", c("ts").cast("date").alias("day")).agg(one().alias("n"))


@query("a35_degree_inside", f"WITH {EDGES}, k AS (SELECT p_partkey AS x FROM part WHERE p_type = 'ECONOMY') SELECT src AS node, count(*) AS n FROM s WHERE src IN (SELECT x FROM k) AND dst IN (SELECT x FROM k) GROUP BY 1")
def degree_inside(t):
    """Connections within a set of nodes: the parts of one type."""
    inside = t("part").where("p_type = 'ECONOMY'").select(c("p_partkey").alias("x"))
    both = graph.symmetric(edges(t)).join(inside, c("src") == c("x"), "left_semi").join(inside, c("dst") == c("x"), "left_semi")
    return both.groupBy(c("src").alias("node")).agg(one().alias("n"))


@query("n1_rank_after_top", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 1), x AS (SELECT vec_id, {COS.format(a='embedding', b='v')} AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 25) SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank FROM x""")
def rank_after_top(t):
    from millrace.operators.retrieval import top_ranked, with_similarity

    return top_ranked(with_similarity(t("embeddings"), "embedding", vector_of(t, 1), "s"), "s", "vec_id", 25, "rank")


@query("o5_multi_key_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 30")
def multi_key(t):
    return paging.page_of(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), (("o_orderpriority", False), ("o_totalprice", True), ("o_orderkey", False)), paging.Page(1, 30))


@query("o8_dedup_keep_order", "SELECT l_orderkey, l_extendedprice FROM (SELECT l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1) ORDER BY l_extendedprice DESC, l_orderkey LIMIT 20")
def dedup_keep_order(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("l_extendedprice")).orderBy(F.desc("l_extendedprice"), "l_orderkey").limit(20)


@query("o10_seeded_sample", "SELECT s_suppkey FROM supplier ORDER BY md5('5:' || s_suppkey), s_suppkey LIMIT 20")
def seeded_sample(t):
    return t("supplier").orderBy(*paging.seeded(5, "s_suppkey")).limit(20).select("s_suppkey")


@query("u1_tagged_union", "SELECT 'doc' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages UNION ALL SELECT 'item', item_id FROM benchmark")
def tagged_union(t):
    parts = (("doc", "documents", "doc_id"), ("page", "pages", "page_id"), ("item", "benchmark", "item_id"))
    return reduce(DataFrame.unionByName, [t(table).select(F.lit(k).alias("kind"), c(i).alias("id")) for k, table, i in parts])


@query("u4_recursive_union", "WITH RECURSIVE r(id, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT c_custkey, depth + 1 FROM r JOIN customer ON c_custkey // 4 = id AND c_custkey > 0 WHERE depth < 4) SELECT id, depth FROM r")
def recursive_union(t):
    rows = t("customer").select(c("c_custkey").alias("id"), F.when(c("c_custkey") > 0, F.floor(c("c_custkey") / 4)).alias("parent"))
    return graph.tree(rows, 0, "id", "parent", 4).select("id", "depth")


@query("x19_listed_names", "SELECT c_custkey, c_custkey % 5 = 0 AS listed FROM customer")
def listed_names(t):
    listed = t("customer").where("c_custkey % 5 = 0").select(F.lower("c_name").alias("k")).distinct().withColumn("hit", F.lit(True))
    return t("customer").join(listed, F.lower(F.trim("c_name")) == c("k"), "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("listed"))


@query("d7_year_bucket", "SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1")
def year_bucket(t):
    return t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(one().alias("n"))


@query("d8_trailing_week", "SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20'")
def trailing_week(t):
    as_of = F.lit("2024-01-20").cast("timestamp_ntz")
    return t("events").where((c("ts").cast("timestamp_ntz") > as_of - F.expr("INTERVAL 7 DAYS")) & (c("ts").cast("timestamp_ntz") <= as_of)).agg(one().alias("n"))


@query("g3_path_evidence", f"""{graphs.ORACLE["g2_shortest_path"].rsplit("SELECT step", 1)[0]}
, mm AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS x FROM lineitem) SELECT step::INT AS step, w.src, w.dst, count(*) AS n, list_sort(list(f.d))[1:5] AS documents FROM w JOIN mm f ON f.x = w.src JOIN mm q ON q.x = w.dst AND q.d = f.d GROUP BY 1, 2, 3""")
def path_evidence(t):
    """The documents behind each step of a shortest path: how many, and the first five."""
    steps = graph.cut(graphs.path(t).select("step", "src", "dst"))
    on_path = F.broadcast(steps.select(F.explode(F.array("src", "dst")).alias("x")).distinct())  # seven nodes at most
    m = t("lineitem").select(c("l_orderkey").alias("d"), c("l_partkey").alias("x")).join(on_path, "x", "left_semi").distinct()
    both = F.broadcast(steps).join(m.alias("p"), c("p.x") == c("src")).join(m.alias("q"), (c("q.x") == c("dst")) & (c("q.d") == c("p.d"))).select("step", "src", "dst", c("p.d").alias("d"))  # six steps at most
    counts = both.groupBy("step", "src", "dst").agg(one().alias("n"))
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("step").orderBy("d"))).where("r <= 5").groupBy("step").agg(F.sort_array(F.collect_list("d")).alias("documents"))
    return counts.join(first, "step")


@query("g13_centrality_page", f"WITH {EDGES} SELECT src AS node, count(*) AS degree FROM s GROUP BY 1 HAVING count(*) > 1 ORDER BY degree DESC, node LIMIT 20")
def centrality(t):
    return paging.page_of(graph.degrees(edges(t)).where("degree > 1"), (("degree", True), ("node", False)))


@query("g14_both_roles", "SELECT 'property' AS role, o_orderkey AS id, o_orderdate FROM orders WHERE o_custkey = 10 UNION ALL SELECT 'owner', o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 1500 = 10")
def both_roles(t):
    rows = t("orders")
    a = rows.where("o_custkey = 10").select(F.lit("property").alias("role"), c("o_orderkey").alias("id"), "o_orderdate")
    return a.unionByName(rows.where("o_orderkey % 1500 = 10").select(F.lit("owner").alias("role"), c("o_orderkey").alias("id"), "o_orderdate"))


@query("g16_lookup_tool", f"WITH {EDGES} SELECT dst, n FROM s WHERE src = {START} ORDER BY n DESC, dst LIMIT 10")
def lookup_tool(t):
    e = edges(t)
    return graph.strongest(e, start(e), 10, strength="n").select("dst", "n")


@query("t14_rule_classes", "SELECT doc_id, len(list_filter(['trash', 'idiot', 'clown', 'scum'], lambda w: contains(lower(text), w))) >= 2 AS protected FROM documents")
def rule_classes(t):
    return t("documents").select("doc_id", (T.count_matches(F.lower("text"), ["trash", "idiot", "clown", "scum"]) >= 2).alias("protected"))


@query("t15_protection_status", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR (lang = 'en' AND doc_id % 10 < 3) THEN 'protected' WHEN lang IN ('fr', 'de') THEN 'public' ELSE 'review_needed' END AS status FROM documents")
def protection(t):
    d = c("doc_id")
    status = F.when((d % 5 == 0) | ((c("lang") == "en") & (d % 10 < 3)), "protected").when(c("lang").isin("fr", "de"), "public").otherwise("review_needed")
    return t("documents").select("doc_id", status.alias("status"))


@query("t19_embedding_input", "SELECT doc_id, source || chr(10) || chr(10) || text AS input FROM documents WHERE lang = 'es'")
def embedding_input(t):
    return t("documents").where("lang = 'es'").select("doc_id", F.concat_ws("\n\n", "source", "text").alias("input"))


@query("k5_length_match", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN abs(length(p_name) - p_size) <= 3 END AS fits FROM part")
def lengths(t):
    return t("part").select("p_partkey", length_match(c("p_name"), F.when(c("p_size") % 4 > 0, c("p_size"))).alias("fits"))


@query("k6_corroborated", "SELECT user_id, count(*) FILTER (event_type = 'purchase') >= 3 AS corroborated FROM events GROUP BY 1")
def corroborated(t):
    return t("events").groupBy("user_id").agg((F.count_if(c("event_type") == "purchase") >= 3).alias("corroborated"))


@query("c4_solvable", """
SELECT vec_id, label, count(event_id) AS proposals, max(value) AS best FROM embeddings LEFT JOIN events ON user_id = vec_id AND event_type = 'click' WHERE vec_id % 3 > 0 GROUP BY 1, 2 ORDER BY proposals DESC, vec_id LIMIT 30""")
def solvable(t):
    votes = t("events").where("event_type = 'click'").groupBy(c("user_id").alias("vec_id")).agg(one().alias("proposals"), F.max("value").alias("best"))
    rows = t("embeddings").where("vec_id % 3 > 0").select("vec_id", "label").join(votes, "vec_id", "left").fillna(0, ["proposals"])
    return rows.orderBy(F.desc("proposals"), "vec_id").limit(30)


@query("h4_frequent_travellers", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS trips FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 500 ORDER BY trips DESC, l_suppkey LIMIT 10")
def travellers(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("trips")).where("trips >= 500").orderBy(F.desc("trips"), "l_suppkey").limit(10)


@query("h5_transfers", "SELECT l_orderkey, l_linenumber, l_extendedprice AS amount, sum(l_extendedprice::DECIMAL(15,2)) OVER ()::DOUBLE AS total FROM lineitem WHERE l_suppkey = 9 AND l_returnflag = 'R' ORDER BY amount DESC, l_orderkey, l_linenumber LIMIT 20")
def transfers(t):
    rows = t("lineitem").where("l_suppkey = 9 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", c("l_extendedprice").alias("amount"))
    total = rows.agg(F.sum(c("amount").cast("decimal(15,2)")).cast("double").alias("total"))
    return rows.join(F.broadcast(total)).orderBy(F.desc("amount"), "l_orderkey", "l_linenumber").limit(20)  # one row


@query("h7_discoveries", "SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY last DESC, user_id LIMIT 25")
def discoveries(t):
    return t("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id").limit(25)


@query("st_batch_window_rank", "SELECT user_id, event_id, value, rank() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS r FROM events QUALIFY r <= 3")
def top_three(t):
    ranked = t("events").select("user_id", "event_id", "value", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("r"))
    return ranked.where("r <= 3")


@query("w20_refresh_views", "SELECT 'by_customer' AS view, o_custkey AS k, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'by_part', l_partkey, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'by_user', user_id, count(*) FROM events GROUP BY 2")
def refresh_views(t):
    """Three views, refreshed twice; readers take the second version."""
    spark = t("orders").sparkSession
    folder = views.new_folder(spark)
    tables = {"by_customer": ("orders", "o_custkey"), "by_part": ("lineitem", "l_partkey"), "by_user": ("events", "user_id")}
    counts = {v: t(name).groupBy(c(k).alias("k")).agg(one().alias("n")) for v, (name, k) in tables.items()}
    views.refresh_all({v: df.where("false") for v, df in counts.items()}, folder)
    views.refresh_all(counts, folder)
    return reduce(DataFrame.unionByName, [views.saved(spark, f"{folder}/{v}", lambda: counts["by_user"]).select(F.lit(v).alias("view"), "k", "n") for v in counts])


@query("w20_kept_view", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def kept_view(t):
    """A view kept up to date by three batches, of which the second first had other rows, and the first two are folded before the last."""
    view = rollup.Rollup.create(t.spark, ("o_custkey",), {"n": ("count", "1"), "total": ("sum", "o_totalprice"), "first": ("min", "o_orderdate"), "last": ("max", "o_orderdate")})
    part = lambda k: t("orders").where(c("o_orderkey") % 3 == k)
    view.add(part(0), 0)
    view.add(part(2), 1)
    view.add(part(1), 1)
    view.fold(1)
    view.add(part(2), 2)
    return view.read().withColumn("total", F.round("total", 2))


@query("e3_match_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '|' || upper(trim(o_orderpriority)) AS key FROM orders")
def match_key(t):
    return t("orders").select("o_orderkey", F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), F.upper(F.trim("o_orderpriority"))).alias("key"))


@query("h6_timeline_tool", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_suppkey = 6 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 50")
def timeline_tool(t):
    rows = paging.between(t("lineitem").where("l_suppkey = 6"), "l_shipdate", "1996-01-01", "1998-12-31").select("l_orderkey", "l_linenumber", "l_shipdate")
    return rows.orderBy("l_shipdate", "l_orderkey", "l_linenumber").limit(50)


@query("g8_all_metrics", f"""
WITH {EDGES}, d AS (SELECT src AS node, count(*) AS degree, sum(n)::BIGINT AS weight FROM s GROUP BY 1)
SELECT p_partkey AS node, coalesce(degree, 0) AS degree, coalesce(weight, 0) AS weight, rank, betweenness, community FROM part LEFT JOIN d ON d.node = p_partkey
LEFT JOIN ({graphs.pagerank_sql()}) pr ON pr.node = p_partkey LEFT JOIN ({graphs.betweenness_sql()}) be ON be.node = p_partkey LEFT JOIN ({graphs.communities_sql()}) co ON co.node = p_partkey""")
def all_metrics(t):
    found = graph.compute_all(t("part").select(c("p_partkey").alias("node")), edges(t), "n", sources=40)
    return found.withColumns({"rank": F.round("rank", 9), "betweenness": F.round("betweenness", 6)})


@query("g15_other_side", f"WITH {EDGES} SELECT CASE WHEN a % 7 = 0 THEN b ELSE a END AS other, n FROM e WHERE (a % 7 = 0) <> (b % 7 = 0)")
def other_side(t):
    mine = c("a") % 7 == 0
    return edges(t).where(mine != (c("b") % 7 == 0)).select(F.when(mine, c("b")).otherwise(c("a")).alias("other"), "n")


@query("a34_mean_confidence", "SELECT l_returnflag, round(avg(l_tax), 6) AS mean, count(*) AS n FROM lineitem WHERE l_tax > 0 GROUP BY 1")
def mean_confidence(t):
    return t("lineitem").where("l_tax > 0").groupBy("l_returnflag").agg(F.round(F.avg("l_tax"), 6).alias("mean"), one().alias("n"))


@query("t16_extraction_json", """SELECT c_custkey, '{"name":"' || c_name || '","nation":' || c_nationkey || '}' AS extracted FROM customer""")
def extraction_json(t):
    return t("customer").select("c_custkey", F.to_json(F.struct(c("c_name").alias("name"), c("c_nationkey").alias("nation"))).alias("extracted"))


@query("j2_left_dim", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def left_dim(t):
    some = t("nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    return t("supplier").join(some, c("s_nationkey") == c("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("a4_distinct_contributors", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def contributors(t):
    return t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("o1_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def top_k(t):
    return t("part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)


@query("o9_bounded_sample", "SELECT vec_id, label FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 50")
def bounded_sample(t):
    return t("embeddings").where("label = 2").select("vec_id", "label").orderBy("vec_id").limit(50)


def near_vectors(t, exact, k=10):
    """The k nearest of all vectors to every fiftieth, through the index of cells."""
    rows = t("embeddings")
    cells = max(1, round(rows.count() ** 0.5))
    sample = ann.sample_rows(rows, "embedding")
    cells, codes = ann.Cells.fit(sample, cells), ann.Codes.fit(sample)
    index, ids = ann.build(rows, "vec_id", "embedding", cells, codes)
    asked = rows.where("vec_id % 50 = 0").select(c("vec_id").alias("q"), c("embedding").alias("vector"))
    found = ann.search(index, cells, asked, k, ann.probes_for(sample, cells, k), exact, codes)
    firsts = ids.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(c("r") <= k)  # no more of equal vectors are asked for
    return ann.best(found.join(firsts, "key").select("q", c("id").alias("key"), "similarity"), k).select("q", c("key").alias("vec_id"), "similarity")


@query("r12_index_search")
def index_search(t):
    return near_vectors(t, False)


@query("r12_exact_search", f"""
SELECT q, vec_id, similarity FROM (SELECT a.vec_id AS q, b.vec_id, {COS.format(a='a.embedding', b='b.embedding')} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS.format(a='a.embedding', b='b.embedding')} DESC, b.vec_id) AS r
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE r <= 10""")
def exact_search(t):
    return near_vectors(t, True)


PAIRS = """SELECT event_id, list_extract(['page', 'depth', 'name', 'min_amount', 'sort'], (event_id % 5 + 1)::INT) AS key, list_extract(['true', 'abc', '12', '-3', '007', 'false', '1.5'], (event_id % 7 + 1)::INT) AS value FROM events"""


def pairs(t):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (c("event_id") % n).cast("int"))
    return t("events").select("event_id", pick(("page", "depth", "name", "min_amount", "sort"), 5).alias("key"), pick(("true", "abc", "12", "-3", "007", "false", "1.5"), 7).alias("value"))


@query("p23_coerced_parameters", f"""
SELECT event_id, CASE WHEN key IN ('page', 'depth', 'min_amount') AND value IN ('12', '007') THEN value::BIGINT END AS number, CASE WHEN value IN ('true', 'false') THEN value = 'true' END AS flag,
CASE WHEN value NOT IN ('true', 'false') AND NOT (key IN ('page', 'depth', 'min_amount') AND value IN ('12', '007')) THEN value END AS text FROM ({PAIRS})""")
def coerced_parameters(t):
    return pairs(t).select("event_id", paging.coerced(c("key"), c("value")).alias("v")).select("event_id", "v.*")


@query("p24_bounded_parameters", """
WITH x AS (SELECT event_id, list_extract(['per_page', 'depth', 'window_days', 'max_depth', 'page'], (event_id % 5 + 1)::INT) AS key, CASE WHEN event_id % 7 > 0 THEN event_id % 400 END AS v FROM events),
b(key, low, high, fallback) AS (VALUES ('per_page', 1, 100, 20), ('depth', 1, 4, 2), ('window_days', 1, 365, 7), ('max_depth', 1, 10, 6), ('page', 1, NULL, 1)), y AS (SELECT event_id, low, high, coalesce(v, fallback) AS value FROM x JOIN b USING (key))
SELECT event_id, value::BIGINT AS value, CASE WHEN value < low THEN 'at least ' || low WHEN value > high THEN 'at most ' || high END AS error FROM y""")
def bounded_parameters(t):
    key = F.get(F.array(*map(F.lit, ("per_page", "depth", "window_days", "max_depth", "page"))), (c("event_id") % 5).cast("int"))
    value = F.when(c("event_id") % 7 > 0, c("event_id") % 400).cast("long")
    return t("events").select("event_id", paging.bounded(key, value).alias("v")).select("event_id", "v.*")


@query("w29_metadata_merge", "SELECT doc_id, source AS origin, CASE WHEN n_chars > 1000 THEN 'visual' ELSE 'text_marker' END AS method, CASE WHEN n_chars <= 500 THEN 'kept' END AS note FROM documents")
def metadata_merge(t):
    """What either way of detection learns is put into the stored map; the early exit keeps the rest of it too."""
    old = F.create_map(F.lit("origin"), c("source"), F.lit("method"), F.lit("old"))
    old = F.when(c("n_chars") <= 500, ledger.map_merge(old, F.create_map(F.lit("note"), F.lit("kept")))).otherwise(old)
    new = F.create_map(F.lit("method"), F.when(c("n_chars") > 1000, "visual").otherwise("text_marker"))
    merged = t("documents").select("doc_id", ledger.map_merge(old, new).alias("m"))
    return merged.select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("origin", "method", "note")])


@query("u3_unnested_lists", """
WITH x AS (SELECT 'sender' AS kind, conv_id AS id FROM conversations UNION ALL SELECT 'receiver', unnest([conv_id + turn, conv_id + 2 * turn]) FROM conversations UNION ALL SELECT 'user', user_id FROM events)
SELECT id, list_sort(list_distinct(list(kind))) AS kinds, count(*) AS n FROM x GROUP BY 1""")
def unnested_lists(t):
    talks = t("conversations")
    parts = (talks.select(F.lit("sender").alias("kind"), c("conv_id").alias("id")), talks.select(F.lit("receiver").alias("kind"), F.explode(F.array(c("conv_id") + c("turn"), c("conv_id") + 2 * c("turn"))).alias("id")), t("events").select(F.lit("user").alias("kind"), c("user_id").alias("id")))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), one().alias("n"))


@query("d5_two_digit_years", "SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2003-02-01' END AS other FROM orders")
def two_digit_years(t):
    from millrace.functions.dates import parse_date

    return t("orders").select("o_orderkey", parse_date(F.date_format("o_orderdate", "M/d/yy")).alias("day"), parse_date(F.when(c("o_orderkey") % 2 == 0, "2/1/03").otherwise("2/30/03")).alias("other"))


@query("x23_rolling_hash", """
WITH c AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda x: ord(x)::BIGINT) AS c FROM part), h AS (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, c), lambda h, x: (h * 31 + x) % 4294967296) AS h FROM c)
SELECT p_partkey, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS key FROM h""")
def rolling_hash(t):
    return t("part").select("p_partkey", T.rolling_hash("p_name").alias("key"))


@query("s17_sqlite_names", "SELECT 'persons' AS \"table\", s_name AS name FROM supplier UNION ALL SELECT 'organizations', n_name FROM nation")
def sqlite_tables(t):
    """SQLite files that tasks write to the shared folder, and read again."""
    from millrace.sources.loadfiles import sqlite_names, write_sqlite

    spark = t("supplier").sparkSession
    folder = views.new_folder(spark)
    rows = [t("supplier").select(F.lit("persons").alias("table"), F.lit("full_name").alias("column"), c("s_name").alias("name")), t("nation").select(F.lit("organizations").alias("table"), F.lit("title").alias("column"), c("n_name").alias("name"))]
    rows.append(t("region").select(F.lit("places").alias("table"), F.lit("name").alias("column"), c("r_name").alias("name")))
    return sqlite_names(spark, write_sqlite(reduce(DataFrame.unionByName, rows), folder))


@query("s26_manifest", "SELECT 'n=' || n_nationkey AS file, length(n_name) + 1 AS size, sha256(n_name || chr(10)) AS sha256 FROM nation WHERE n_nationkey >= 5")
def file_manifest(t):
    """A file a nation; those that a manifest has already are left out."""
    from millrace.sources.loadfiles import manifest

    spark = t("nation").sparkSession
    path = f"{views.new_folder(spark)}/files"
    t("nation").select("n_name", c("n_nationkey").alias("n")).repartition("n").write.partitionBy("n").text(path)
    place = F.regexp_extract("path", r"(n=[0-9]+)/part", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where(F.regexp_extract("path", r"n=([0-9]+)/part", 1).cast("int") < 5)
    return manifest(spark, path, files).where(place != "").select(place.alias("file"), "size", "sha256")


QUERIES, ORACLE = query.queries, query.oracle
