"""Aggregations, summary views and feeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.scores import evidence_strength
from millrace.plans.base import Registry

query = Registry()
c = F.col


@query("a1_group_count_max", "SELECT o_custkey, o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 100")
def group_count_max(t):
    rows = t("orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    return rows.orderBy(F.desc("n"), "o_custkey", "o_orderstatus").limit(100)


@query("a2_filtered_counts", """
SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors,
count(DISTINCT user_id) AS users, coalesce(round(avg(value) FILTER (value > 10), 6), 0) AS mean_over_10 FROM events""")
def filtered_counts(t):
    n = lambda k: F.count_if(c("event_type") == k)
    mean = F.coalesce(F.round(F.avg(F.when(c("value") > 10, c("value"))), 6), F.lit(0.0))
    return t("events").agg(n("click").alias("clicks"), n("view").alias("views"), n("error").alias("errors"), F.count_distinct("user_id").alias("users"), mean.alias("mean_over_10"))


@query("a6_distinct_lists", "SELECT user_id, list_sort(list_distinct(list(event_type))) AS types, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id")
def distinct_lists(t):
    return t("events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


@query("a7_filtered_list_null", "SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 45))) AS types FROM events GROUP BY user_id")
def filtered_list(t):
    got = F.sort_array(F.collect_set(F.when(c("value") > 45, c("event_type"))))
    return t("events").groupBy("user_id").agg(F.when(F.size(got) > 0, got).alias("types"))


@query("a8_mode", """
WITH n AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT DISTINCT ON (o_custkey) o_custkey, p AS usual, n FROM n ORDER BY o_custkey, n DESC, p""")
def mode(t):
    n = t("orders").groupBy("o_custkey", c("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("o_custkey").agg(F.min_by(F.struct("p", "n"), F.struct(-c("n"), c("p"))).alias("b")).select("o_custkey", c("b.p").alias("usual"), c("b.n").alias("n"))


@query("a10_having", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY l_suppkey HAVING count(*) > 50")
def having(t):
    return t("lineitem").where("l_discount > 0.05").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 50")


@query("a11_bool_or", """
SELECT conv_id, bool_or(text LIKE '%.%') AS has_stop, coalesce(bool_or(CASE WHEN turn > 1 THEN contains(lower(text), 'the') END), false) AS has_the FROM conversations GROUP BY conv_id""")
def bool_or(t):
    return t("conversations").groupBy("conv_id").agg(F.bool_or(c("text").contains(".")).alias("has_stop"), F.coalesce(F.bool_or(F.when(c("turn") > 1, F.lower("text").contains("the"))), F.lit(False)).alias("has_the"))


@query("a12_json_payload", """
SELECT r_regionkey, '[' || string_agg('{"n":"' || n_name || '","k":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']' AS payload FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def json_payload(t):
    rows = t("region").join(t("nation"), c("n_regionkey") == c("r_regionkey"))
    return rows.groupBy("r_regionkey").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(c("n_nationkey").alias("k"), c("n_name").alias("n")))), lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k")))).alias("payload"))


@query("a13_top_n_sum", """
WITH w AS (SELECT l_suppkey, l_orderkey, max(l_discount) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_orderkey) AS r FROM w)
SELECT l_suppkey, round(least(sum(w) / 10.0::DOUBLE, 2.0::DOUBLE), 6) AS score FROM r WHERE r <= 20 GROUP BY 1""")
def top_n_sum(t):
    best = t("lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_discount").alias("w"))
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("w"), "l_orderkey"))).where("r <= 20")
    return ranked.groupBy("l_suppkey").agg(F.round(F.least(F.sum("w") / 10.0, F.lit(2.0)), 6).alias("score"))


@query("a15_dashboard", """
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(n_chars) FROM documents)::BIGINT AS chars, (SELECT count(DISTINCT source) FROM documents) AS sources,
(SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM conversations) AS turns, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations,
(SELECT count(*) FILTER (toxic = 1) FROM labels) AS toxic, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders) AS orders""")
def dashboard(t):
    n = F.count(F.lit(1))
    rows = [
        t("documents").agg(n.alias("documents"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources")),
        t("pages").agg(n.alias("pages")), t("embeddings").agg(n.alias("vectors")),
        t("conversations").agg(n.alias("turns"), F.count_distinct("conv_id").alias("conversations")),
        t("labels").agg(F.count_if(c("toxic") == 1).alias("toxic")), t("events").agg(n.alias("events")), t("orders").agg(n.alias("orders")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r))  # frames of one row
    return out


STAGES = ("ocr", "classify", "chunk", "embed", "review")


@query("a17_stage_counts", """
WITH s AS (SELECT unnest(list_filter(['ocr', CASE WHEN n_chars > 500 THEN 'classify' END, CASE WHEN n_chars > 1500 THEN 'chunk' END, CASE WHEN toxic = 1 THEN 'embed' END], lambda x: x IS NOT NULL)) AS stage FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT unnest(['ocr', 'classify', 'chunk', 'embed', 'review']) AS stage) SELECT k.stage, count(s.stage) AS n FROM k LEFT JOIN s USING (stage) GROUP BY 1""")
def stage_counts(t):
    done = F.array_compact(F.array(F.lit("ocr"), F.when(c("n_chars") > 500, "classify"), F.when(c("n_chars") > 1500, "chunk"), F.when(c("toxic") == 1, "embed")))
    counts = t("documents").join(t("labels"), "doc_id", "left").select(F.explode(done).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    known = t("region").limit(1).select(F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    return known.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


@query("a18_leaderboard", """
WITH x AS (SELECT user_id, sum(value) AS xp FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1), a AS (SELECT user_id, count(DISTINCT event_type) AS achievements FROM events WHERE value > 40 GROUP BY 1)
SELECT user_id, round(xp, 4) AS xp, coalesce(achievements, 0) AS achievements FROM x LEFT JOIN a USING (user_id) ORDER BY xp DESC, user_id LIMIT 25""")
def leaderboard(t):
    week = t("events").where("ts >= '2024-01-24' AND ts < '2024-01-31'").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("xp"))
    won = t("events").where("value > 40").groupBy("user_id").agg(F.count_distinct("event_type").alias("achievements"))
    return week.join(won, "user_id", "left").select("user_id", "xp", F.coalesce("achievements", F.lit(0)).alias("achievements")).orderBy(F.desc("xp"), "user_id").limit(25)


@query("a19_passenger_view", """
WITH n AS (SELECT l_suppkey AS k, l_returnflag || '-' || l_linestatus AS route, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT DISTINCT ON (k) k, route FROM n ORDER BY k, n DESC, route)
SELECT l_suppkey AS supplier, count(DISTINCT l_orderkey) AS trips, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last, any_value(route) AS top_route FROM lineitem JOIN m ON k = l_suppkey GROUP BY 1""")
def passenger_view(t):
    rows = t("lineitem").select(c("l_suppkey").alias("supplier"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("route"), "l_orderkey", "l_shipdate")
    n = rows.groupBy("supplier", "route").agg(F.count(F.lit(1)).alias("n")).groupBy("supplier").agg(F.min_by("route", F.struct(-c("n"), c("route"))).alias("top_route"))
    stats = rows.groupBy("supplier").agg(F.count_distinct("l_orderkey").alias("trips"), F.min("l_shipdate").cast("date").alias("first"), F.max("l_shipdate").cast("date").alias("last"))
    return stats.where("trips > 0").join(n, "supplier")


@query("a20_email_view", """
SELECT o_custkey AS sender, count(DISTINCT o_orderkey) AS sent, count(DISTINCT l_suppkey) AS contacts, list_sort(list_distinct(list(s_name) FILTER (s_suppkey < 20))) AS names
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def email_view(t):
    rows = t("orders").join(t("lineitem"), c("l_orderkey") == c("o_orderkey"), "left").join(t("supplier"), c("l_suppkey") == c("s_suppkey"), "left")
    names = F.sort_array(F.collect_set(F.when(c("s_suppkey") < 20, c("s_name"))))
    return rows.groupBy(c("o_custkey").alias("sender")).agg(F.count_distinct("o_orderkey").alias("sent"), F.count_distinct("l_suppkey").alias("contacts"), F.when(F.size(names) > 0, names).alias("names"))


MONEY = "l_extendedprice::DECIMAL(15,2)"


@query("a23_financial_summary", f"""
WITH x AS (SELECT o_orderpriority AS kind, year(o_orderdate) AS y, {MONEY} AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(y) = 0 THEN 'year' ELSE 'all' END AS level, coalesce(kind, y::VARCHAR, 'all') AS key, count(*) AS n, sum(amount)::DOUBLE AS total
FROM x GROUP BY GROUPING SETS ((kind), (y), ())""")
def financial_summary(t):
    rows = t("orders").join(t("lineitem"), c("l_orderkey") == c("o_orderkey")).select(c("o_orderpriority").alias("kind"), F.year("o_orderdate").alias("y"), c("l_extendedprice").cast("decimal(15,2)").alias("amount"))
    sets = rows.groupingSets([["kind"], ["y"], []], "kind", "y").agg(F.grouping("kind").alias("gk"), F.grouping("y").alias("gy"), F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))
    level = F.when(c("gk") == 0, "kind").when(c("gy") == 0, "year").otherwise("all")
    return sets.select(level.alias("level"), F.coalesce("kind", c("y").cast("string"), F.lit("all")).alias("key"), "n", "total")


@query("a23_top_parties", f"""
SELECT * FROM (SELECT 'sender' AS role, o_custkey AS party, sum({MONEY})::DOUBLE AS total, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 2 ORDER BY total DESC, party LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'receiver', l_suppkey, sum({MONEY})::DOUBLE AS total, count(*) FROM lineitem GROUP BY 2 ORDER BY total DESC, l_suppkey LIMIT 20)""")
def top_parties(t):
    money = F.sum(c("l_extendedprice").cast("decimal(15,2)")).cast("double").alias("total")
    top = lambda df, role, key: df.groupBy(c(key).alias("party")).agg(money, F.count(F.lit(1)).alias("n")).orderBy(F.desc("total"), "party").limit(20).select(F.lit(role).alias("role"), "party", "total", "n")
    return top(t("orders").join(t("lineitem"), c("l_orderkey") == c("o_orderkey")), "sender", "o_custkey").unionByName(top(t("lineitem"), "receiver", "l_suppkey"))


@query("a24_flow_allocation", f"""
WITH x AS (SELECT o_custkey AS s, l_suppkey AS r, o_orderpriority AS k, {MONEY} AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey), g AS (SELECT sum(a)::DOUBLE AS g FROM x),
s AS (SELECT s, sum(a)::DOUBLE AS st FROM x GROUP BY 1 ORDER BY st DESC, s LIMIT 8), k AS (SELECT k, sum(a)::DOUBLE AS kt FROM x GROUP BY 1 ORDER BY kt DESC, k LIMIT 5)
SELECT s, k, greatest(round(st * kt / g / 8), 1) AS flow FROM s, k, g""")
def flow_allocation(t):
    x = t("orders").join(t("lineitem"), c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("s"), c("o_orderpriority").alias("k"), c("l_extendedprice").cast("decimal(15,2)").alias("a"))
    total = lambda name: F.sum("a").cast("double").alias(name)
    senders = x.groupBy("s").agg(total("st")).orderBy(F.desc("st"), "s").limit(8)
    kinds = x.groupBy("k").agg(total("kt")).orderBy(F.desc("kt"), "k").limit(5)
    return senders.join(F.broadcast(kinds)).join(F.broadcast(x.agg(total("g")))).select("s", "k", F.greatest(F.round(c("st") * c("kt") / c("g") / 8), F.lit(1.0)).alias("flow"))  # 8 x 5 x 1 rows


@query("a25_route_graph", """
SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def route_graph(t):
    rows = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey")).join(t("supplier"), c("l_suppkey") == c("s_suppkey"))
    return rows.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("a27_campaigns", """
WITH f AS (SELECT c_mktsegment AS slug, sum(c_acctbal::DECIMAL(15,2)) AS funded, 2000000::DECIMAL(15,2) AS goal FROM customer GROUP BY 1)
SELECT slug, funded::DOUBLE AS funded, least(round(100 * funded::DOUBLE / goal::DOUBLE, 4), 100) AS percent, greatest(goal - funded, 0)::DOUBLE AS remaining FROM f""")
def campaigns(t):
    f = t("customer").groupBy(c("c_mktsegment").alias("slug")).agg(F.sum(c("c_acctbal").cast("decimal(15,2)")).alias("d"))
    goal = F.lit(2000000).cast("decimal(15,2)")
    return f.select("slug", c("d").cast("double").alias("funded"), F.least(F.round(100 * c("d").cast("double") / goal.cast("double"), 4), F.lit(100.0)).alias("percent"), F.greatest(goal - c("d"), F.lit(0).cast("decimal(15,2)")).cast("double").alias("remaining"))


@query("a28_donation_impact", """
WITH a AS (SELECT c_custkey, abs(c_acctbal) AS amount FROM customer), tiers(least_, name) AS (VALUES (0.0, 'reader'), (1000.0, 'patron'), (5000.0, 'sponsor'))
SELECT c_custkey, round(amount / 0.0021::DOUBLE)::BIGINT AS pages, round(2.5::DOUBLE * round(amount / 0.0021::DOUBLE))::BIGINT AS entities, (SELECT arg_max(name, least_) FROM tiers WHERE least_ <= amount) AS tier FROM a""")
def donation_impact(t):
    a = t("customer").select("c_custkey", F.abs("c_acctbal").alias("amount"))
    pages = F.round(c("amount") / 0.0021)
    tier = F.when(c("amount") >= 5000, "sponsor").when(c("amount") >= 1000, "patron").otherwise("reader")
    return a.select("c_custkey", pages.cast("long").alias("pages"), F.round(2.5 * pages).cast("long").alias("entities"), tier.alias("tier"))


@query("a30_cooccurrence", """
WITH m AS (SELECT DISTINCT l_orderkey AS d, l_suppkey AS e FROM lineitem) SELECT x.e AS a, y.e AS b, count(*) AS n, round(least(10.0::DOUBLE, 1 + ln(count(*))), 6) AS strength, list_sort(list(x.d))[1:5] AS evidence
FROM m x JOIN m y ON x.d = y.d AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2""")
def cooccurrence(t):
    from millrace.operators.resolve import cooccurrence as pairs

    found = pairs(t("lineitem").select(c("l_orderkey").alias("d"), c("l_suppkey").alias("e")), "d", "e", keep=5).where("n >= 2")
    return found.select("a", "b", "n", F.round(evidence_strength(c("n")), 6).alias("strength"), "evidence")


@query("a31_email_pairs", """
WITH m AS (SELECT conv_id AS sender, unnest([conv_id % 7, conv_id % 11, turn % 5]) AS receiver FROM conversations)
SELECT sender, receiver, count(*) AS n FROM m WHERE sender <> receiver GROUP BY 1, 2""")
def email_pairs(t):
    m = t("conversations").select(c("conv_id").alias("sender"), F.explode(F.concat(F.array(c("conv_id") % 7), F.array(c("conv_id") % 11, c("turn") % 5))).alias("receiver"))
    return m.where("sender <> receiver").groupBy("sender", "receiver").agg(F.count(F.lit(1)).alias("n"))


@query("w14_vote_recount", """
SELECT user_id AS proposal, count(*) FILTER (event_type = 'click') AS up, count(*) FILTER (event_type = 'error') AS down, count(*) FILTER (event_type = 'purchase') AS backing FROM events GROUP BY 1""")
def vote_recount(t):
    n = lambda k: F.count_if(c("event_type") == k)
    return t("events").groupBy(c("user_id").alias("proposal")).agg(n("click").alias("up"), n("error").alias("down"), n("purchase").alias("backing"))


@query("w27_counter_rebuild", """
SELECT l_suppkey AS entity, count(*) AS mentions, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY 1""")
def counter_rebuild(t):
    return t("lineitem").groupBy(c("l_suppkey").alias("entity")).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("l_orderkey").alias("documents"))


QUERIES, ORACLE = query.queries, query.oracle
