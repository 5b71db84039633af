"""Sources, writes, stages and streams. Lines of load files are made from the tables, so that every form occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import chunk_flags
from millrace.operators import chunker, extract, ledger, stages
from millrace.plans.base import Registry
from millrace.sources import html, loadfiles
from millrace.streaming import votes, windows

query = Registry()
c = F.col
OPT_LINE = "CASE WHEN o_orderkey % 50 = 7 THEN 'bad,line' ELSE concat('B', lpad(CAST(o_orderkey AS {s}), 8, '0'), ',VOL1,\"IMG\\A,1.tif\",', CASE WHEN o_orderkey % 4 = 1 THEN 'Y' ELSE '' END, ',,', CASE WHEN o_orderkey % 2 = 0 THEN '3' ELSE '' END) END"


def opt_lines(t):
    line = F.expr(OPT_LINE.replace("{s}", "string").replace("\\", "\\\\"))
    return t("orders").select((c("o_custkey") % 8).cast("string").alias("file"), c("o_orderkey").alias("line_no"), line.alias("line"))


OPT = "x AS (SELECT (o_custkey % 8)::VARCHAR AS file, o_orderkey AS line_no, 'B' || lpad(o_orderkey::VARCHAR, 8, '0') AS bates, 'IMG/A,1.tif' AS path, o_orderkey % 4 = 1 AS starts, (CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END)::INT AS pages FROM orders WHERE o_orderkey % 50 <> 7)"


@query("s6_opt_rows", f"WITH {OPT} SELECT file, line_no, bates, 'VOL1' AS volume, path, starts, pages FROM x")
def opt_rows(t):
    return loadfiles.opt_rows(opt_lines(t))


@query("s6_numbered_lines", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, 'B' || o_orderkey AS bates FROM orders")
def numbered_lines(t):
    """Lines in the order of their keys, written as files in that order and read back by splits: numbered over all files."""
    from millrace.shared import new_folder

    where = new_folder(t.spark, "lines")
    line = F.concat(F.lit("B"), "o_orderkey", F.lit(",VOL1,IMG\\A.tif,Y"))
    t("orders").orderBy("o_orderkey").select(line.alias("value")).write.text(where)
    rows = loadfiles.opt_rows(loadfiles.numbered_lines(t.spark, where, across=True))
    return rows.select("line_no", "bates")


@query("s8_opt_documents", f"""
WITH {OPT}, g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY file ORDER BY line_no) AS doc_no FROM x)
SELECT file, doc_no::BIGINT AS doc_no, min(bates) AS first, max(bates) AS last, count(*) AS pages FROM g GROUP BY 1, 2""")
def opt_documents(t):
    return loadfiles.opt_documents(loadfiles.opt_rows(opt_lines(t)))


@query("s7_dat_records", "SELECT c_custkey::BIGINT AS line_no, 'f' AS file, c_name AS begin_no, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS kind FROM customer")
def dat_records(t):
    q = loadfiles.QUOTE
    line = F.concat(F.lit(q), "c_name", F.when(c("c_custkey") % 3 > 0, F.concat(F.lit(loadfiles.FIELD), "c_mktsegment")).otherwise(""), F.lit(q))
    lines = t("customer").select(F.lit("f").alias("file"), c("c_custkey").alias("line_no"), line.alias("line"))
    return loadfiles.dat_records(lines, ["begin_no", "kind"])


@query("s10_json_sniffing", "SELECT s_suppkey, unnest([s_suppkey, s_suppkey + 1]) AS k, s_name AS n FROM supplier WHERE s_suppkey % 3 < 2 UNION ALL SELECT s_suppkey, s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 2")
def json_sniffing(t):
    one = lambda add: F.to_json(F.struct((c("s_suppkey") + add).alias("k"), c("s_name").alias("n")))
    lines, array = F.concat(one(0), F.lit("\n{bad\n"), one(1)), F.concat(F.lit("[\n"), one(0), F.lit(",\n"), one(1), F.lit("]"))
    text = F.when(c("s_suppkey") % 3 == 0, lines).when(c("s_suppkey") % 3 == 1, array).otherwise(one(0))
    return loadfiles.json_records(t("supplier").select("s_suppkey", text.alias("text")), "text", "k bigint, n string")


@query("s12_candidate_fields", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, o_orderpriority) AS v FROM orders")
def candidate_fields(t):
    rows = t("orders").select("o_orderkey", F.when(c("o_orderkey") % 2 == 0, c("o_orderstatus")).otherwise("").alias("tail"), c("o_orderpriority").alias("aircraft"))
    return rows.select("o_orderkey", loadfiles.first_field(rows, ("tail_no", "tail", "aircraft")).alias("v"))


@query("s13_nested_records", "SELECT event_id, event_type AS kind, user_id::VARCHAR AS who FROM events")
def nested_records(t):
    inner = F.to_json(F.struct(c("event_type").alias("kind"), F.col("user_id").cast("string").alias("who")))
    text = F.when(c("event_id") % 3 == 0, inner).when(c("event_id") % 3 == 1, F.concat(F.lit('{"data":'), inner, F.lit("}"))).otherwise(F.concat(F.lit('{"attributes":'), inner, F.lit("}")))
    rows = t("events").select("event_id", F.try_parse_json(text).alias("v"))
    return rows.select("event_id", loadfiles.variant_field(c("v"), ("type", "kind")).alias("kind"), loadfiles.variant_field(c("v"), ("who",)).alias("who"))


@query("s14_person_lists", "SELECT c_custkey, [c_name, c_mktsegment] AS people FROM customer")
def person_lists(t):
    pair = lambda sep: F.concat_ws(sep, "c_name", "c_mktsegment")
    text = F.when(c("c_custkey") % 3 == 0, F.to_json(F.array("c_name", "c_mktsegment"))).when(c("c_custkey") % 3 == 1, pair("; ")).otherwise(pair(", "))
    return t("customer").select("c_custkey", loadfiles.person_list(text).alias("people"))


@query("s15_flight_lines", """
SELECT 'f' AS file, o_orderkey AS line_no, o_orderdate::DATE AS day, 'ABC' AS departure, 'XYZ' AS arrival, CASE WHEN o_orderkey % 2 = 0 THEN 'N12AB' END AS tail, ['Anna Example'] AS passengers FROM orders WHERE o_orderkey % 3 > 0""")
def flight_lines(t):
    sep = F.when(c("o_orderkey") % 2 == 0, "\t").otherwise("|")
    day = F.when(c("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "MM/dd/yy")).otherwise("soon")
    line = F.concat(day, sep, F.lit("ABC"), sep, F.lit("XYZ"), sep, F.lit("Anna Example"), F.when(c("o_orderkey") % 2 == 0, F.concat(sep, F.lit("N12AB"))).otherwise(""))
    return loadfiles.flight_lines(t("orders").select(F.lit("f").alias("file"), c("o_orderkey").alias("line_no"), line.alias("line")))


@query("s16_messages", """
SELECT conv_id, turn, role AS "from", ['a@x', 'b@y'] AS "to", [] AS cc, 'turn ' || turn AS subject, NULL AS date, text AS body FROM conversations""")
def messages(t):
    text = F.concat(F.lit("From: "), "role", F.lit("\nTo: a@x, b@y\nSubject: turn "), "turn", F.lit("\n\n"), "text")
    found = loadfiles.messages(t("conversations").select("conv_id", "turn", text.alias("m")), "m")
    return found.withColumn("cc", c("cc"))


@query("s23_listing", "SELECT 'docs/' || p_partkey || '.pdf' AS path, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END::BIGINT AS size, CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS modified FROM part")
def listing(t):
    path = F.concat(F.lit("docs/"), "p_partkey", F.lit(".pdf"))
    line = F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("2024-01-02 03:04:05  "), "p_size", F.lit(" "), path)).otherwise(path)
    return loadfiles.listing(t("part").select(line.alias("line"))).withColumn("modified", c("modified").cast("timestamp_ntz"))


@query("s24_media_kind", "SELECT p_partkey, list_extract(['image', 'video', 'audio', NULL, 'video', NULL], (p_partkey % 6 + 1)::INT) AS kind FROM part")
def media_kind(t):
    names = F.array(*map(F.lit, ("a/b.JPG", "a/b.mp4", "a/b.mp3", "a/b.pdf", "a/NATIVES/b.ts", "a/b.ts")))
    return t("part").select("p_partkey", loadfiles.media_kind(F.get(names, (c("p_partkey") % 6).cast("int"))).alias("kind"))


@query("s19_payloads", "SELECT page_id, 'page ' || page_id || chr(10) || '\"x\"' AS payload FROM pages")
def payloads(t):
    one = lambda body: F.concat(F.lit('self.__next_f.push([1,"'), body, F.lit('"])'))
    text = F.concat(F.coalesce("html", F.lit("")), one(F.concat(F.lit("page "), "page_id")), F.lit("; "), one(F.lit('\\n\\"x\\"')))
    return html.payload_text(t("pages").select("page_id", text.alias("h")), "page_id", "h")


@query("s20_json_ld", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ['{\"a\":' || page_id || '}'] ELSE [] END AS found FROM pages")
def json_ld(t):
    body = F.when(c("page_id") % 2 == 0, F.concat(F.lit('{"a":'), "page_id", F.lit("}"))).otherwise("{bad")
    text = F.concat(F.coalesce("html", F.lit("")), F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    return t("pages").select("page_id", html.json_ld(text).alias("found"))


@query("s21_links", """SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS links, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages""".replace("\\\\", "\\"))
def page_links(t):
    return t("pages").select("page_id", html.links("html").alias("links"), html.title("html").alias("title"))


def with_cards(t):
    """The pages with payload calls behind their HTML: of orders, photos, names and mails, two cards of the last three in one call."""
    uuid = F.concat(F.lpad(F.hex("page_id"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    quoted = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p.replace("'", '\\"')) for p in parts])
    n = F.col("page_id").cast("string")
    low = F.lower(uuid)
    order = quoted("['$','tr','", low, "',{'font-mono text-sm','children':'Mar 3, 2004'},{'font-medium line-clamp-2','children':'Item ", n, "'},AMZ-0001-0002-003,{'secondary/90 text-xs','children':'Books'},{'text-center','children':", n, "},{'text-right font-mono text-sm','children':'$$9.50'},{'href':'/orders/", n, "'}]")
    photo = lambda k: quoted(f"$L{k}','", low, "',{'src':'https://x.supabase.co/storage/v1/object/public/photos/", n, f"-{k}.jpg','alt':'Photo ", n, "'},{'href':'/photos/", n, "'},{'children':'The Ranch ", n, "'},{'outline','children':'Estate'}")
    name = lambda k: quoted(f"['$','$L{k}',null,", "{'href':'/names/n", n, f"-{k}'", "},{'semibold','children':'Name ", n, "'},{'text-muted-foreground','children':'Known as a witness'},{'children':", n, "},{'children':7}]")
    mail = lambda k: quoted(f"$L{k}','", low, "',{'href':'/emails/", n, f"-{k}'", "},{'children':'Jan 5, 2001'},From: {'children':'Ann'},To: {'children':'Bob'},{'font-medium','children':'Subject ", n, "'},{'children':'A long preview of the message of page ", n, "'}")
    call = lambda *parts: F.concat(F.lit('<script>self.__next_f.push([1,"'), *parts, F.lit('"])</script>'))
    text = F.concat(F.coalesce("html", F.lit("")), call(order), call(F.lit("0:"), photo(1), photo(2)), call(name(1), name(2)), call(F.lit("email "), mail(1), mail(2)))
    return html.payload_chunks(t("pages").select("page_id", text.alias("h")), "page_id", "h")


@query("s21_orders", """SELECT page_id, lower(lpad(printf('%X', page_id), 8, '0')) || '-0000-4000-8000-000000000000' AS id, 'Mar 3, 2004' AS date, 'Item ' || page_id AS item, 'AMZ-0001-0002-003' AS order_number, 'Books' AS category,
page_id::INT AS quantity, '$9.50' AS price, '/orders/' || page_id AS detail_url FROM pages""")
def scraped_orders(t):
    return html.records(with_cards(t), "page_id", "order")


@query("s21_photos", """SELECT page_id, 'https://x.supabase.co/storage/v1/object/public/photos/' || page_id || '-' || k || '.jpg' AS image_url, 'Photo ' || page_id AS title, '/photos/' || page_id AS detail_url, 'The Ranch ' || page_id AS location, 'Estate' AS source
FROM pages, (VALUES (1), (2)) x(k)""")
def scraped_photos(t):
    return html.records(with_cards(t), "page_id", "photo")


@query("s21_names", """SELECT page_id, '/names/n' || page_id || '-' || k AS profile_url, 'Name ' || page_id AS name, 'Known as a witness' AS role, page_id::INT AS document_count, 7 AS flight_count, NULL::INT AS email_count FROM pages, (VALUES (1), (2)) x(k)""")
def scraped_names(t):
    return html.records(with_cards(t), "page_id", "name")


@query("s21_mails", """SELECT page_id, '/emails/' || page_id || '-' || k AS detail_url, 'Jan 5, 2001' AS date, 'Ann' AS "from", 'Bob' AS "to", 'Subject ' || page_id AS subject, 'A long preview of the message of page ' || page_id AS preview FROM pages, (VALUES (1), (2)) x(k)""")
def scraped_mails(t):
    return html.records(with_cards(t), "page_id", "email")


@query("s22_main_text", r"""
WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: trim(regexp_replace(p, '<[^>]+>', '', 'g'))), lambda p: p <> '') AS p FROM pages),
f AS (SELECT page_id, list_filter(p, lambda x: length(x) >= 40 AND NOT regexp_matches(x, '\{[^}]*:[^}]*\}')) AS f FROM p)
SELECT page_id, list_reduce(list_prepend('', f), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) AS body FROM f WHERE len(f) > 0""")
def main_text(t):
    return t("pages").select("page_id", html.main_text("html").alias("body")).where("body IS NOT NULL")


@query("s29_line_audit", r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), l AS (SELECT doc_id, lines, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
p(pattern, re) AS (VALUES ('licence', '(?i)licen[cs]e'), ('mail', '\S+@\S+'), ('rights', 'rights reserved')),
h AS (SELECT pattern, doc_id, i, array_to_string(list_slice(lines, greatest(i - 2, 1), i + 2), chr(10)) AS context, row_number() OVER (PARTITION BY pattern ORDER BY doc_id, i) AS r FROM l, p WHERE regexp_matches(line, re))
SELECT pattern, count(*) AS n, list(context ORDER BY r) FILTER (r <= 3) AS examples FROM h GROUP BY 1""")
def line_audit(t):
    return html.pattern_audit(t("documents"), "doc_id", "text", {"licence": r"(?i)licen[cs]e", "mail": r"\S+@\S+", "rights": "rights reserved"})


@query("w3_merge_on_key", "SELECT lower(p_name) AS k, list_sort(list_distinct(list(p_brand))) AS brands, count(*) AS met FROM part GROUP BY 1")
def merge_on_key(t):
    return ledger.merge_on_key(t("part").select(F.lower("p_name").alias("k"), F.array("p_brand").alias("brands")), ["k"], ("brands",), "met")


@query("w8_map_merge", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS extra FROM customer")
def map_merge(t):
    old = F.create_map(F.lit("name"), c("c_name"), F.lit("state"), F.lit("old"))
    new = F.when(c("c_custkey") % 2 == 0, F.create_map(F.lit("state"), F.lit("new"), F.lit("extra"), F.lit("x")))
    rows = t("customer").select("c_custkey", ledger.map_merge(old, new).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return rows.select("c_custkey", get("name"), get("state"), get("extra"))


@query("w11_append_stage", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['ocr', 'chunk'] ELSE ['chunk'] END AS done FROM documents")
def append_stage(t):
    done = F.when(c("doc_id") % 2 == 0, F.array(F.lit("ocr"), F.lit("chunk")))
    return t("documents").select("doc_id", stages.with_stage(done, "chunk").alias("done"))


@query("w12_append_message", "SELECT conv_id, list(text ORDER BY turn) AS messages, count(*) AS n FROM conversations GROUP BY 1")
def append_message(t):
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return rows.select("conv_id", F.transform("m", lambda x: x["text"]).alias("messages"), "n")


@query("w15_vote_log", "SELECT user_id, event_type, greatest(sum(CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END), 0)::BIGINT AS n FROM events GROUP BY 1, 2")
def vote_log(t):
    return ledger.vote_counts(t("events").withColumn("gone", c("event_id") % 4 == 0), "user_id", "event_type", "gone")


@query("w16_sticky", "SELECT user_id, bool_or(value > 49) AS verified FROM events GROUP BY 1")
def sticky(t):
    rows = t("events").groupBy("user_id").agg(F.bool_or(c("value") > 49).alias("r"))
    return rows.select("user_id", ledger.sticky(c("r"), F.lit(None).cast("boolean")).alias("verified"))


@query("w17_sorted_pairs", "SELECT least(l_suppkey, l_partkey) AS l_suppkey, greatest(l_suppkey, l_partkey) AS l_partkey FROM lineitem WHERE l_suppkey <> l_partkey")
def sorted_pairs(t):
    return ledger.sorted_pair(t("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query("w25_ledger", "SELECT c_mktsegment, sum(c_custkey)::DOUBLE / 100 AS amount, sum(c_nationkey)::BIGINT AS units FROM customer GROUP BY 1")
def spend(t):
    return ledger.spend(t("customer"), "c_mktsegment", "c_custkey", "c_nationkey").withColumn("amount", c("amount").cast("double"))


@query("w2_clean_strength", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE least(value / 40, 1.0) END AS strength FROM events")
def clean_strength(t):
    return t("events").select("event_id", ledger.clean_strength(F.when(c("event_id") % 5 > 0, c("value") / 40)).alias("strength"))


@query("e4_new_records", """
WITH f AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderstatus AS place FROM orders WHERE o_orderkey % 2 = 0), k AS (SELECT o_orderdate::DATE AS day, o_orderstatus AS place FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority = '2-HIGH')
SELECT o_orderkey, day, place FROM f WHERE day NOT IN (SELECT day FROM k) OR (day, place) NOT IN (SELECT (day, place) FROM k)""")
def new_records(t):
    rows = t("orders").withColumn("day", c("o_orderdate").cast("date")).withColumn("place", c("o_orderstatus"))
    return ledger.new_records(rows.where("o_orderkey % 2 = 0").select("o_orderkey", "day", "place"), rows.where("o_orderkey % 2 = 1 AND o_orderpriority = '2-HIGH'"), "day", "place")


@query("e5_compare_counts", """
WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity < 45 GROUP BY 1)
SELECT k, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS stored, coalesce(a.n, 0) = coalesce(b.n, 0) AS matches FROM a FULL JOIN b USING (k)""")
def compare_counts(t):
    rows = t("lineitem").withColumn("k", c("l_orderkey"))
    n = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return ledger.compare_counts(n(rows), n(rows.where("l_quantity < 45")), "k")


@query("l1_routing", "SELECT doc_id, doc_id % 3 = 0 OR doc_id % 5 = 0 AS email_extract, doc_id % 3 = 1 AS visual_embed, doc_id % 7 = 0 AS redaction_detect, true AS ocr FROM documents")
def routing(t):
    d = c("doc_id")
    kind = F.when(d % 3 == 0, "memo").when(d % 3 == 1, "other").otherwise("court_filing")
    tags = F.when(d % 3 == 1, F.array(F.lit("photograph"))).otherwise(F.array().cast("array<string>"))
    flags = {"has_email_headers": d % 5 == 0, "has_financial_amounts": F.lit(False), "has_redaction_markers": d % 7 == 0, "has_date_references": F.lit(False)}
    needed = stages.routing(kind, tags, flags)
    return t("documents").select("doc_id", *[needed[s].alias(s) for s in ("email_extract", "visual_embed", "redaction_detect", "ocr")])


@query("l2_process", "SELECT doc_id, CASE WHEN n_chars > 1000 THEN ['ocr', 'classify', 'chunk'] ELSE ['ocr', 'classify'] END AS completed_stages FROM documents")
def process(t):
    docs = t("documents").select("doc_id", "n_chars", F.array().cast("array<string>").alias("completed_stages"))
    same = lambda df: df
    done = stages.process(docs, {"ocr": same, "classify": same, "chunk": same}, {"chunk": c("n_chars") > 1000})
    return done.select("doc_id", "completed_stages")


@query("l4_stage_costs", "SELECT doc_id, round((1 + n_chars // 3000) * (0.0015 + 0.0002 + CASE WHEN n_chars > 5000 THEN 0.0005 ELSE 0 END), 6)::DOUBLE AS cost FROM documents")
def stage_costs(t):
    pages = 1 + F.floor(c("n_chars") / 3000)
    return t("documents").select("doc_id", F.round(stages.costs(pages, {"ocr": F.lit(True), "classify": F.lit(True), "summarize": F.lit(False), "redaction_detect": c("n_chars") > 5000}), 6).alias("cost"))


def marked(t):
    head = F.concat(F.lit("intro line\n# Part "), "source", F.lit("\n--- Page 2 ---\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n## Notes\nFrom: "), "source", F.lit("\npaid $1,200.00 on March 3, 1999"))
    return t("documents").select("doc_id", head.alias("text"))


MARKED = "'intro line' || chr(10) || '# Part ' || source || chr(10) || '--- Page 2 ---' || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || '## Notes' || chr(10) || 'From: ' || source || chr(10) || 'paid $1,200.00 on March 3, 1999'"
SECTIONS = f"""d AS (SELECT doc_id, string_split({MARKED}, chr(10)) AS l FROM documents), n AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, regexp_extract(line, '---\\s*Page\\s+(\\d+)\\s*---', 1) AS mark, regexp_extract(line, '^(#{{1,4}})\\s+(.+)$', 1) AS hashes, trim(regexp_extract(line, '^(#{{1,4}})\\s+(.+)$', 2)) AS title FROM n),
g AS (SELECT *, sum((mark = '' AND hashes <> '')::INT) OVER w AS s, coalesce(last_value(nullif(mark, '') IGNORE NULLS) OVER w, '1')::INT AS page FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, s, CASE WHEN s = 0 THEN 'Document Start' ELSE min(title) FILTER (mark = '' AND hashes <> '') END AS title, (CASE WHEN s = 0 THEN 1 ELSE min(length(hashes)) FILTER (mark = '' AND hashes <> '') END)::INT AS level,
(CASE WHEN s = 0 THEN 1 ELSE min(page) FILTER (mark = '' AND hashes <> '') END)::INT AS page, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (mark = '' AND hashes = ''), ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM g GROUP BY 1, 2),
o AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS section, title, level, page, body FROM f WHERE body <> '')"""


@query("t1_sections", f"WITH {SECTIONS} SELECT doc_id, section, title, level, page, length(body)::INT AS chars, md5(body) AS body FROM o")
def section_rows(t):
    return chunker.section_rows(marked(t)).select("doc_id", "section", "title", "level", "page", F.length("body").alias("chars"), F.md5("body").alias("body"))


@query("t2_hierarchy", f"""WITH {SECTIONS}, a AS (SELECT x.doc_id, x.section, y.section AS up, y.title FROM o x JOIN o y ON y.doc_id = x.doc_id AND y.section <= x.section
AND (y.section = x.section OR y.level < (SELECT min(z.level) FROM o z WHERE z.doc_id = x.doc_id AND z.section > y.section AND z.section <= x.section)))
SELECT doc_id, section, list(title ORDER BY up) AS path FROM a GROUP BY 1, 2""")
def section_paths(t):
    return chunker.section_rows(marked(t)).select("doc_id", "section", "path")


@query("t4_chunks")
def chunks(t):
    return chunker.chunk_documents(marked(t)).drop("content")


@query("a11_document_flags", "SELECT doc_id, true AS has_email_headers, true AS has_financial_amounts, false AS has_redaction_markers, true AS has_date_references FROM documents WHERE NOT regexp_matches(text, '(?i)X{5,}')")
def document_flags(t):
    return chunker.document_flags(chunker.chunk_documents(marked(t).join(t("documents").where(~c("text").rlike("(?i)X{5,}")).select("doc_id"), "doc_id", "left_semi")))


@query("t11_riders", """
SELECT doc_id, unnest(['First Bank', 'Anna Example']) AS target, unnest(['financial_institution', 'individual']) AS target_kind, unnest(['May 1, 2001', 'June 2, 2002']) AS dated, unnest([2, 1]) AS n_statutes, unnest([1, 2]) AS n_items FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'unknown', 'other', 'July 3, 2003', 1, 1 FROM documents WHERE doc_id % 4 = 1""")
def riders(t):
    two = "RIDER (Grand Jury Subpoena to First Bank, dated May 1, 2001)\n18 U.S.C. § 371 and 21 U.S.C. § 846, 18 U.S.C. § 371\n1. All statements\n2. none\nRIDER (Grand Jury Subpoena to Anna Example, dated June 2, 2002)\n18 U.S.C. § 2(a)\n1. Letters sent\n2. Letters received\n"
    bare = "On July 3, 2003 under 18 U.S.C. § 371\n1. All records\n"
    text = F.when(c("doc_id") % 2 == 0, two).when(c("doc_id") % 4 == 1, bare).otherwise("nothing")
    found = extract.riders(t("documents").select("doc_id", text.alias("s"), F.lit(4).alias("pages")), "doc_id", "s", "pages")
    return found.select("doc_id", "target", "target_kind", "dated", F.size("statutes").alias("n_statutes"), F.size("items").alias("n_items"))


@query("t21_transcripts", """
WITH RECURSIVE x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, (turn * 10)::DOUBLE AS s, (turn * 10 + 9)::DOUBLE AS e, coalesce(text, '') AS t FROM conversations),
r(conv_id, i, chunk, s, e, t) AS (SELECT conv_id, i, 0, s, e, t FROM x WHERE i = 1 UNION ALL
SELECT x.conv_id, x.i, CASE WHEN r.t <> '' AND length(r.t) + 1 + length(x.t) > 1000 THEN chunk + 1 ELSE chunk END, CASE WHEN r.t = '' OR length(r.t) + 1 + length(x.t) > 1000 THEN x.s ELSE r.s END, x.e,
CASE WHEN r.t = '' OR length(r.t) + 1 + length(x.t) > 1000 THEN x.t ELSE r.t || ' ' || x.t END FROM r JOIN x ON x.conv_id = r.conv_id AND x.i = r.i + 1),
l AS (SELECT conv_id, chunk, max(i) AS i FROM r GROUP BY 1, 2)
SELECT r.conv_id, r.chunk::INT AS chunk, r.s AS start, coalesce((SELECT x.s FROM x WHERE x.conv_id = r.conv_id AND x.i = r.i + 1), r.e) AS "end", r.t AS text FROM r JOIN l USING (conv_id, chunk, i) WHERE r.t <> ''""")
def transcripts(t):
    rows = t("conversations").select("conv_id", (c("turn") * 10).alias("s"), (c("turn") * 10 + 9).alias("e"), "text")
    return extract.pack_segments(rows, "conv_id", "s", "e", "text")


@query("t13_dark_bars", "SELECT p_partkey, p_partkey % 9 >= 5 AS found, (p_partkey % 9) / 50.0::DOUBLE AS ratio, (p_partkey % 9)::INT AS rows, round(least(1.0::DOUBLE, (p_partkey % 9) / 5.0::DOUBLE + (p_partkey % 9) / 100.0::DOUBLE), 6) AS confidence FROM part")
def dark_bars(t):
    """Bars of 0 to 8 dark rows in pictures of 20 by 50."""
    image = F.expr("unhex(concat(repeat('0A', 20 * CAST(p_partkey % 9 AS int)), repeat('FF', 1000 - 20 * CAST(p_partkey % 9 AS int))))")
    found = extract.dark_bars(t("part").select("p_partkey", image.alias("image"), F.lit(20).alias("w"), F.lit(50).alias("h")), "p_partkey", "image", "w", "h")
    return found.withColumn("confidence", F.round("confidence", 6))


@query("t8_prompt_tiers", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'default' ELSE list_extract(['legal', 'money', 'default'], (doc_id % 3 + 1)::INT) END AS tier FROM documents""")
def prompt_tiers(t):
    kind = F.get(F.array(*map(F.lit, ("deposition", "tax_filing", "poem"))), (c("doc_id") % 3).cast("int"))
    tiers = extract.prompt_tiers(kind, F.when(c("doc_id") % 5 == 0, 0.2).otherwise(0.9), F.array(F.lit("tax_filing")), {"deposition": "legal", "tax_filing": "money"})
    return t("documents").select("doc_id", tiers["tier"].alias("tier"))


@query("t17_transactions", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 12.5 END::DOUBLE AS amount, 'USD' AS currency, CASE WHEN o_orderkey % 3 < 2 THEN 'wire' ELSE 'other' END AS kind FROM orders""")
def transactions(t):
    amount = F.when(c("o_orderkey") % 3 == 0, "12.50").otherwise("lots")
    kind = F.when(c("o_orderkey") % 3 < 2, "wire").otherwise("gift")
    text = F.concat(F.lit('[{"from":"a","to":"b","amount":"'), amount, F.lit('","type":"'), kind, F.lit('"}]'))
    rows = t("orders").select("o_orderkey", F.explode(extract.transactions(text, ("wire", "check"))).alias("x"))
    return rows.select("o_orderkey", c("x.amount").cast("double").alias("amount"), c("x.currency").alias("currency"), c("x.type").alias("kind"))


@query("t10_post_filter", """
SELECT l_orderkey, l_linenumber, least(1.0, l_discount * 20) AS confidence, round(0.7::DOUBLE * least(1.0, l_discount * 20), 6) AS evidence_weight FROM lineitem WHERE least(1.0, l_discount * 20) >= 0.5 AND l_returnflag = 'A' AND l_linenumber % 2 = 0""")
def post_filter(t):
    from millrace.functions.text import is_junk

    name = F.when(c("l_linenumber") % 2 == 0, "Anna Example").otherwise("Monday")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.when(c("l_returnflag") == "A", "person").otherwise("thing").alias("kind"), name.alias("name"), (c("l_discount") * 20).alias("confidence"))
    kept = extract.post_filter(rows, ("person", "place"), is_junk("name"), F.lit(0.7))
    return kept.select("l_orderkey", "l_linenumber", "confidence", F.round("evidence_weight", 6).alias("evidence_weight"))


@query("t5_flags_of_turns", "SELECT conv_id, turn, regexp_matches('From: ' || role || chr(10) || text, '(?im)^\\s*(From|To|Subject|Sent|CC|BCC)\\s*:') AS has_email_headers FROM conversations".replace("\\\\", "\\"))
def flags_of_turns(t):
    text = F.concat(F.lit("From: "), "role", F.lit("\n"), "text")
    return t("conversations").select("conv_id", "turn", chunk_flags(text)["has_email_headers"].alias("has_email_headers"))


QUERIES, ORACLE = query.queries, query.oracle


def stream(name: str, sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            return f(windows.events_stream(spark, f"{sf_dir}/events.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


@stream("st1_tumbling", 'SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2')
def tumbling(events):
    out = windows.latest(windows.finished(windows.tumbling(events, "1 day"), "update"), ["start", "event_type"])
    return out.withColumn("start", c("start").cast("timestamp_ntz"))


@stream("st2_sliding", """
WITH w AS (SELECT unnest([0, 1]) AS k, time_bucket(INTERVAL 1 day, ts) AS d, event_type FROM events) SELECT d - k * INTERVAL 1 day AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding(events):
    out = windows.latest(windows.finished(windows.sliding(events, "2 days", "1 day"), "update"), ["start", "event_type"])
    return out.withColumn("start", c("start").cast("timestamp_ntz"))


@stream("st3_sessions", """
WITH x AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k) SELECT * FROM s WHERE "end" <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def sessions(events):
    out = windows.finished(windows.sessions(events, "6 hours"), "append").drop("batch")
    return out.withColumns({k: c(k).cast("timestamp_ntz") for k in ("start", "end")})


@stream("st4_rate_limit", """
WITH RECURSIVE w(user_id, s) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 86400 SECOND GROUP BY w.user_id),
n AS (SELECT w.user_id, w.s, count(*) AS n FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s AND e.ts < w.s + INTERVAL 86400 SECOND GROUP BY 1, 2)
SELECT user_id, sum(least(n, 3))::BIGINT AS allowed, sum(greatest(n - 3, 0))::BIGINT AS blocked FROM n GROUP BY 1""")
def rate_limit(events):
    return windows.latest(windows.finished(windows.rate_limit(events, 3, 86400), "update"), ["user_id"])


@stream("st5_vote_states", """
SELECT user_id, count(*) FILTER (event_type = 'click') AS up, count(*) FILTER (event_type = 'error') AS down, count(*) FILTER (event_type = 'purchase') AS backing,
CASE WHEN count(*) FILTER (event_type = 'purchase') >= 3 AND count(*) FILTER (event_type = 'click') > count(*) FILTER (event_type = 'error') THEN 'corroborated' ELSE 'pending' END AS state FROM events GROUP BY 1""")
def vote_states(events):
    decide = lambda up, down, backing: F.when((backing >= 3) & (up > down), "corroborated").otherwise("pending")
    return windows.latest(windows.finished(windows.vote_states(events, decide), "update"), ["user_id"])


@stream("st6_vote_process", """
WITH a AS (SELECT event_id AS vote_id, event_id % 30 AS item, event_id % 30 * 2 + event_id // 30 % 2 AS proposal, user_id AS voter, CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' ELSE 'backing' END AS kind, ts FROM events WHERE event_type IN ('click', 'error', 'purchase')),
v AS (SELECT *, row_number() OVER (ORDER BY ts, vote_id) AS o, voter = proposal % 13 AS own FROM a WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM a)),
c AS (SELECT *, lag(kind) OVER (PARTITION BY proposal, voter ORDER BY o) AS was FROM v WHERE NOT own),
d AS (SELECT *, sum((kind = 'up')::INT - coalesce((was = 'up')::INT, 0)) OVER w AS up, sum((kind = 'down')::INT - coalesce((was = 'down')::INT, 0)) OVER w AS down, sum((kind = 'backing')::INT - coalesce((was = 'backing')::INT, 0)) OVER w AS backing
  FROM c WINDOW w AS (PARTITION BY proposal ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT item, min(o) AS o FROM d WHERE backing >= 3 GROUP BY 1), e AS (SELECT item, min(o) AS o FROM d WHERE backing >= 3 AND up + down + backing >= 7 AND down <= 0.25 * (up + down + backing) GROUP BY 1),
n AS (SELECT v.item, count(*) FILTER (NOT own AND v.o <= coalesce(e.o, v.o)) AS counted, count(*) FILTER (own AND v.o <= coalesce(e.o, v.o)) AS own, count(*) FILTER (v.o > e.o) AS late FROM v LEFT JOIN e USING (item) GROUP BY 1)
SELECT n.item, CASE WHEN e.o IS NOT NULL THEN 'confirmed' WHEN k.o IS NOT NULL THEN 'corroborated' ELSE 'unsolved' END AS status, s.proposal AS winner, b.vote_id AS corroborated_by, s.vote_id AS settled_by, counted, n.own, late
FROM n LEFT JOIN k USING (item) LEFT JOIN e USING (item) LEFT JOIN v b ON b.o = k.o LEFT JOIN v s ON s.o = e.o""")
def vote_process(events):
    """The events as votes: out of order as they come from files, with changed votes, own ones, and ones for settled items."""
    item, kind = c("event_id") % 30, F.when(c("event_type") == "click", "up").when(c("event_type") == "error", "down").otherwise("backing")
    proposal = item * 2 + F.floor(c("event_id") / 30) % 2
    cast = events.where(c("event_type").isin("click", "error", "purchase")).select(item.alias("item"), c("event_id").alias("vote_id"), proposal.alias("proposal"), (proposal % 13).alias("author"), c("user_id").alias("voter"), kind.alias("vote"), c("ts").alias("at"))
    with votes.rocksdb(events.sparkSession):
        return windows.latest(windows.finished(votes.outcomes(cast, "1 hour"), "update"), ["item"])
