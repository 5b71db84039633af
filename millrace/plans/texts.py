"""Scalar functions over texts that are put together from the tables, so that both outcomes of each test occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates, scores
from millrace.functions import text as T
from millrace.plans.base import Registry

query = Registry()
c = F.col
RAW = """CASE p_partkey % 8 WHEN 0 THEN 'Mr. ' || p_name WHEN 1 THEN upper(p_name) || ', Ph.D.' WHEN 2 THEN split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1)
 WHEN 3 THEN '"' || p_name || '"' WHEN 4 THEN p_name || ' (old ' || p_brand || ')' WHEN 5 THEN 'Gen. ' || p_name || ' Jr.' WHEN 6 THEN 'Sen. ' || p_name || ' CPA' ELSE '  ' END"""


def names(t):
    return t("part").select("p_partkey", F.expr(RAW).alias("raw"))


def normalize_sql(titles, suffixes) -> str:
    a = "lower(regexp_replace(regexp_replace(raw, '^[\"'']+|[\"'']+$', '', 'g'), '\\([^)]*\\)', '', 'g'))"
    b = rf"regexp_replace(regexp_replace({a}, '\b({'|'.join(titles)})\.?\s+', '', 'g'), ',?\s+({'|'.join(suffixes)})$', '', 'g')"
    turned = rf"CASE WHEN regexp_matches({b}, '^\s*[a-z]+([-''][a-z]+)?\s*,\s*[a-z]') THEN regexp_replace({b}, '^\s*([^,]+),\s*(.+)$', '\2 \1') ELSE {b} END"
    return f"SELECT p_partkey, nullif(trim(regexp_replace({turned}, '\\s+', ' ', 'g')), '') AS name FROM (SELECT p_partkey, {RAW} AS raw FROM part)"


TITLES = ("dr", "mr", "mrs", "ms", "prof", "sir", "hon", "rev", "gen", "col", "sgt", "lt", "cpt", "cmdr", "adm")
SUFFIXES = (r"jr\.?", r"sr\.?", "iii", "ii", "iv", r"esq\.?", "md", r"ph\.?d\.?")


@query("x1_normalize_name", normalize_sql(TITLES, SUFFIXES))
def normalize(t):
    return names(t).select("p_partkey", T.normalize_name("raw", extended=False).alias("name"))


@query("x2_normalize_name_extended", normalize_sql((*TITLES, "sen", "rep", "gov", "amb", "det", "spc", "cpl", "maj", "brig", "capt"), (*SUFFIXES, "v", "dds", "jd", "cpa", r"ret\.?")))
def normalize_extended(t):
    return names(t).select("p_partkey", T.normalize_name("raw").alias("name"))


@query("x3_normalize_name_simple", rf"SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(lower({RAW}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), '') AS name FROM part")
def normalize_simple(t):
    return names(t).select("p_partkey", T.normalize_name("raw", simple=True).alias("name"))


#: Names with what they are taken for: junk in any case, only as a person, or never.
NAMES = (
    ("Monday", "any"), ("SUNDAY", "any"), ("january", "any"), ("United States District Court", "any"), ("Southern District of Florida", "any"), ("Plaintiff", "any"), ("petitioner", "any"), ("EXHIBIT", "any"), ("Certificate", "any"), ("stipulation", "any"),
    ("esquire", "any"), ("Overruled", "any"), ("oath", "any"), ("Privileged", "any"), ("case number", "any"), ("Times New Roman", "any"), ("italic", "any"), ("footer", "any"), ("div", "any"), ("https", "any"), ("Unidentified", "any"), ("John Doe", "any"), ("Jane Doe #4", "any"),
    ("john doe 12", "any"), ("undefined", "any"), ("infra", "any"), ("Ibid", "any"), ("Mr", "any"), ("of", "any"), ("us", "any"), ("LLC", "any"), ("co", "any"), ("you", "any"), ("How", "any"), ("yes", "any"), ("paragraph", "any"), ("Charges", "any"), ("hearing", "any"),
    ("The Victim", "any"), ("unknown female", "any"), ("x", "any"), ("", "any"), ("12345", "any"), ("01/15/2003", "any"), ("2003-01-15", "any"), ("--- !!", "any"), ("AB", "any"), ("  Tuesday  ", "any"),
    ("Georgia", "person"), ("west virginia", "person"), ("Puerto Rico", "person"), ("Sweden", "person"), ("Anna Example", "none"), ("Abc", "none"), ("Sunday Smith", "none"), ("Court Street Partners", "none"), ("John Doerr", "none"), ("Acme Inc", "none"),
)
JUNK_RAW = "list_extract([" + ", ".join(f"'{n}'" for n, _ in NAMES) + "], (p_partkey % " + str(len(NAMES)) + " + 1)::INT)"
JUNK_IF = "list_extract([" + ", ".join(f"'{k}'" for _, k in NAMES) + "], (p_partkey % " + str(len(NAMES)) + " + 1)::INT)"


@query("x4_junk_names", f"SELECT p_partkey, {JUNK_RAW} AS raw, {JUNK_IF} = 'any' OR ({JUNK_IF} = 'person' AND p_size % 2 = 0) AS junk FROM part")
def junk(t):
    kind = F.when(c("p_size") % 2 == 0, "person").otherwise("location")
    raw = F.get(F.array(*[F.lit(n) for n, _ in NAMES]), (c("p_partkey") % len(NAMES)).cast("int"))
    return t("part").select("p_partkey", raw.alias("raw"), kind.alias("kind")).select("p_partkey", "raw", T.is_junk("raw", c("kind")).alias("junk"))


@query("x5_participants", """SELECT c_custkey, lower(c_name) AS who FROM customer""")
def participants(t):
    raw = F.concat(F.when(c("c_custkey") % 2 == 0, "Dr. ").otherwise(""), c("c_name"), F.lit(" <box@example.com>"))
    return t("customer").select("c_custkey", T.clean_participant(raw).alias("who"))


@query("x8_snippets", """
SELECT doc_id, (CASE WHEN p > 101 THEN '...' ELSE '' END) || substr(text, greatest(p - 100, 1), least(p + 5 + 99, length(text)) - greatest(p - 100, 1) + 1) || (CASE WHEN p + 104 < length(text) THEN '...' ELSE '' END) AS snippet
FROM (SELECT doc_id, text, instr(lower(text), 'trash') AS p FROM documents) WHERE p > 0""")
def snippets(t):
    rows = t("documents").withColumn("p", F.instr(F.lower("text"), "trash")).where("p > 0")
    return rows.select("doc_id", T.snippet(c("text"), c("p"), F.lit(5)).alias("snippet"))


@query("x9_head_tail", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN left(text, 3000) || chr(10) || '...' || chr(10) || right(text, 1000) ELSE text END AS sample FROM documents")
def head_tail(t):
    return t("documents").select("doc_id", T.head_tail("text", 4000, 3000, 1000).alias("sample"))


@query("x10_concat_nulls", "SELECT doc_id, concat(source, ': ', CASE WHEN lang = 'en' THEN NULL ELSE lang END, '/', n_chars) AS label FROM documents")
def concat_nulls(t):
    return t("documents").select("doc_id", T.concat_text("source", F.lit(": "), F.when(c("lang") != "en", c("lang")), F.lit("/"), "n_chars").alias("label"))


@query("x11_citations", "SELECT doc_id, '[' || source || '.pdf' || CASE WHEN doc_id % 4 > 0 THEN ', Page ' || (doc_id % 4) ELSE '' END || ']' AS cite FROM documents")
def citations(t):
    return t("documents").select("doc_id", T.citation(F.concat("source", F.lit(".pdf")), c("doc_id") % 4).alias("cite"))


@query("x12_parse_citations", "SELECT doc_id, [source || '.pdf', lang || '.txt'] AS files, [CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4)::INT END, 7] AS pages FROM documents")
def parse_citations(t):
    both = F.concat(T.citation(F.concat("source", F.lit(".pdf")), c("doc_id") % 4), F.lit(" and "), T.citation(F.concat("lang", F.lit(".txt")), F.lit(7)))
    rows = t("documents").select("doc_id", T.parse_citations(both).alias("x"))
    return rows.select("doc_id", c("x.file").alias("files"), c("x.page").alias("pages"))


@query("x13_footnotes", "SELECT doc_id, '[1] ' || source || ', p. 1' || chr(10) || '[2] ' || lang AS notes FROM documents")
def footnotes(t):
    return t("documents").select("doc_id", T.footnotes(F.array("source", "lang"), F.array(F.lit(1), F.lit(None).cast("int"))).alias("notes"))


KINDS = ("deposition", "subpoena", "email", "photograph", "plea_agreement", "tax_filing", "Flight_Log", "government_report", "calendar_schedule", "memo")
KIND_SQL = "list_extract([" + ", ".join(f"'{k}'" for k in KINDS) + "], (p_partkey % 11 + 1)::INT)"


def kinds(t):
    return t("part").select("p_partkey", F.get(F.array(*map(F.lit, KINDS)), (c("p_partkey") % 11).cast("int")).alias("kind"))


@query("x14_probative_weight", f"SELECT p_partkey, (CASE WHEN k IN ('deposition', 'plea_agreement') THEN 1.0 WHEN k IN ('subpoena', 'government_report') THEN 0.7 WHEN k IN ('tax_filing', 'flight_log') THEN 0.4 WHEN k IN ('email', 'memo') THEN 0.2 ELSE 0.1 END)::DOUBLE AS w FROM (SELECT p_partkey, lower({KIND_SQL}) AS k FROM part)")
def probative(t):
    return kinds(t).select("p_partkey", T.probative_weight("kind").alias("w"))


@query("x15_mention_weight", "SELECT l_orderkey, l_linenumber, (CASE l_linenumber % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.15 END)::DOUBLE AS w FROM lineitem")
def mention_weight(t):
    kind = F.get(F.array(*map(F.lit, ("direct", "Indirect", "implied", "co_occurrence"))), c("l_linenumber") % 5)
    return t("lineitem").select("l_orderkey", "l_linenumber", T.mention_weight(kind).alias("w"))


@query("x16_legacy_kind", f"SELECT p_partkey, CASE WHEN k IN ('deposition', 'photograph', 'flight_log') THEN k WHEN k IN ('subpoena', 'plea_agreement') THEN 'court_filing' WHEN k IN ('email', 'memo') THEN 'correspondence' WHEN k = 'tax_filing' THEN 'financial_record' WHEN k = 'government_report' THEN 'fbi_report' ELSE 'other' END AS kind FROM (SELECT p_partkey, lower({KIND_SQL}) AS k FROM part)")
def legacy(t):
    return kinds(t).select("p_partkey", T.legacy_kind("kind").alias("kind"))


@query("x17_relationship_kind", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'traveled_with' WHEN 1 THEN 'employed_by' WHEN 2 THEN NULL WHEN 3 THEN 'associate_of' ELSE 'co_defendant' END AS kind FROM customer")
def relationship(t):
    raw = F.get(F.array(*map(F.lit, ("traveled_with", "works for", "Anna Example", "unknown thing", "co-defendant"))), (c("c_custkey") % 5).cast("int"))
    return t("customer").select("c_custkey", T.relationship_kind(raw, ("traveled_with", "co_defendant", "employed_by"), {"works_for": "employed_by"}).alias("kind"))


#: Addressees with the kind that they are.
ADDRESSEES = (
    ("First Savings of X", "financial_institution"), ("Citibank", "financial_institution"), ("Wells  Fargo", "financial_institution"), ("Apple Bank", "financial_institution"), ("UBS", "financial_institution"), ("Apple Inc", "tech_company"), ("Verizon", "tech_company"), ("AT&T", "tech_company"),
    ("T-Mobile US", "tech_company"), ("Customs Office", "government"), ("FBI", "government"), ("Example Holdings", "other"), ("Blue Group", "other"), ("Anna Example", "individual"), ("Banksy", "individual"), ("Pineapple", "individual"),
)


@query("x18_target_kind", "SELECT c_custkey, list_extract([" + ", ".join(f"'{k}'" for _, k in ADDRESSEES) + "], (c_custkey % 16 + 1)::INT) AS kind FROM customer")
def target(t):
    raw = F.get(F.array(*[F.lit(n) for n, _ in ADDRESSEES]), (c("c_custkey") % 16).cast("int"))
    return t("customer").select("c_custkey", T.target_kind(raw).alias("kind"))


@query("x20_shell_flag", rf"SELECT o_orderkey, regexp_matches(CASE o_custkey % 3 WHEN 0 THEN 'Blue Trust' WHEN 1 THEN 'Trusted man' ELSE 'Red LLC' END, '\b(LLC|Ltd|Inc|Corp|Limited|Holdings|Trust)\b') AS shell FROM orders")
def shell(t):
    party = F.get(F.array(*map(F.lit, ("Blue Trust", "Trusted man", "Red LLC"))), (c("o_custkey") % 3).cast("int"))
    return t("orders").select("o_orderkey", T.is_shell(party).alias("shell"))


@query("x21_serial_ids", "SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 'ABCD' || lpad(page_id::VARCHAR, 8, '0') END AS serial FROM pages")
def serials(t):
    name = F.concat(F.when(c("page_id") % 3 > 0, "ABCD").otherwise("ABC"), F.lpad(c("page_id").cast("string"), 8, "0"), F.lit(".pdf"))
    return t("pages").select("page_id", T.serial_id(name, "ABCD").alias("serial"))


@query("x22_sha256", "SELECT doc_id, sha256(text) AS key FROM documents")
def sha(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("key"))


FORMS = "CASE o_orderkey % 7 WHEN 0 THEN {iso} WHEN 1 THEN {m} || '/' || {d} || '/' || {y} WHEN 2 THEN {m} || '/' || {d} || '/' || right({y}, 2) WHEN 3 THEN {mon} || ' ' || {d} || ', ' || {y} WHEN 4 THEN {y} WHEN 5 THEN {mon} || ' ' || {y} ELSE 'circa ' || {y} END"


def dated(t):
    parts = {"iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "m": "cast(month(o_orderdate) as string)", "d": "cast(day(o_orderdate) as string)", "y": "cast(year(o_orderdate) as string)", "mon": "date_format(o_orderdate, 'MMMM')"}
    return t("orders").select("o_orderkey", "o_orderdate", F.expr(FORMS.format(**parts)).alias("written"))


@query("d1_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 4 THEN o_orderdate::DATE WHEN o_orderkey % 7 = 4 THEN make_date(year(o_orderdate), 1, 1) END AS d FROM orders")
def parse_date(t):
    return dated(t).select("o_orderkey", dates.parse_date("written").alias("d"))


@query("d2_date_precision", "SELECT o_orderkey, list_extract(['exact', 'day', 'day', 'day', 'year', 'month', 'approximate'], (o_orderkey % 7 + 1)::INT) AS precision FROM orders")
def precision(t):
    return dated(t).select("o_orderkey", dates.date_precision("written").alias("precision"))


@query("d3_display_date", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN strftime(o_orderdate, '%B %Y') ELSE 'c. ' || strftime(o_orderdate, '%Y') END AS shown,
CASE WHEN o_orderkey % 3 = 0 THEN 'Until ' || strftime(o_orderdate, '%B %-d, %Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%B %-d, %Y') || ' -- present' ELSE 'Unknown period' END AS span FROM orders""")
def display(t):
    precision_ = F.get(F.array(*map(F.lit, ("day", "year", "month", "approximate"))), (c("o_orderkey") % 4).cast("int"))
    first, last = F.when(c("o_orderkey") % 3 == 1, c("o_orderdate").cast("date")), F.when(c("o_orderkey") % 3 == 0, c("o_orderdate").cast("date"))
    return t("orders").select("o_orderkey", dates.display_date("o_orderdate", precision_).alias("shown"), dates.date_range(first, last).alias("span"))


@query("d4_normalize_date", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def normalize_date(t):
    forms = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "M/d/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"), F.lit("no date"))
    return t("orders").select("o_orderkey", dates.normalize_date(F.get(forms, (c("o_orderkey") % 4).cast("int"))).alias("d"))


@query("d6_day_window", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-05-03' - 7 AND DATE '1997-05-03' + 7")
def day_window(t):
    return t("orders").where(dates.within_days("o_orderdate", F.lit("1997-05-03"), 7)).select("o_orderkey")


FLAG_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN 'note' || chr(10) || 'From: ' || o_custkey WHEN 1 THEN 'paid $' || format_number_ || ' in full' WHEN 2 THEN 'name [REDACTED] here' WHEN 3 THEN 'on March 3, 1999 we' WHEN 4 THEN 'see XXXXXX and 12/31/1999' ELSE 'nothing here' END"""


@query("t5_chunk_flags", rf"""
WITH x AS (SELECT o_orderkey, {FLAG_TEXT.replace("format_number_", "o_custkey")} AS s FROM orders)
SELECT o_orderkey, regexp_matches(s, '(?im)^\s*(From|To|Subject|Sent|CC|BCC)\s*:') AS has_email_headers,
regexp_matches(s, '[$€£]\s?\(?[0-9]{{1,3}}(,[0-9]{{3}})*(\.[0-9]{{2}})?\)?|\b[0-9]{{1,3}}(,[0-9]{{3}})+\.[0-9]{{2}}\b') AS has_financial_amounts, regexp_matches(s, '(?i)\[(REDACTED|SEALED|REDACTION|[*]{{3,}})\]|█{{3,}}|X{{5,}}') AS has_redaction_markers,
regexp_matches(s, '\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{{1,2}},?\s+[0-9]{{4}}\b|\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}\b|\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b') AS has_date_references FROM x""")
def flags(t):
    rows = t("orders").select("o_orderkey", F.expr(FLAG_TEXT.replace("format_number_", "o_custkey")).alias("s"))
    return rows.select("o_orderkey", *[f.alias(k) for k, f in T.chunk_flags("s").items()])


SAMPLES = (
    "Tail # N123AB, pilot, passenger manifest, flight log", "Q. Yes? A. No. DEPOSITION with sworn testimony", "SUBPOENA: you are hereby commanded, duces tecum",
    "WIRE TRANSFER, bank statement, invoice #4", "From: a@b.c To: d@e.f Subject: x Sent: now", "nothing of the kind",
)
FILES = ("flight_7.pdf", "depo.pdf", "letter.pdf", "bank.pdf", "email.txt")


@query("t6_classify_by_rules", r"""
WITH x AS (SELECT doc_id, list_extract(['Tail # N123AB, pilot, passenger manifest, flight log', 'Q. Yes? A. No. DEPOSITION with sworn testimony', 'SUBPOENA: you are hereby commanded, duces tecum', 'WIRE TRANSFER, bank statement, invoice #4', 'From: a@b.c To: d@e.f Subject: x Sent: now', 'nothing of the kind'], (doc_id % 6 + 1)::INT) || ' ' || source AS s, list_extract(['flight_7.pdf', 'depo.pdf', 'letter.pdf', 'bank.pdf', 'email.txt'], (doc_id % 5 + 1)::INT) AS f FROM documents),
v AS (SELECT doc_id, f, list_reverse_sort(list_filter([{'n': CAST(regexp_matches(s, '(?i)\b(tail\s*#|N\d{3,5}[A-Z]{0,2})\b') AS INT) + CAST(regexp_matches(s, '(?i)\bpassenger\s+manifest\b') AS INT) + CAST(regexp_matches(s, '(?i)\bflight\s+log\b') AS INT) + CAST(regexp_matches(s, '(?i)\b(departure|arrival)\s+(time|date|airport)\b') AS INT) + CAST(regexp_matches(s, '(?i)\b(pilot|co-?pilot|captain)\b') AS INT), 'o': 0, 'k': 'flight_log'},
  {'n': CAST(regexp_matches(s, '\bQ\.\s+') AS INT) + CAST(regexp_matches(s, '\bA\.\s+') AS INT) + CAST(regexp_matches(s, '(?i)\bDEPOSITION\b') AS INT) + CAST(regexp_matches(s, '(?i)\bsworn\s+testimony\b') AS INT) + CAST(regexp_matches(s, '(?i)\b(direct|cross)\s+examination\b') AS INT), 'o': -1, 'k': 'deposition'},
  {'n': CAST(regexp_matches(s, '(?i)\bGRAND\s+JURY\b') AS INT) + CAST(regexp_matches(s, '\bQ\.\s+') AS INT) + CAST(regexp_matches(s, '\bA\.\s+') AS INT) + CAST(regexp_matches(s, '(?i)\bsworn\b') AS INT) + CAST(regexp_matches(s, '(?i)\bforeperson\b') AS INT), 'o': -2, 'k': 'grand_jury_testimony'},
  {'n': CAST(regexp_matches(s, '(?i)\bSUBPOENA\b') AS INT) + CAST(regexp_matches(s, '(?i)\bRIDER\s*\(Grand\s+Jury\b') AS INT) + CAST(regexp_matches(s, '(?i)\byou\s+are\s+(hereby\s+)?commanded\b') AS INT) + CAST(regexp_matches(s, '(?i)\bduces\s+tecum\b') AS INT), 'o': -3, 'k': 'subpoena'},
  {'n': CAST(regexp_matches(s, '(?i)\bWIRE\s+TRANSFER\b') AS INT) + CAST(regexp_matches(s, '(?i)\bACCOUNT\s+STATEMENT\b') AS INT) + CAST(regexp_matches(s, '(?i)\binvoice\s+#') AS INT) + CAST(regexp_matches(s, '(?i)\bbank\s+statement\b') AS INT) + CAST(regexp_matches(s, '(?i)\b(debit|credit)\s+balance\b') AS INT), 'o': -4, 'k': 'financial_record'},
  {'n': CAST(regexp_matches(s, '(?i)\bCALL\s+LOG\b') AS INT) + CAST(regexp_matches(s, '\bCDR\b') AS INT) + CAST(regexp_matches(s, '(?i)\bphone\s+record\b') AS INT) + CAST(regexp_matches(s, '(?i)\b(incoming|outgoing)\s+(call|number)\b') AS INT) + CAST(regexp_matches(s, '(?i)\bcall\s+detail\s+record\b') AS INT), 'o': -5, 'k': 'phone_record'},
  {'n': CAST(regexp_matches(s, '(?i)\baddress\s+book\b') AS INT) + CAST(regexp_matches(s, '(?i)\bcontact\s+list\b') AS INT) + CAST(regexp_matches(s, '(?i)\bphone\s+directory\b') AS INT) + CAST(regexp_matches(s, '(?i)\brolodex\b') AS INT), 'o': -6, 'k': 'address_book'},
  {'n': CAST(regexp_matches(s, '(?i)\bFrom:\s+\S+@\S+') AS INT) + CAST(regexp_matches(s, '(?i)\bTo:\s+\S+@\S+') AS INT) + CAST(regexp_matches(s, '(?i)\bSubject:\s+') AS INT) + CAST(regexp_matches(s, '(?i)\bSent:\s+') AS INT) + CAST(regexp_matches(s, '(?i)\bDate:\s+.*\d{4}') AS INT), 'o': -7, 'k': 'email'},
  {'n': CAST(regexp_matches(s, '\bFBI\b') AS INT) + CAST(regexp_matches(s, '(?i)\bFD-?302\b') AS INT) + CAST(regexp_matches(s, '(?i)\bFederal\s+Bureau\s+of\s+Investigation\b') AS INT) + CAST(regexp_matches(s, '(?i)\bspecial\s+agent\b') AS INT), 'o': -8, 'k': 'fbi_report'},
  {'n': CAST(regexp_matches(s, '(?i)\bINDICTMENT\b') AS INT) + CAST(regexp_matches(s, '(?i)\bCOUNT\s+(ONE|TWO|THREE|[IVX]+|\d+)\b') AS INT) + CAST(regexp_matches(s, '(?i)\bthe\s+grand\s+jury\s+charges\b') AS INT) + CAST(regexp_matches(s, '(?i)\bin\s+violation\s+of\b') AS INT), 'o': -9, 'k': 'indictment'}], lambda x: x.n >= 3))[1] AS b FROM x) SELECT doc_id, CASE WHEN (b.k = 'flight_log' AND regexp_matches(f, 'flight|manifest')) OR (b.k = 'deposition' AND regexp_matches(f, 'depo|deposition')) OR (b.k = 'subpoena' AND regexp_matches(f, 'subpoena|rider')) OR (b.k = 'financial_record' AND regexp_matches(f, 'bank|wire|financial|invoice')) OR (b.k = 'phone_record' AND regexp_matches(f, 'phone|call|cdr')) OR (b.k = 'address_book' AND regexp_matches(f, 'address|contact|black.?book')) OR (b.k = 'email' AND regexp_matches(f, 'email')) OR (b.k = 'fbi_report' AND regexp_matches(f, 'fbi|302')) OR (b.k = 'indictment' AND regexp_matches(f, 'indictment')) OR (b.k = 'grand_jury_testimony' AND regexp_matches(f, 'grand.?jury')) THEN b.k END AS kind, CASE WHEN (b.k = 'flight_log' AND regexp_matches(f, 'flight|manifest')) OR (b.k = 'deposition' AND regexp_matches(f, 'depo|deposition')) OR (b.k = 'subpoena' AND regexp_matches(f, 'subpoena|rider')) OR (b.k = 'financial_record' AND regexp_matches(f, 'bank|wire|financial|invoice')) OR (b.k = 'phone_record' AND regexp_matches(f, 'phone|call|cdr')) OR (b.k = 'address_book' AND regexp_matches(f, 'address|contact|black.?book')) OR (b.k = 'email' AND regexp_matches(f, 'email')) OR (b.k = 'fbi_report' AND regexp_matches(f, 'fbi|302')) OR (b.k = 'indictment' AND regexp_matches(f, 'indictment')) OR (b.k = 'grand_jury_testimony' AND regexp_matches(f, 'grand.?jury')) THEN b.n END AS matches FROM v""")
def classify(t):
    pick = lambda options, n: F.get(F.array(*map(F.lit, options)), (c("doc_id") % n).cast("int"))
    rows = t("documents").select("doc_id", F.concat(pick(SAMPLES, 6), F.lit(" "), "source").alias("s"), pick(FILES, 5).alias("f"))
    found = rows.select("doc_id", T.classify_by_rules("s", "f").alias("r"))
    return found.select("doc_id", c("r.kind").alias("kind"), c("r.matches").alias("matches"))


@query("t7_model_answer", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'email' ELSE 'other' END AS kind, (CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0.3 END)::DOUBLE AS confidence, CASE WHEN doc_id % 4 = 0 THEN ['memo'] ELSE [] END AS tags FROM documents""")
def model_answer(t):
    from millrace.operators.extract import classification

    forms = F.array(F.lit('{"type":"email","confidence":1.7,"tags":[{"type":"memo","confidence":0.5},{"type":"fax","confidence":0.1},{"type":"email","confidence":0.9}]}'), F.lit('{"type":"poem","confidence":0.4}'), F.lit("no json"), F.lit(None).cast("string"))
    rows = t("documents").select("doc_id", classification(F.get(forms, (c("doc_id") % 4).cast("int")), ("email", "memo", "fax", "other")).alias("r"))
    return rows.select("doc_id", c("r.kind").alias("kind"), c("r.confidence").alias("confidence"), c("r.tags").alias("tags"))


@query("t12_redaction_gate", "SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 2")
def gate(t):
    rows = t("orders").select("o_orderkey", F.expr(FLAG_TEXT.replace("format_number_", "o_custkey")).alias("s"))
    return rows.where(T.redaction_gate("s")).select("o_orderkey")


@query("t18_media_prescreen", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'no_audio' WHEN l_quantity <= 25 AND l_extendedprice > 30000 THEN 'surveillance' WHEN l_extendedprice < 6000 OR l_linestatus = 'F' THEN 'speech' ELSE 'other' END AS media FROM lineitem""")
def prescreen(t):
    from millrace.operators.extract import prescreen_media

    wide = F.when(c("l_quantity") <= 25, 640).otherwise(1920)
    kind = prescreen_media(c("l_returnflag") != "A", c("l_linestatus") != "F", wide, F.when(c("l_quantity") <= 25, 480).otherwise(1080), c("l_extendedprice") / 10)
    return t("lineitem").select("l_orderkey", "l_linenumber", kind.alias("media"))


@query("t22_ocr_pages", r"""
WITH x AS (SELECT doc_id, source || chr(10) || '--- Page 4 ---' || chr(10) || lang || chr(10) || '--- Page 9 ---' || chr(10) || (CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE 'end' END) AS s FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(s, '---\s*Page\s+\d+\s*---'), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '') AS p FROM x)
SELECT doc_id, unnest(range(1, len(p) + 1))::INT AS page, unnest(p) AS text FROM p""")
def ocr_pages(t):
    from millrace.operators.extract import split_pages

    last = F.when(c("doc_id") % 2 == 0, " ").otherwise("end")
    rows = t("documents").select("doc_id", F.concat("source", F.lit("\n--- Page 4 ---\n"), "lang", F.lit("\n--- Page 9 ---\n"), last).alias("s"))
    return split_pages(rows, "doc_id", "s")


@query("t23_header_input", """
WITH x AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN conv_id % 2 = 0 THEN first_value(left(text, 80)) OVER (PARTITION BY conv_id ORDER BY turn) END AS summary FROM conversations WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, turn, CASE WHEN summary IS NOT NULL THEN 'Document summary: ' || summary || chr(10) || chr(10) ELSE '' END || 'Chunk ' || i || ' of ' || n || ':' || chr(10) || left(text, 1000) AS header FROM x""")
def header_input(t):
    """Conversations as documents and turns as their chunks; those with even numbers have a summary."""
    from millrace.operators.extract import header_inputs

    first = t("conversations").where("conv_id % 2 = 0").groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 80), "turn").alias("summary"))
    return header_inputs(t("conversations"), "conv_id", "turn", "text", first).select("conv_id", "turn", c("input").alias("header"))


@query("t20_embed_once", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS computed_for FROM documents")
def embed_once(t):
    rows = t("documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return rows.join(rows.groupBy("key").agg(F.min("doc_id").alias("computed_for")), "key").select("doc_id", "computed_for")


@query("k3_priority_score", r"""
WITH r AS (SELECT user_id AS doc_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS persons FROM events GROUP BY 1),
x AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents),
f AS (SELECT doc_id, (len(regexp_extract_all(s, '\btrash\b')) * 2 + len(regexp_extract_all(s, '\bidiots?\b')) * 3)::DOUBLE AS hits, len(regexp_extract_all(s, '(?:idiot|clown)s?\s+\w+')) + len(regexp_extract_all(s, 'such\s+trash')) AS near,
  regexp_matches(s, '\bidiot\b')::INT + regexp_matches(s, '\bclown\b')::INT + regexp_matches(s, '\ball rights reserved\b')::INT AS officials FROM x)
SELECT doc_id, round(least(1.0, 0.3::DOUBLE * least(1.0, hits / 50) + 0.4::DOUBLE * least(1.0, (coalesce(n, 0) + coalesce(persons, 0)) / 20.0::DOUBLE) + 0.3::DOUBLE * least(1.0, near / 5.0::DOUBLE) + least(0.2, 0.05::DOUBLE * officials)), 6) AS score
FROM f LEFT JOIN r USING (doc_id)""")
def priority(t):
    """Keywords, phrases and listed names as they stand in the texts; an event of the document's number is a redaction, an error one of a person."""
    from millrace.operators.resolve import find_mentions

    marks = t("events").groupBy(c("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("event_type") == "error").alias("persons"))
    names = t.spark.createDataFrame([(1, "idiot", 1.0), (2, "clown", 1.0), (3, "all rights reserved", 1.0)], "entity int, name string, confidence double")
    officials = find_mentions(t("documents"), "doc_id", "text", names, "entity", "name").groupBy("doc_id").agg(F.count(F.lit(1)).alias("officials"))
    rows = t("documents").select("doc_id", "text").join(marks, "doc_id", "left").join(officials, "doc_id", "left")
    score = scores.priority_score("text", {"trash": 2, "idiots?": 3}, (r"(?:idiot|clown)s?\s+\w+", r"such\s+trash"), c("n"), c("persons"), c("officials"))
    return rows.select("doc_id", F.round(score, 6).alias("score"))


QUERIES, ORACLE = query.queries, query.oracle
