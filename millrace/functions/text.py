"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles and suffixes that name normalisation strips.
TITLES = ("dr", "mr", "mrs", "ms", "prof", "sir", "hon", "rev", "gen", "col", "sgt", "lt", "cpt", "cmdr", "adm")
MORE_TITLES = ("sen", "rep", "gov", "amb", "det", "spc", "cpl", "maj", "brig", "capt")
SUFFIXES = (r"jr\.?", r"sr\.?", "iii", "ii", "iv", r"esq\.?", "md", r"ph\.?d\.?")
MORE_SUFFIXES = ("v", "dds", "jd", "cpa", r"ret\.?")

# What flags a chunk of text.
EMAIL_HEADERS = r"(?im)^\s*(From|To|Subject|Sent|CC|BCC)\s*:"
AMOUNTS = r"[\$€£]\s?\(?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\)?|\b\d{1,3}(?:,\d{3})+\.\d{2}\b"
REDACTIONS = r"(?i)\[(REDACTED|SEALED|REDACTION|\*{3,})\]|█{3,}|X{5,}"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DATES = rf"\b(?:{'|'.join(MONTHS)})\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}\/\d{{1,2}}\/\d{{2,4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b"

# What names a company.
SHELL = r"\b(LLC|Ltd|Inc|Corp|Limited|Holdings|Trust)\b"
# What tells kinds of addressees apart, in the order of their precedence.
TARGETS = (
    ("financial_institution", r"(?i)\b(bank|credit\s+union|savings|trust\s+company|securities|brokerage|investment|citibank|chase|wells\s+fargo|goldman|morgan\s+stanley|deutsche\s+bank|barclays|hsbc|ubs)\b"),
    ("tech_company", r"(?i)\b(google|apple|microsoft|facebook|meta|amazon|twitter|at&t|verizon|t-mobile|sprint|comcast)\b"),
    ("government", r"(?i)\b(department|agency|bureau|office|commission|irs|faa|sec|fbi|dea|ice|customs|immigration)\b"),
)
CORPORATE = r"(?i)\b(inc|llc|ltd|corp|company|co\.|group|holdings|associates)\b"

# Weights of kinds of documents by tier, and of mentions.
TIERS = {
    1.0: ("deposition", "grand_jury_testimony", "witness_statement", "plea_agreement"),
    0.7: ("court_filing", "indictment", "subpoena", "search_warrant", "police_report", "fbi_report", "government_report"),
    0.4: ("flight_log", "financial_record", "tax_filing", "trust_document", "phone_record", "medical_record", "corporate_filing", "property_record"),
    0.2: ("correspondence", "email", "letter", "memo", "fax"),
}
LEAST_WEIGHT = 0.1
MENTION_WEIGHTS = {"direct": 1.0, "indirect": 0.5, "implied": 0.3, "co_occurrence": 0.15}
# Kinds that keep their name in the older scheme, and parents of the others.
LEGACY_SAME = ("deposition", "flight_log", "financial_record", "police_report", "court_filing", "correspondence", "phone_record", "address_book", "fbi_report", "grand_jury_testimony", "witness_statement", "property_record", "medical_record", "photograph", "news_clipping")
LEGACY_PARENT = {
    "court_filing": ("plea_agreement", "indictment", "subpoena", "search_warrant"),
    "fbi_report": ("government_report",),
    "financial_record": ("tax_filing", "trust_document", "corporate_filing", "receipt_invoice"),
    "correspondence": ("email", "letter", "memo", "fax"),
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, values: dict, default) -> Column:
    """A literal map as a chain of conditions, which codegen folds."""
    chain = reduce(lambda w, kv: w.when(key == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(key == next(iter(values)), F.lit(next(iter(values.values())))))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def normalize_name(name: Column | str, extended: bool = True, simple: bool = False) -> Column:
    """A name for matching: lower case, without quotes, brackets, titles and suffixes; "last, first" turned round; blank: null.

    extended: also strips MORE_TITLES and MORE_SUFFIXES. simple: only keeps a-z, 0-9 and single spaces.
    """
    c = col(name)
    if simple:
        out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))
        return F.nullif(out, F.lit(""))
    titles = TITLES + (MORE_TITLES if extended else ())
    suffixes = SUFFIXES + (MORE_SUFFIXES if extended else ())
    out = F.regexp_replace(c, "^[\"']+|[\"']+$", "")
    out = F.lower(F.regexp_replace(out, r"\([^)]*\)", ""))
    out = F.regexp_replace(out, rf"\b({'|'.join(titles)})\.?\s+", "")
    out = F.regexp_replace(out, rf",?\s+({'|'.join(suffixes)})$", "")
    turned = F.regexp_replace(out, r"^\s*([^,]+),\s*(.+)$", "$2 $1")
    out = F.when(out.rlike(r"^\s*[a-z]+([-'][a-z]+)?\s*,\s*[a-z]"), turned).otherwise(out)
    return F.nullif(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


# Names that are never entities; days, months and single letters are added by rule.
JUNK = (
    "united states district court", "united states of america",
    "southern district of new york", "southern district of florida",
    "northern district", "eastern district", "western district",
    "department of justice", "federal bureau of investigation",
    "plaintiff", "defendant", "petitioner", "respondent",
    "exhibit", "deposition", "testimony", "declaration",
    "affidavit", "certificate", "motion", "order", "judgment",
    "stipulation", "subpoena", "complaint", "indictment",
    "court", "judge", "attorney", "counsel", "esquire",
    "objection", "sustained", "overruled", "sidebar",
    "witness", "sworn", "oath", "perjury",
    "privileged", "confidential", "sealed", "redacted",
    "case no", "case number", "docket",
    "arial", "times new roman", "helvetica", "courier",
    "bold", "italic", "underline", "font",
    "page", "header", "footer", "table",
    "div", "span", "class", "style",
    "http", "https", "www", "html", "pdf",
    "unknown", "unnamed", "unidentified", "anonymous",
    "john doe", "jane doe", "doe",
    "n/a", "none", "null", "undefined", "other",
    "same", "above", "below", "supra", "infra",
    "see", "also", "note", "ibid",
    "mr", "mrs", "ms", "dr", "the",
    "id", "no", "or", "an", "at", "by", "do", "go", "if", "in",
    "is", "it", "my", "of", "on", "so", "to", "up", "us", "we",
    "inc", "llc", "ltd", "corp", "co",
    "and", "but", "for", "not", "you", "all", "can", "had", "her", "was",
    "one", "our", "out", "day", "get", "has", "him", "his", "how", "its",
    "let", "new", "now", "old", "say", "she", "too", "use", "way", "who",
    "did", "got", "may", "any", "own", "set", "sir", "top", "yes",
    "chapter", "section", "article", "paragraph", "clause", "count",
    "statement", "report", "record", "document", "evidence", "charges",
    "allegation", "response", "answer", "brief", "filing", "trial",
    "hearing", "appeal", "review", "summary", "transcript",
    "the defendant", "the witness", "the victim", "the plaintiff",
    "the respondent", "the petitioner", "the court", "the government",
    "unknown male", "unknown female", "unidentified male", "unidentified female",
)
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# Places that are no persons.
PLACES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado",
    "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana",
    "maine", "maryland", "massachusetts", "michigan", "minnesota",
    "mississippi", "missouri", "montana", "nebraska", "nevada",
    "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania",
    "rhode island", "south carolina", "south dakota", "tennessee", "texas",
    "utah", "vermont", "virginia", "washington", "west virginia",
    "wisconsin", "wyoming",
    "united states", "united kingdom", "canada", "mexico", "france",
    "germany", "japan", "china", "russia", "australia", "brazil",
    "india", "israel", "italy", "spain", "switzerland", "sweden",
    "district of columbia", "puerto rico", "virgin islands", "guam",
)


def is_junk(name: Column | str, kind: Column | None = None, junk: tuple[str, ...] = JUNK, places: tuple[str, ...] = PLACES) -> Column:
    """True for what extraction often takes for a name: too short, only digits or dates, no letters, listed words, numbered Does; places if a person."""
    trimmed = F.regexp_replace(col(name), r"^\s+|\s+$", "")
    low = F.lower(trimmed)
    listed = (*junk, *DAYS, *(m.lower() for m in MONTHS), *"abcdefghijklmnopqrstuvwxyz")
    out = (F.length(low) <= 1) | low.rlike(r"^\d+([/\-.]\d+)*$") | trimmed.rlike(r"^[^a-zA-Z]*$|^[A-Z]{1,2}$") | low.isin(*listed) | low.rlike(r"^(jane|john)\s+doe\s*#?\d*$")
    return out | (F.coalesce(kind == "person", F.lit(False)) & low.isin(*places)) if kind is not None and places else out


def clean_participant(raw: Column | str) -> Column:
    """An e-mail participant: what stands before <, in lower case, without titles."""
    out = F.lower(F.trim(F.split_part(col(raw), F.lit("<"), F.lit(1))))
    return F.trim(F.regexp_replace(F.regexp_replace(out, rf"\b({'|'.join(TITLES)})\.?\s+", ""), r"\s+", " "))


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity_of(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct trigrams; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def similarity(a: Column | str, b: Column | str) -> Column:
    return similarity_of(trigrams(a), trigrams(b))


def snippet(text: Column, at: Column, length: Column, around: int = 100) -> Column:
    """What stands around a match at 1-based position `at`, with ... where text is left out."""
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + length + around - 1, F.length(text))
    body = F.substring(text, first, last - first + 1)
    return F.concat(F.when(first > 1, "...").otherwise(""), body, F.when(last < F.length(text), "...").otherwise(""))


def head_tail(text: Column | str, over: int, head: int, tail: int, joint: str = "\n...\n") -> Column:
    """The text, or beyond `over` characters its head and tail."""
    c = col(text)
    return F.when(F.length(c) > over, F.concat(F.substring(c, 1, head), F.lit(joint), F.right(c, F.lit(tail)))).otherwise(c)


def concat_text(*parts: Column | str) -> Column:
    """Concatenation for which null is ''."""
    return F.concat(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def citation(file: Column | str, page: Column | str | None = None, dataset: Column | str | None = None) -> Column:
    """[file, Page n], without the page if it is null or 0."""
    name = col(file) if dataset is None else F.concat(col(dataset), F.lit("/"), col(file))
    if page is None:
        return F.concat(F.lit("["), name, F.lit("]"))
    n = col(page)
    return F.concat(F.lit("["), name, F.when(n.isNotNull() & (n != 0), F.concat(F.lit(", Page "), n.cast("string"))).otherwise(""), F.lit("]"))


CITATION = r"\[([^\]]+?)(?:,\s*Page\s*(\d+))?\]"


def parse_citations(text: Column | str) -> Column:
    """All citations of a text as (file, page)."""
    files = F.regexp_extract_all(col(text), F.lit(CITATION), F.lit(1))
    pages = F.regexp_extract_all(col(text), F.lit(CITATION), F.lit(2))
    return F.transform(F.arrays_zip(files.alias("file"), pages.alias("page")), lambda x: F.struct(x["file"].alias("file"), F.nullif(x["page"], F.lit("")).cast("int").alias("page")))


def footnotes(files: Column, pages: Column) -> Column:
    """Numbered lines [i] file, p. n."""
    rows = F.transform(F.arrays_zip(files.alias("f"), pages.alias("p")), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["f"], F.coalesce(F.concat(F.lit(", p. "), x["p"].cast("string")), F.lit(""))))
    return F.array_join(rows, "\n")


def probative_weight(kind: Column | str) -> Column:
    k = F.lower(F.coalesce(col(kind), F.lit("other")))
    return reduce(lambda w, t: w.when(k.isin(*TIERS[t]), F.lit(t)), list(TIERS)[1:], F.when(k.isin(*TIERS[1.0]), F.lit(1.0))).otherwise(F.lit(LEAST_WEIGHT))


def mention_weight(kind: Column | str) -> Column:
    return lookup(F.lower(F.coalesce(col(kind), F.lit("co_occurrence"))), MENTION_WEIGHTS, MENTION_WEIGHTS["co_occurrence"])


def legacy_kind(kind: Column | str) -> Column:
    k = F.lower(F.coalesce(col(kind), F.lit("other")))
    out = F.when(k.isin(*LEGACY_SAME), k)
    for parent, children in LEGACY_PARENT.items():
        out = out.when(k.isin(*children), F.lit(parent))
    return out.otherwise(F.lit("other"))


def relationship_kind(raw: Column | str, valid: tuple[str, ...], aliases: dict[str, str], default: str = "associate_of") -> Column:
    """A valid kind as it is, an alias mapped; what looks like a name (a capital, a space) null; all else the default."""
    c = F.trim(col(raw))
    low = F.lower(F.regexp_replace(c, r"[\s-]+", "_"))
    out = F.when(low.isin(*valid), low)
    for alias, kind in aliases.items():
        out = out.when(low == alias, F.lit(kind))
    return out.when(c.rlike(r"^[A-Z]") & c.contains(" "), F.lit(None).cast("string")).otherwise(F.lit(default))


def target_kind(name: Column | str, targets: tuple[tuple[str, str], ...] = TARGETS) -> Column:
    c = col(name)
    out = F.when(c.rlike(targets[0][1]), F.lit(targets[0][0]))
    for kind, pattern in targets[1:]:
        out = out.when(c.rlike(pattern), F.lit(kind))
    return out.when(~c.rlike(CORPORATE), F.lit("individual")).otherwise(F.lit("other"))


def is_shell(*parties: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(col(p).rlike("(?i)" + SHELL), F.lit(False)) for p in parties])


def serial_id(text: Column | str, prefix: str, digits: int = 8) -> Column:
    """A serial number such as ABCD00001234; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(col(text), r"\.[A-Za-z0-9]+$", ""), rf"({prefix}\d{{{digits}}})", 1), F.lit(""))


def chunk_flags(text: Column | str) -> dict[str, Column]:
    c = F.coalesce(col(text), F.lit(""))
    return {"has_email_headers": c.rlike(EMAIL_HEADERS), "has_financial_amounts": c.rlike(AMOUNTS), "has_redaction_markers": c.rlike(REDACTIONS), "has_date_references": c.rlike(DATES)}


def redaction_gate(text: Column | str) -> Column:
    c = col(text)
    return c.contains("[REDACTED]") | c.contains("[REDACT")


def count_matches(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns a text matches."""
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns])


# Patterns whose matches vote for a kind of document, and words of file names that agree with it.
KIND_PATTERNS = {
    "flight_log": (r"(?i)\b(tail\s*#|N\d{3,5}[A-Z]{0,2})\b", r"(?i)\bpassenger\s+manifest\b", r"(?i)\bflight\s+log\b", r"(?i)\b(departure|arrival)\s+(time|date|airport)\b", r"(?i)\b(pilot|co-?pilot|captain)\b"),
    "deposition": (r"\bQ\.\s+", r"\bA\.\s+", r"(?i)\bDEPOSITION\b", r"(?i)\bsworn\s+testimony\b", r"(?i)\b(direct|cross)\s+examination\b"),
    "grand_jury_testimony": (r"(?i)\bGRAND\s+JURY\b", r"\bQ\.\s+", r"\bA\.\s+", r"(?i)\bsworn\b", r"(?i)\bforeperson\b"),
    "subpoena": (r"(?i)\bSUBPOENA\b", r"(?i)\bRIDER\s*\(Grand\s+Jury\b", r"(?i)\byou\s+are\s+(hereby\s+)?commanded\b", r"(?i)\bduces\s+tecum\b"),
    "financial_record": (r"(?i)\bWIRE\s+TRANSFER\b", r"(?i)\bACCOUNT\s+STATEMENT\b", r"(?i)\binvoice\s+#", r"(?i)\bbank\s+statement\b", r"(?i)\b(debit|credit)\s+balance\b"),
    "phone_record": (r"(?i)\bCALL\s+LOG\b", r"\bCDR\b", r"(?i)\bphone\s+record\b", r"(?i)\b(incoming|outgoing)\s+(call|number)\b", r"(?i)\bcall\s+detail\s+record\b"),
    "address_book": (r"(?i)\baddress\s+book\b", r"(?i)\bcontact\s+list\b", r"(?i)\bphone\s+directory\b", r"(?i)\brolodex\b"),
    "email": (r"(?i)\bFrom:\s+\S+@\S+", r"(?i)\bTo:\s+\S+@\S+", r"(?i)\bSubject:\s+", r"(?i)\bSent:\s+", r"(?i)\bDate:\s+.*\d{4}"),
    "fbi_report": (r"\bFBI\b", r"(?i)\bFD-?302\b", r"(?i)\bFederal\s+Bureau\s+of\s+Investigation\b", r"(?i)\bspecial\s+agent\b"),
    "indictment": (r"(?i)\bINDICTMENT\b", r"(?i)\bCOUNT\s+(ONE|TWO|THREE|[IVX]+|\d+)\b", r"(?i)\bthe\s+grand\s+jury\s+charges\b", r"(?i)\bin\s+violation\s+of\b"),
}
KIND_FILES = {
    "flight_log": "flight|manifest", "deposition": "depo|deposition", "subpoena": "subpoena|rider", "financial_record": "bank|wire|financial|invoice",
    "phone_record": "phone|call|cdr", "address_book": "address|contact|black.?book", "email": "email", "fbi_report": "fbi|302", "indictment": "indictment", "grand_jury_testimony": "grand.?jury",
}


def classify_by_rules(text: Column | str, file: Column | str, patterns: dict = KIND_PATTERNS, files: dict = KIND_FILES, least: int = 3) -> Column:
    """(kind, confidence, tags, matches) if `least` patterns of the best kind match and the file's name agrees, else null. Ties go to the kind that is listed first."""
    sample = head_tail(F.coalesce(col(text), F.lit("")), 5000, 4000, 1000, joint="")
    votes = F.array(*[F.struct(count_matches(sample, list(p)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, p) in enumerate(patterns.items())])
    ranked = F.reverse(F.array_sort(F.filter(votes, lambda v: v["n"] >= least)))
    best = F.get(ranked, F.lit(0))
    name = F.lower(F.coalesce(col(file), F.lit("")))
    agrees = reduce(lambda a, kf: a | ((best["k"] == kf[0]) & name.rlike(kf[1])), files.items(), F.lit(False))
    found = F.struct(best["k"].alias("kind"), F.lit(0.9).alias("confidence"), F.transform(F.slice(ranked, 2, len(patterns)), lambda v: v["k"]).alias("tags"), best["n"].alias("matches"))
    return F.when(best.isNotNull() & agrees, found)


def rolling_hash(text: Column | str) -> Column:
    """31 times the hash so far plus the character's code, in 32 bits; its absolute value."""
    step = lambda h, x: (h * 31 + F.ascii(x)).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.aggregate(F.split(col(text), ""), F.lit(0).cast("long"), step)
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))
