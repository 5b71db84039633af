"""Fields of web pages by pattern, in column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import col

# Fixed value: the call that carries a page's payload.
PUSH = r'self\.__next_f\.push\(\[1,"((?:[^"\\]|\\.)*)"\]\)'


def payloads(html: Column | str) -> Column:
    """The strings that payload calls carry, still escaped."""
    return F.regexp_extract_all(col(html), F.lit(PUSH), F.lit(1))


def unescape(escaped: Column) -> Column:
    """A JSON string's escapes resolved; a bad one stays as it is."""
    import json

    def one(x):
        try:
            return None if x is None else json.loads(f'"{x}"')
        except ValueError:
            return x

    def batch(values: pd.Series) -> pd.Series:
        return values.map(one)

    batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "string")(escaped)


def payload_text(df: DataFrame, id_col: str, html: str) -> DataFrame:
    joined = F.array_join(payloads(html), "")
    return df.select(id_col, unescape(joined).alias("payload"))


def json_ld(html: Column | str) -> Column:
    """JSON-LD scripts that parse, as text."""
    found = F.regexp_extract_all(col(html), F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.try_parse_json(x).isNotNull())


def title(html: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def paragraphs(html: Column | str) -> Column:
    """Texts of paragraphs without tags."""
    raw = F.regexp_extract_all(col(html), F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(raw, lambda p: F.trim(F.regexp_replace(p, r"<[^>]+>", ""))), lambda p: p != "")


def main_text(html: Column | str, least: int = 40) -> Column:
    """The longest paragraph of `least` characters that isn't style; of several the first."""
    fit = F.filter(paragraphs(html), lambda p: (F.length(p) >= least) & ~p.rlike(r"\{[^}]*:[^}]*\}"))
    best = F.aggregate(fit, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    return F.nullif(best, F.lit(""))


@dataclass(frozen=True)
class Format:
    """How records of one kind stand in payloads: marks that a payload has, where a card starts (None: a payload is one card), the fields by pattern, those of which one must be there."""

    marks: tuple[str, ...]
    card: str | None
    fields: dict[str, str]
    needs: tuple[str, ...]
    numbers: tuple[str, ...] = ()
    least: int = 0


# The marks of a page's components.
DAY = r'((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s*\d{4})"'
CARD = r'\$L\w+","[0-9a-f]{8}-'
PLACES = "Residence|Property|Office|Room|Island|Mansion|Apartment|Ranch|Palm Beach|New York|Manhattan|Virgin|Little St"
FORMATS = {
    "order": Format(
        ("AMZ-",), None,
        {
            "id": r'"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"', "date": r'font-mono text-sm","children":"' + DAY, "item": r'font-medium line-clamp-2","children":"([^"]+)"',
            "order_number": r"(AMZ-\d{4}-\d{4}-\d{3})", "category": r'secondary/90 text-xs","children":"([^"]+)"', "quantity": r'text-center","children":(\d+)',
            "price": r'text-right font-mono text-sm","children":"\$(\$[^"]+)"', "detail_url": r'"href":"(/orders/[^"]+)"',
        },
        ("id", "item"), ("quantity",),
    ),
    "photo": Format(
        ("supabase.co/storage", "/photos/"), CARD,
        {
            "image_url": r'"src":"(https://[^"]*supabase\.co/storage/v1/object/public/photos/[^"]+)"', "title": r'"alt":"([^"]+)"', "detail_url": r'"href":"(/photos/[^"]+)"',
            "location": rf'(?i)"children":"([^"]*(?:{PLACES})[^"]*)"', "source": r'outline","children":"([^"]+)"',
        },
        ("image_url",),
    ),
    "name": Format(
        ("/names/",), r'\["\\?\$","\\?\$L',
        {"profile_url": r'"href":"(/names/[^"]+)"', "name": r'(?:semibold|font-medium)[^"]*","children":"([^"]+)"', "role": r'text-muted-foreground[^"]*","children":"([^"]{10,})"'},
        ("profile_url", "name"),
    ),
    "email": Format(
        ("/emails/", "email"), CARD,
        {
            "detail_url": r'"href":"(/emails/[^"]+)"', "date": r'"children":"' + DAY, "from": r'(?:From|Sender)[^"]*"children":"([^"]+)"', "to": r'(?:To|Recipient)[^"]*"children":"([^"]+)"',
            "subject": r'"font-medium[^"]*","children":"([^"]{5,})"',
        },
        (), (), 100,
    ),
}
#: A name's counts, in the order in which its card has them.
COUNTS = ("document_count", "flight_count", "email_count")


def payload_chunks(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id_col, chunk): a row for each payload call of a page, its escapes resolved."""
    return df.select(id_col, F.explode(payloads(html)).alias("_raw")).select(id_col, unescape(F.col("_raw")).alias("chunk"))


def cards(payload: Column | str, start: str) -> Column:
    """A payload cut before each place where a card starts; what comes before the first is a piece of its own."""
    return F.filter(F.split(col(payload), f"(?={start})"), lambda x: x != "")


def records(chunks: DataFrame, id_col: str, kind: str) -> DataFrame:
    """(id_col, the kind's fields): a row for each card that has what its kind needs. Cards are cut and read where the chunk is."""
    f = FORMATS[kind]
    marked = F.lit(False)
    for mark in f.marks:
        marked = marked | F.contains(F.lower("chunk") if kind == "email" else F.col("chunk"), F.lit(mark))
    whole = chunks.where(marked)
    each = whole.select(id_col, F.explode(cards("chunk", f.card)).alias("card")) if f.card else whole.select(id_col, F.col("chunk").alias("card"))
    field = lambda p: F.nullif(F.regexp_extract("card", p, 1), F.lit(""))
    out = {k: field(p).cast("int") if k in f.numbers else field(p) for k, p in f.fields.items()}
    if kind == "name":
        found = F.regexp_extract_all("card", F.lit(r'"children":(\d+)'), F.lit(1))
        out |= {c: F.get(found, F.lit(k)).cast("int") for k, c in enumerate(COUNTS)}
    if kind == "email":
        texts = F.regexp_extract_all("card", F.lit(r'"children":"([^"]{30,})"'), F.lit(1))
        out["preview"] = F.nullif(F.aggregate(texts, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)), F.lit(""))
    kept = each.where(F.length("card") >= f.least).select(id_col, *[v.alias(k) for k, v in out.items()])
    if kind == "email":
        return kept.where("detail_url IS NOT NULL OR subject IS NOT NULL")
    for need in f.needs:
        kept = kept.where(F.col(need).isNotNull())
    return kept


def pattern_audit(df: DataFrame, id_col: str, text: str, patterns: dict[str, str], examples: int = 3, around: int = 2) -> DataFrame:
    """(pattern, n, examples): lines that match each pattern, and the first examples with the lines around them.

    Each text is searched where it is, and leaves a count and its own first examples for each pattern that it matches; no line travels with its text.
    """
    lines = F.split(text, "\n")

    def audited(name: str, pattern: str) -> Column:
        hits = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(pattern), i)), lambda i: i.isNotNull())
        context = lambda i: F.struct(i.alias("at"), F.array_join(F.slice(lines, F.greatest(i - around, F.lit(0)) + 1, i + around + 1 - F.greatest(i - around, F.lit(0))), "\n").alias("context"))
        return F.struct(F.lit(name).alias("pattern"), F.size(hits).cast("long").alias("n"), F.transform(F.slice(hits, 1, examples), context).alias("first"))

    each = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(*[audited(k, p) for k, p in patterns.items()])).alias("h")).select("id", "h.*").where("n > 0")
    counts = each.groupBy("pattern").agg(F.sum("n").alias("n"))
    shown = each.select("pattern", "id", F.explode("first").alias("x")).select("pattern", "id", "x.*")
    top = shown.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy("id", "at"))).where(F.col("r") <= examples)  # few rows leave each task
    listed = top.groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "context"))), lambda x: x["context"]).alias("examples"))
    return counts.join(listed, "pattern")
