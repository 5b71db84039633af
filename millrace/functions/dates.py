"""Dates as archives write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import MONTHS, col

_SHORT = "|".join((*MONTHS, *(m[:3] for m in MONTHS)))
#: Formats that are tried in order; month before day.
FORMATS = ("M/d/yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d/M/yyyy", "yyyy/M/d")


def pivot_year(two: Column) -> Column:
    """51 to 99 are 19yy, 0 to 50 are 20yy; larger numbers stay."""
    return F.when(two >= 100, two).when(two > 50, two + 1900).otherwise(two + 2000)


def day_of(year: Column, month: Column, day: Column) -> Column:
    return F.expr("null").cast("date") if year is None else F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def parse_date(text: Column | str) -> Column:
    """ISO prefix, m/d/y with pivot, Month d, yyyy, or a year; else null. A day that its month doesn't have is null."""
    c = F.trim(col(text))
    number = lambda pattern, k: F.try_to_number(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")), F.lit("9999")).cast("int")
    iso, us, written = r"^(\d{4}-\d{2}-\d{2})", r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$", rf"(?i)^({_SHORT})\s+(\d{{1,2}}),?\s+(\d{{4}})$"
    month = F.initcap(F.substring(F.regexp_extract(c, written, 1), 1, 3))
    spelled = F.concat_ws(" ", month, number(written, 2).cast("string"), F.regexp_extract(c, written, 3))
    return (
        F.when(c.rlike(iso), F.try_to_date(F.regexp_extract(c, iso, 1), "yyyy-MM-dd"))
        .when(c.rlike(us), day_of(pivot_year(number(us, 3)), number(us, 1), number(us, 2)))
        .when(c.rlike(written), F.try_to_date(spelled, "MMM d yyyy"))
        .when(c.rlike(r"^\d{4}$"), F.try_to_date(F.concat(c, F.lit("-01-01")), "yyyy-MM-dd"))
    )


def date_precision(text: Column | str) -> Column:
    c = F.trim(col(text))
    return (
        F.when(c.rlike(r"^\d{4}$"), "year")
        .when(c.rlike(rf"(?i)^({_SHORT})\s+\d{{4}}$"), "month")
        .when(c.rlike(r"(?i)circa|approx|around|about|~|\?"), "approximate")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), "exact")
        .otherwise("day")
    )


def display_date(date: Column | str, precision: Column | None = None) -> Column:
    d = col(date).cast("date")
    p = F.lit("day") if precision is None else F.coalesce(precision, F.lit("day"))
    year = F.date_format(d, "y")
    return (
        F.when(d.isNull(), "Unknown date")
        .when(p == "year", year)
        .when(p == "month", F.date_format(d, "MMMM y"))
        .when(p == "approximate", F.concat(F.lit("c. "), year))
        .otherwise(F.date_format(d, "MMMM d, y"))
    )


def date_range(first: Column | str, last: Column | str) -> Column:
    a, b = col(first), col(last)
    return (
        F.when(a.isNull() & b.isNull(), "Unknown period")
        .when(b.isNull(), F.concat(display_date(a), F.lit(" -- present")))
        .when(a.isNull(), F.concat(F.lit("Until "), display_date(b)))
        .otherwise(F.concat(display_date(a), F.lit(" -- "), display_date(b)))
    )


def normalize_date(text: Column | str) -> Column:
    """ISO text of a date in one of FORMATS; of a time stamp its date; anything else as it is."""
    c = F.trim(col(text))
    tried = F.coalesce(*[F.date_format(F.try_to_date(c, f), "yyyy-MM-dd") for f in FORMATS])
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.substring(c, 1, 10)).otherwise(F.coalesce(tried, c))


def within_days(date: Column | str, target: Column, days: int) -> Column:
    return col(date).cast("date").between(F.date_sub(target.cast("date"), days), F.date_add(target.cast("date"), days))
