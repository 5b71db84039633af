"""Literal vectors: names, junk, dates, citations, parameters."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions import text as T
from millrace.operators import paging, stages


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_names(spark):
    raw = ["Mr. John Smith", "Jane Doe, Ph.D.", "O'Brien, John", "Gen. A Smith", '"A Smith"', "A Smith (aka B)", "", "  ", None]
    assert each(spark, raw, T.normalize_name) == ["john smith", "jane doe", "john o'brien", "a smith", "a smith", "a smith", None, None, None]


def test_junk(spark):
    junk = ["", "A", "Monday", "Plaintiff", "2024", "01/15/2023", "John Doe", "N/A", "Arial", "LLC", "john doe #4"]
    fine = ["Deutsche Bank", "Palm Beach", "N908JE"]
    assert each(spark, junk + fine, T.is_junk) == [True] * len(junk) + [False] * len(fine)


def test_dates(spark):
    raw = ["2003-04-15", "04/15/2003", "4/15/03", "1/1/50", "1/1/51", "Apr 15, 2003", "April 15 2003", "2003", "", "not a date", "April 2003", "2/31/2003"]
    d = datetime.date
    assert each(spark, raw, dates.parse_date) == [d(2003, 4, 15)] * 3 + [d(2050, 1, 1), d(1951, 1, 1), d(2003, 4, 15), d(2003, 4, 15), d(2003, 1, 1), None, None, None, None]
    assert each(spark, ["2003", "Jan 2003", "circa 2003", "~2003", "2003?", "2003-04-15", "April 15, 2003"], dates.date_precision) == ["year", "month", "approximate", "approximate", "approximate", "exact", "day"]


def test_citations(spark):
    pages = spark.createDataFrame([(1, 5), (2, 0), (3, None)], "i int, p int")
    assert [r.c for r in pages.select("i", T.citation(F.lit("f.pdf"), "p").alias("c")).orderBy("i").collect()] == ["[f.pdf, Page 5]", "[f.pdf]", "[f.pdf]"]
    assert [(x.file, x.page) for x in each(spark, ["see [report.pdf, Page 42] and [b]"], T.parse_citations)[0]] == [("report.pdf", 42), ("b", None)]


def test_trigram_similarity(spark):
    assert each(spark, ["word"], lambda c: T.similarity(c, F.lit("two words"))) == [pytest.approx(4 / 11)]


def test_parameters():
    assert paging.coerce({"page": "3", "per_page": "x", "own": "true", "id": "7"}) == {"page": 3, "per_page": "x", "own": True, "id": "7"}
    for bad in ({"page": 0}, {"per_page": 101}):
        with pytest.raises(ValueError):
            paging.Page(**bad)
    with pytest.raises(ValueError):
        paging.Bounds(depth=5)


def test_stage_order():
    order = stages.ordered()
    assert len(order) == 19 and all(order.index(d) < order.index(s) for s, (needs, _) in stages.STAGES.items() for d in needs)
    with pytest.raises(ValueError):
        stages.ordered({"a": (("b",), 0.0), "b": (("a",), 0.0)})
