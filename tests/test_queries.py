"""Queries against DuckDB on the smallest tables, and the entry points."""

import math
import os

import pytest

import __spark_entry__ as entry
from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
#: Parametrised by module, so that a failure names the query and a run stays short.
MODULES = {m: getattr(__import__(f"millrace.plans.{m}", fromlist=["QUERIES"]), "QUERIES") for m in registry.MODULES}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v if isinstance(v, int) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.mark.parametrize("module", list(MODULES))
def test_module(spark, duck, module):
    sql, wrong = entry.oracle_sql(), []
    for name, query in MODULES[module].items():
        df = query(spark, SF)
        got = rows(df.columns, df.collect())
        if name in sql:
            found = duck.execute(sql[name])
            columns = [d[0] for d in found.description]
            if sorted(columns) != sorted(df.columns) or rows(columns, found.fetchall()) != got:
                wrong.append(name)
    assert not wrong


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def same_as_sql(spark, folder, name, table, rows_):
    """The query's rows over one small table; its SQL gives the same ones."""
    import duckdb

    rows_.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns) and rows(columns, found.fetchall()) == rows(df.columns, df.collect())
    return df.collect()


def test_all_evidence_of_an_edge(spark, tmp_path):
    """An edge of 130 documents keeps every one of them, in two blocks."""
    documents = [*range(1, 121), *range(2_000_000, 2_000_010)]
    lines = spark.createDataFrame([(d, 7, 3, d % 10 / 100) for d in documents * 2] + [(5, 3, 7, 0.5), (5, 1, 1, 0.0)], "l_orderkey long, l_suppkey long, l_partkey long, l_discount double")
    got = [r for r in same_as_sql(spark, tmp_path, "w5_edge_evidence", "lineitem", lines) if (r.a, r.b) == (3, 7)]
    assert sorted(d for r in got for d in r.evidence) == documents and {(r.documents, r.strength) for r in got} == {(130, 0.5)} and len(got) == 2


def test_copies_and_reordered_names_are_linked(spark, tmp_path):
    """Every part's links can be told from the rows: copies stand beside their first id, names of other words or order are pairs."""
    names = ["red blue bolt", "blue red bolt", "red blue bolts", "red blue bolt", "green nut", "red, blue bolt", "red blue bolt", "green nut"]
    parts = spark.createDataFrame([(3 * k, n, "STEEL" if k < 7 else "TIN", "Brand") for k, n in enumerate(names)], "p_partkey long, p_name string, p_type string, p_brand string")
    got = {(r.a, r.b, r.copy): r.similarity for r in same_as_sql(spark, tmp_path, "e1_similar_names", "part", parts)}
    assert {k for k in got if k[2]} == {(0, 9, True), (0, 18, True)} and {k for k, s in got.items() if not k[2] and s == 1} == {(0, 3, False), (0, 15, False), (3, 15, False)}
