"""Every query with a counterpart in SQL gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(rows):
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted(repr(tuple(clean(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    if name not in catalogue.oracle_sql():
        assert len(got) > 0
        return
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert plain(got) == plain([[r[names.index(c)] for c in columns] for r in want.fetchall()])


def test_the_rest_works_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries()) and set(catalogue.oracle_sql()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
