"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from paritas import catalog

duckdb = pytest.importorskip("duckdb")
SF = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def shown(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6))) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == names
    want = sorted(tuple(shown(r[theirs.index(c)]) for c in names) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
