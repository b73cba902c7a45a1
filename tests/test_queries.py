import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from latticework import queries as spatial

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows, columns):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(spatial.SQL))
def test_equals_sql(spark, sf, db, name):
    df = spatial.QUERIES[name](spark, sf)
    cursor = db.execute(spatial.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = plain(cursor.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns) and plain(df.collect(), df.columns) == want and want


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
