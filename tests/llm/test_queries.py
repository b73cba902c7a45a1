import os

import duckdb
import pytest

from latticework.llm import queries

from ..test_queries import TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = queries.queries()[name](spark, sf)
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = plain(cursor.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns) and plain(df.collect(), df.columns) == want and want


def test_reruns_agree(spark, sf):
    for name in ("op2_mixing", "op4_pii", "op8_language_id"):
        one, two = (sorted(map(str, queries.queries()[name](spark, sf).collect())) for _ in range(2))
        assert one == two
