"""Every registered lecture query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lectern.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted([repr([plain(r[i]) for i in order]) for r in data])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in queries.SQL:
        cur = duck.execute(queries.SQL[name])
        assert got == rows([d[0] for d in cur.description], cur.fetchall())
    else:
        assert got
