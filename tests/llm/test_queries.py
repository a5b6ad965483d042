"""The numbered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lectern.llm import queries
from tests.test_queries import SF, TABLES, rows


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())
