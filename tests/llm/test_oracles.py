"""The queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from labelforge.llm import oracles, queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    cur = con.execute(oracles.ORACLES[name])
    names = [c[0] for c in cur.description]
    df = queries.QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
