"""The registered queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    told = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == sorted(df.columns)
    assert {x[0]: str(x[1]) for x in told.description} == {c: KINDS[k] for c, k in df.dtypes}
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, told.fetchall()))
