"""Every registered query of the toolkit against its SQL in DuckDB, on the smallest tables, and entry points."""

import math

import pytest

import __spark_entry__
from tessera import catalog

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple("null" if v is None or isinstance(v, float) and math.isnan(v) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    told = db.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == cols
    assert {x[0]: str(x[1]) for x in told.description} == {c: KINDS[k] for c, k in df.dtypes}
    want = [tuple(r[names.index(c)] for c in cols) for r in told.fetchall()]
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["conv_id", "instruction", "response"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["md5_shuffle_rank", "train_val_split", "preference_order", "proportion_fit", "kto_pack", "positional_join", "spearman"])
def test_partitioning_does_not_matter(spark, name, monkeypatch):
    """One and seven input partitions give the same rows."""
    read = catalog.table
    results = []
    for n in (1, 7):
        from tessera.plans import queries_rows, queries_stats

        for module in (queries_rows, queries_stats):
            monkeypatch.setattr(module, "table", lambda s, d, t, n=n: read(s, d, t).repartition(n))
        results.append(plain(tuple(r) for r in catalog.queries()[name](spark, DATA).collect()))
    assert results[0] == results[1]
