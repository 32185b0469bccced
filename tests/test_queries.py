"""Every query of the catalog against its SQL, on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    return "~" if v is None else repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rel = duck.sql(catalog.ORACLE[name])
    columns, rows = rel.columns, rel.fetchall()
    assert sorted(df.columns) == sorted(columns)
    at = [columns.index(c) for c in sorted(columns)]
    expected = sorted(tuple(cell(r[i]) for i in at) for r in rows)
    assert sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_scan_is_pruned(spark, sf_dir):
    plan = catalog.QUERIES["anti_join"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan
