"""Every query of the catalogue against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

from lakeweave.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            c.sql(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in data)


def test_every_query_has_its_twin():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("n", [0, 1, 10_000_000])
def test_compaction_is_due_at_any_size(spark, tmp_path, n):
    """Ten million rows that don't compress are over 8 MB in each of 16 files; no row makes one file."""
    lines = spark.range(n).selectExpr("xxhash64(id) l_orderkey", "pmod(xxhash64(id, 1), 1000000000) / 100.0d l_extendedprice")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalogue.queries()["compaction_preserves_rows"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.sql(catalogue.oracle_sql()["compaction_preserves_rows"])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
