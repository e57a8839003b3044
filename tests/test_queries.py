"""Every query with SQL equals DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from corvane import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    got = catalogue.queries()[name](spark, sf_dir)
    told = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(repr(tuple(r)) for r in told.fetchall())


def test_every_query_has_a_name_of_its_own():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry_imports():
    import __spark_entry__

    assert "q01_parent_expansion_merged" in __spark_entry__.queries()
