import os

import pytest

SF = "/root/testdata/sf0.001"


def test_names_and_sql_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def _names():
    from sketchloom import registry

    return sorted(registry.oracle_sql())


def test_every_query_has_sql():
    from sketchloom import registry

    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", _names())
def test_queries_against_sql(spark, duck, name):
    from sketchloom import registry

    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    key = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == columns and key(got) == key(want)
