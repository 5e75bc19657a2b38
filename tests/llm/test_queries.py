import os

import pytest

from sketchloom.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    got = registry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    key = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == columns and key(got) == key(want)
