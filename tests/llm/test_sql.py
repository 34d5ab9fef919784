"""Queries that SQL can express, against their SQL."""

import duckdb
import pytest
from conftest import rows

from batchwright.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES[name](spark, sf)
    relation = con.execute(ORACLES[name])
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.select(*columns)) == sorted(relation.fetchall(), key=repr)
