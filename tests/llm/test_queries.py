"""The corpus queries against their DuckDB counterparts on the smallest tables."""

import os

import duckdb
import pytest

from quirelake.llm import queries
from tests.conftest import SF
from tests.test_queries import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_corpus_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"create view {table.split('.')[0]} as select * from '{SF}/{table}'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())


def test_every_dealt_operator_has_one_query():
    dealt = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in dealt) == list(range(1, 14)) and "pipeline" in queries.QUERIES
