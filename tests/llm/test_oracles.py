"""The queries that SQL can express, against it."""

import duckdb
import pytest

from check import TABLES, compare
from shelfmart.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(spark, small, name):
    duck = duckdb.connect()
    for table in TABLES.split():
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    assert compare(spark, duck, small, name, QUERIES[name], ORACLES[name])[1] == "ok"


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
