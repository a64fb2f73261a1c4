"""Every named query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from loresift.registry.oracle import ORACLE
from loresift.registry.queries import QUERIES
from tools.check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_only_text_output_lacks_sql():
    assert set(QUERIES) - set(ORACLE) == {"hits_json"}
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert {"query_id", "rank", "score"} <= set(contract.entry(spark).columns)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, FOLDER)
    mine = rows(frame.columns, frame.collect())
    if name not in contract.oracle_sql():
        assert mine
    else:
        cursor = duck.execute(contract.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(frame.columns)
        assert mine == rows(columns, cursor.fetchall())
