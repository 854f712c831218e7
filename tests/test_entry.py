"""Every registered query against its SQL on the smallest sample tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, base, name):
    frame = contract.queries()[name](spark, FOLDER)
    got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    assert got
    if name in contract.oracle_sql():
        result = base.execute(contract.oracle_sql()[name])
        columns = [item[0] for item in result.description]
        assert sorted(frame.columns) == sorted(columns)
        assert got == rows_of(columns, result.fetchall())
