"""Every registered query against its SQL on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return tuple(map(_plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query(spark, database, name):
    result = entry_point.queries()[name](spark, SF_DIR)
    rows = result.collect()
    assert rows
    answer = database.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(result.columns)
    order = [columns.index(c) for c in result.columns]
    expected = sorted((tuple(_plain(r[i]) for i in order) for r in answer.fetchall()), key=repr)
    assert sorted((tuple(map(_plain, r)) for r in rows), key=repr) == expected


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10
