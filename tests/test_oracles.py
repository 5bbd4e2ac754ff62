"""Every registered query against its SQL counterpart in DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from tools.check import difference
from voxfield.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_equals_sql(spark, sf_dir, con, name):
    note, _ = difference(QUERIES[name](spark, sf_dir), ORACLES[name], con)
    assert note == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
