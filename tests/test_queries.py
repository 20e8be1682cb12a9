"""Every registered query against its SQL in DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import pytest

from faultline.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 9)
    return value.isoformat() if isinstance(value, datetime.datetime) else str(value)


def _bag(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    named = [c[0] for c in result.description]
    assert sorted(named) == columns
    places = [named.index(c) for c in columns]
    want = [[row[i] for i in places] for row in result.fetchall()]
    assert _bag(df.select(*columns).collect()) == _bag(want)
