"""Every query of the library against its SQL twin, over the same tables."""

import glob
import os

import duckdb
import pytest

from geofeat.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(row):
    return tuple(repr(float(v)) if isinstance(v, float) else "" if v is None else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.oracle_sql()[name]}) x").fetchall()
    assert sorted(map(plain, got.select(*columns).collect())) == sorted(map(plain, expected))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).limit(1).count() == 1
