"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewell.plans import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return None if v is None else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
