"""Each query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from colophon.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    return round(v, 9) if isinstance(v, float) else int(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.select(*columns).collect())
    if name not in registry.ORACLES:
        assert rows
        return
    got = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in got.fetchall())
