"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodegraph.plans import registry

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = sorted(repr(tuple(norm(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name not in registry.oracle_sql():
        return
    found = duck.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in found.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in sorted(cols)]
    assert got == sorted(repr(tuple(norm(r[i]) for i in at)) for r in found.fetchall())
