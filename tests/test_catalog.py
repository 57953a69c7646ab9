"""Every core query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

from docketry.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def _rows(columns, rows):
    names = sorted(columns)
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[columns.index(n)] for n in names))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.oracle_sql():
        rel = db.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in rel.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == _rows(columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
