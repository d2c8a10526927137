"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import pytest

from loomline.plans import catalog

CORE = catalog.load()
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_same_rows(spark, duck, small, name):
    df = CORE.queries[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(CORE.sql[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_gives_rows(spark, small, name):
    assert CORE.queries[name](spark, small).count() > 0
