"""Every registered query with SQL gives the rows of that SQL."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lemmaflow.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    key = lambda r: [(v is None, str(v)) for v in r]
    rows = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=key)
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert rows == sorted(([plain(v[names.index(c)]) for c in cols] for v in found.fetchall()), key=key)
