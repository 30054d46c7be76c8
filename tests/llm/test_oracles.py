"""The corpus queries that have SQL give the rows of that SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import Row

from lemmaflow.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    rows = lambda xs, cols: sorted(tuple(str(x[cols.index(c)]) for c in sorted(names)) for x in xs)
    assert rows(df.collect(), df.columns) == rows(found.fetchall(), names)


def test_bad_hosts_by_sql(spark, tmp_path):
    """Hosts that are bad and hosts of one document, by the same SQL; the host's verdict must flip rows."""
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{clean} {i}", f"good{i % 9}") for i in range(270)] + [(300 + i, "## # " * 20 + clean if i % 5 else clean, f"bad{i % 2}") for i in range(80)] + [(400, "# " * 60, "lone"), (401, clean, None), (402, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(oracle_sql()["op10_quality_rules"])
    names = [c[0] for c in found.description]
    df = queries()["op10_quality_rules"](spark, str(tmp_path)).select(*names)
    assert sorted(map(str, df.collect())) == sorted(map(str, [Row(**dict(zip(names, x, strict=True))) for x in found.fetchall()]))
    flipped = {r["doc_id"] for r in df.where("not base_failed and not kept").collect()}
    assert {300 + i for i in range(80)} <= flipped and not flipped & set(range(270))
