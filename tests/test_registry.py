"""Every query runs on the smallest tables, and those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pytest

from palimpsest.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def canon(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        assert mine == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())
