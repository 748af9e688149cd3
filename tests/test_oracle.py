"""Every core query with SQL, on the smallest tables, against DuckDB."""

import math
import os

import pytest

from weirstone.queries import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v, ".9g")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if type(v).__name__ == "Decimal":
        return format(float(v), ".9g")
    return str(v)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in "documents events kb inbox sites std_index mix_targets".split():
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(tuple(norm(x[i]) for i in order) for x in r.fetchall())
