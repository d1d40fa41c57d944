"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest
from tessera import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = duck.sql(registry.oracle_sql()[name])
    order = [rel.columns.index(c) for c in cols]
    key = lambda r: repr([x for x in r if not isinstance(x, float)]) + repr([round(x, 4) + 0.0 for x in r if isinstance(x, float)])
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))
