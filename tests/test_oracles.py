"""Every query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import math

import duckdb
import pytest

from hitweave import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    if name not in registry.ORACLES:
        assert got
        return
    found = db.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got == want
