"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cohortlens.plans.catalog import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{FOLDER}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    duck.execute(ORACLE[name])
    have = [d[0] for d in duck.description]
    assert sorted(have) == cols
    assert got == sorted((tuple(plain(r[have.index(c)]) for c in cols) for r in duck.fetchall()), key=repr)
