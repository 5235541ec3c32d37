"""Queries against their SQL on small made tables that hold what the given ones lack."""

import duckdb

from cohortlens.plans.catalog import ORACLE, QUERIES


def compared(spark, folder, name, tables):
    """Rows of the query and of its SQL over the frames in ``tables``, in order."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create or replace view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    return sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(folder)).select(*columns).collect()), want


LINEITEM = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def test_measures_halfway_between_whole_numbers(spark, tmp_path):
    prices = (40500.0, 41500.0, 42500.0, 80500.0, 81500.0, 40499.99, None)
    rows = [(i, 1, 1, 1, q, p, 0.01, 0.0, "N", "O", None) for i, (p, q) in enumerate((p, q) for p in prices for q in (30.0, 30.5, 45.5, 46.5, None))]
    got, want = compared(spark, tmp_path, "classic_findings", {"lineitem": spark.createDataFrame(rows, LINEITEM)})
    assert got == want and got
