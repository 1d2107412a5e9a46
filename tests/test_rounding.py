"""Doubles are rounded as in SQL."""

import duckdb

from filingscope.plans.registry import ORACLES, QUERIES

#: Shares; with 8 shares before (line 4) some changes stand between two sixth decimals, others are too large for any.
ODD = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 8.0, 7.9999999999, 1.0005158, 1.000523, 0.99990116, 1e-320, 1.4641398578071726e107, 1.6881424588710656e269, -1e308]


def test_share_changes_equal_their_sql(spark, tmp_path):
    rows = [(k, n, 1, x) for k, x in enumerate(ODD) for n in (1, 3, 4, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(ORACLES["share_pct_change"]).fetchall()
    got = QUERIES["share_pct_change"](spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want)) and len(got) == len(rows)
