"""Every query of the library, except those of the text subpackage, against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from filingscope.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 4)
    return str(v)[:19].replace(" 00:00:00", "")


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(cell, r)) for r in df[cols].itertuples(index=False, name=None)), key=lambda r: tuple(map(str, r)))


def test_searches_over_all_rows_are_registered(duck):
    asked = {r[0] for r in duck.sql("select vec_id from embeddings where vec_id % 100 = 0").fetchall()}
    assert {r[0] for r in duck.sql(f"select query_id from ({ORACLES['vector_top_k_all']})").fetchall()} == asked and len(asked) > 1
    assert "< 50" not in ORACLES["filings_search_all"] and {"vector_top_k_all", "filings_search_all"} <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(got.columns)
