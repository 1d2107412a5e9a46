"""All queries of the library by name, and their DuckDB SQL."""

from __future__ import annotations

from functools import wraps

from filingscope import ship
from filingscope.plans import portfolio_queries, radar_queries, scalar_queries, source_queries, store_queries, stream_queries, table_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}


def shipped(query):
    """A query whose Python parts find this package on the executors."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


for module in (radar_queries, scalar_queries, portfolio_queries, table_queries, text_queries, source_queries, store_queries, stream_queries):
    QUERIES |= {name: shipped(f) for name, f in module.QUERIES.items()}
    ORACLES |= module.ORACLES
