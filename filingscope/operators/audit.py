"""The radar's report as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.operators.radar import Radar


def audit_export_tables(radar: Radar, sector_map: list[tuple[str, str]], institution_category: str, rows: int = 1000) -> dict[str, DataFrame]:
    """One table per sheet of an audit report, each with at most `rows` rows (a report's limit), the first in its order."""
    spark = radar.filings.sparkSession
    notes = [("current quarter", radar.current), ("previous quarter", radar.previous), ("values", "estimated per row: at most 4 a share counts as thousands"), ("matching", "an alias of four letters or more is part of the issuer's name")]
    moves = radar.top_filer_moves(rows)
    tables = {
        "Read Me": spark.createDataFrame(notes, "topic string, note string"), "Coverage": radar.radar_coverage(), "Category Trends": radar.category_summary(),
        "Security Movements": radar.top_security_movements(rows), "Sector Movers": radar.sector_movers(sector_map), "Filer Type Trends": radar.filer_type_summary(),
        "Private Credit Institutions": radar.institution_category_summary(institution_category),
        "Top Filer Move Details": moves.select("cik", "fund_name", "category", F.explode("details").alias("d")).select("cik", "fund_name", "category", "d.*"),
        "Filer Security Audit": radar.audit_rows(), "Raw Current": radar.raw_matched_holdings().filter("period = 'current'"), "Raw Previous": radar.raw_matched_holdings().filter("period = 'previous'"),
    }
    #: The sheets whose radar outputs have no order of their own.
    orders = {
        "Category Trends": ["category"], "Sector Movers": ["sector"], "Filer Type Trends": ["filer_type", "category"], "Private Credit Institutions": ["cik"], "Top Filer Move Details": ["cik", "category", "item_key", "label"],
        "Filer Security Audit": ["cik", "category", "security"], "Raw Current": ["row_id"], "Raw Previous": ["row_id"],
    }
    return {name: (t.orderBy(*orders[name]) if name in orders else t).limit(rows) for name, t in tables.items()}
