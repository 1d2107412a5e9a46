"""The given tables as filings: suppliers file monthly, line items are holdings, parts' words are watched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.functions.columns import quarter_of_date
from filingscope.operators.matching import alias_table
from filingscope.operators.radar import Radar

CURRENT, PREVIOUS = "2001-Q3", "2001-Q2"
WATCHLISTS = {
    "red": [("RDX", "red widget", ["red gizmo", "red bolt"]), ("RDP", "red plate", [])],
    "metal": [("ANVL", "anvil", []), ("BLT", "bolt", ["small bolt"]), ("GEAR", "gear", [])],
    "ring": [("RING", "ring", [])],
    "none": [("ZZZZ", "zeppelin works", [])],
}
SECTORS = [("RED WIDGET", "Information Technology"), ("SMALL GEAR", "Industrials"), ("BLUE", "Energy"), ("GEAR", "Industrials"), ("HOT BOLT", "Materials"), ("PLATE", "Consumer Defensive")]
PATTERNS = [("one", "00001"), ("seven", "7"), ("nobody", "zzz")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def padded(key):
    """Odd keys with leading zeros, so that both forms of a CIK meet."""
    text = key.cast("string")
    return F.when(key % 2 == 1, F.lpad(text, 10, "0")).otherwise(text)


def days_of(first: str, last: str) -> tuple[str, str]:
    """The first day of a quarter and the day after a later one."""
    year, quarter = int(last[:4]), int(last[-1])
    return f"{first[:4]}-{3 * int(first[-1]) - 2:02d}-01", f"{year + quarter // 4}-{3 * (quarter % 4) + 1:02d}-01"


def holdings(spark: SparkSession, sf_dir: str, quarters: tuple[str, str] | None = None) -> DataFrame:
    """Line items as holdings; quarters: from which to which, by the dates that the scan can filter and prune by."""
    item, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    if quarters:
        begin, end = days_of(*quarters)
        item = item.filter((F.col("l_shipdate") >= F.lit(begin).cast(item.schema["l_shipdate"].dataType)) & (F.col("l_shipdate") < F.lit(end).cast(item.schema["l_shipdate"].dataType)))
    rows = item.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    key = F.col("l_suppkey")
    return rows.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"), padded(key).alias("cik"), F.concat_ws("-", key.cast("string"), F.date_format("l_shipdate", "yyyyMM")).alias("accession"),
        quarter_of_date("l_shipdate").alias("quarter"), F.col("p_name").alias("issuer"), F.lit(None).cast("string").alias("cusip"),
        (F.col("l_extendedprice") / F.when(key % 2 == 1, 1000.0).otherwise(1.0)).alias("value"), F.col("l_quantity").alias("shares"), F.when(F.col("l_returnflag") == "R", "Put").alias("putcall"),
        F.to_date("l_shipdate").alias("shipped"), F.col("l_partkey").cast("string").alias("part"),
    )


def cusip_holdings(spark: SparkSession, sf_dir: str, quarters: tuple[str, str] | None = None) -> DataFrame:
    """holdings() in which every third part has a CUSIP, so that equal names are several securities and others are one."""
    part = F.col("part").cast("long")
    return holdings(spark, sf_dir, quarters).withColumn("cusip", F.when(part % 3 == 0, F.concat(F.lit(" c"), F.lpad(part.cast("string"), 8, "0"))))


def funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(padded(F.col("s_suppkey")).alias("cik"), F.col("s_name").alias("fund_name"))


def filings(spark: SparkSession, sf_dir: str, quarters: tuple[str, str] | None = None) -> DataFrame:
    rows = holdings(spark, sf_dir, quarters).groupBy("cik", "accession", "quarter").agg(F.max("shipped").alias("filing_date"))
    return rows.join(funds(spark, sf_dir), "cik", "left")


def radar(spark: SparkSession, sf_dir: str) -> Radar:
    both = (PREVIOUS, CURRENT)
    return Radar(filings(spark, sf_dir, both), cusip_holdings(spark, sf_dir, both), alias_table(spark, WATCHLISTS), CURRENT, PREVIOUS)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


_ALIASES = [(c, f"{c}|{t}|{label.upper().replace(' ', '')}", label, a.upper()) for c, items in WATCHLISTS.items() for t, label, more in items for a in dict.fromkeys([label, t, *more])]

#: The same in DuckDB SQL: common table expressions that the oracles start with.
SQL = f"""
h AS (SELECT l_orderkey * 100 + l_linenumber AS row_id, CAST(l_suppkey AS VARCHAR) AS cik, CAST(l_suppkey AS VARCHAR) || '-' || strftime(l_shipdate, '%Y%m') AS accession,
  CAST(year(l_shipdate) AS VARCHAR) || '-Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS quarter, p_name AS issuer, CASE WHEN l_partkey % 3 = 0 THEN 'C' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') ELSE upper(replace(p_name, ' ', '')) END AS security,
  l_extendedprice / (CASE WHEN l_suppkey % 2 = 1 THEN 1000.0 ELSE 1.0 END) AS value, l_quantity AS shares, CASE WHEN l_returnflag = 'R' THEN 'Put' END AS putcall, CAST(l_shipdate AS DATE) AS shipped, CAST(l_partkey AS VARCHAR) AS part
  FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT g.*, s_name AS fund_name FROM (SELECT cik, accession, quarter, max(shipped) AS filing_date FROM h GROUP BY 1, 2, 3) g LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = cik),
lat AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cik, quarter ORDER BY filing_date DESC, accession DESC) AS rn FROM f) WHERE rn = 1),
comp AS (SELECT a.cik, a.fund_name, a.accession AS current_accession, a.filing_date AS current_date_, b.accession AS previous_accession, b.filing_date AS previous_date_ FROM lat a JOIN lat b ON a.cik = b.cik AND a.quarter = '{CURRENT}' AND b.quarter = '{PREVIOUS}'),
asg AS (SELECT h.*, lat.fund_name, lat.filing_date, CASE WHEN h.quarter = '{CURRENT}' THEN 'current' ELSE 'previous' END AS period,
  CASE WHEN value <= 0 THEN 0 WHEN shares <= 0 THEN value WHEN abs(value / shares) > 4 THEN value ELSE value * 1000 END AS actual
  FROM h JOIN lat USING (cik, quarter, accession) WHERE h.quarter IN ('{CURRENT}', '{PREVIOUS}') AND putcall IS NULL),
al (category, item_key, label, alias) AS (VALUES {_values(_ALIASES)}),
m AS (SELECT DISTINCT issuer, category, item_key, label FROM (SELECT DISTINCT issuer FROM h) i JOIN al ON length(replace(alias, ' ', '')) >= 4 AND (contains(upper(issuer), alias) OR contains(upper(replace(issuer, ' ', '')), replace(alias, ' ', '')))),
mc AS (SELECT DISTINCT issuer, category FROM m),
watched AS (SELECT asg.*, category FROM asg JOIN mc USING (issuer)),
sp AS (SELECT *, CASE WHEN ps <= 0 AND cs <= 0 THEN 'absent' WHEN ps <= 0 THEN 'initiated' WHEN cs <= 0 THEN 'liquidated' WHEN cs > ps THEN 'increased' WHEN cs < ps THEN 'decreased' ELSE 'unchanged' END AS action FROM (
  SELECT cik, fund_name, category, security, any_value(issuer) AS issuer, sum(CASE WHEN period = 'previous' THEN shares ELSE 0 END) AS ps, sum(CASE WHEN period = 'current' THEN shares ELSE 0 END) AS cs,
  sum(CASE WHEN period = 'previous' THEN actual ELSE 0 END) AS pv, sum(CASE WHEN period = 'current' THEN actual ELSE 0 END) AS cv,
  sum(CASE WHEN period = 'previous' THEN value ELSE 0 END) AS prv, sum(CASE WHEN period = 'current' THEN value ELSE 0 END) AS crv
  FROM watched WHERE cik IN (SELECT cik FROM comp) GROUP BY 1, 2, 3, 4)),
fc AS (SELECT *, CASE WHEN ps <= 0 AND cs <= 0 THEN 'absent' WHEN ps <= 0 THEN 'initiated' WHEN cs <= 0 THEN 'liquidated' WHEN cs > ps THEN 'increased' WHEN cs < ps THEN 'decreased' ELSE 'unchanged' END AS action FROM (
  SELECT cik, fund_name, category, sum(ps) AS ps, sum(cs) AS cs, sum(pv) AS pv, sum(cv) AS cv, count(*) AS n FROM sp WHERE action <> 'absent' GROUP BY 1, 2, 3)),
it AS (SELECT *, CASE WHEN ps <= 0 AND cs <= 0 THEN 'absent' WHEN ps <= 0 THEN 'initiated' WHEN cs <= 0 THEN 'liquidated' WHEN cs > ps THEN 'increased' WHEN cs < ps THEN 'decreased' ELSE 'unchanged' END AS action FROM (
  SELECT cik, sp.category, item_key, label, sum(ps) AS ps, sum(cs) AS cs, sum(pv) AS pv, sum(cv) AS cv FROM sp JOIN m ON m.category = sp.category AND m.issuer = sp.issuer WHERE action <> 'absent' GROUP BY 1, 2, 3, 4))
"""


def with_sql(body: str, more: str = "") -> str:
    return f"WITH {SQL}{', ' + more if more else ''} {body}"
