"""Radar queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.functions.columns import classify_filer
from filingscope.operators import matching, radar as R
from filingscope.plans.fixtures import CURRENT, PATTERNS, PREVIOUS, SECTORS, filings, funds, holdings, radar, with_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_sql(sql, more)
        return f

    return add


def tidy(df: DataFrame, places: int = 2) -> DataFrame:
    """Doubles to some decimals (5 where values in thousands have as many), arrays of strings joined."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(F.round(f.name, places).alias(f.name) if kind == "double" else F.concat_ws("; ", f.name).alias(f.name) if kind == "array<string>" else F.col(f.name))
    return df.select(*out)


def placed(ordered: DataFrame) -> DataFrame:
    """A report of a few ordered rows (one per category) with each row's place in it."""
    rows = ordered.collect()
    return ordered.sparkSession.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], ordered.schema.add("place", "long"))


@query("SELECT cik, quarter, accession, filing_date, fund_name FROM lat")
def latest_filing_per_filer(s, d):
    return R.latest_filing_per_filer(filings(s, d)).select("cik", "quarter", "accession", "filing_date", "fund_name")


@query("SELECT cik, fund_name, current_accession, current_date_ AS current_date, previous_accession, previous_date_ AS previous_date FROM comp")
def comparable_filers(s, d):
    return R.comparable_filers(filings(s, d), CURRENT, PREVIOUS)


@query("SELECT count(*) AS n, round(sum(shares), 2) AS shares FROM h WHERE putcall IS NULL")
def exclude_options(s, d):
    return tidy(R.exclude_options(holdings(s, d)).agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares")))


@query("SELECT row_id, cik, accession, quarter, period, filing_date FROM asg")
def period_assignment(s, d):
    return R.period_assignment(R.exclude_options(holdings(s, d)), filings(s, d), CURRENT, PREVIOUS).select("row_id", "cik", "accession", "quarter", "period", "filing_date")


@query("SELECT row_id, h.cik, h.accession, issuer, filing_date, fund_name, round(shares, 2) AS shares FROM h JOIN lat USING (cik, quarter, accession) WHERE h.quarter IN ('2001-Q3', '2001-Q2')")
def holdings_of_filings(s, d):
    latest = R.latest_filing_per_filer(filings(s, d)).filter(F.col("quarter").isin(CURRENT, PREVIOUS))
    return tidy(R.holdings_of_filings(holdings(s, d), latest).select("row_id", "cik", "accession", "issuer", "filing_date", "fund_name", "shares"))


@query("SELECT issuer, category, item_key, label FROM m")
def issuer_watchlist_match(s, d):
    return matching.issuer_watchlist_match(holdings(s, d), radar(s, d).aliases).select("issuer", "category", "item_key", "label")


@query("SELECT issuer, count(*) AS n FROM h WHERE issuer IN (SELECT issuer FROM m) GROUP BY 1")
def watchlist_filter(s, d):
    rows = holdings(s, d)
    return matching.watchlist_filter(rows, matching.issuer_watchlist_match(rows, radar(s, d).aliases)).groupBy("issuer").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT issuer, count(*) AS n FROM h WHERE regexp_matches(upper(issuer), 'RED|RDX|RDP|ANVIL|ANVL|BOLT|BLT|SMALL|GEAR|RING|ZEPPELIN|ZZZZ') GROUP BY 1")
def like_prefilter(s, d):
    return matching.like_prefilter(holdings(s, d), radar(s, d).aliases).groupBy("issuer").agg(F.count(F.lit(1)).alias("n"))


_SECTOR = """sec AS (SELECT issuer, CASE WHEN upper(issuer) = 'RED WIDGET' THEN 'Information Technology' WHEN upper(issuer) = 'SMALL GEAR' THEN 'Industrials' WHEN upper(issuer) = 'HOT BOLT' THEN 'Materials'
 WHEN contains(upper(issuer), 'RED WIDGET') THEN 'Information Technology' WHEN contains(upper(issuer), 'SMALL GEAR') THEN 'Industrials' WHEN contains(upper(issuer), 'BLUE') THEN 'Energy'
 WHEN contains(upper(issuer), 'GEAR') THEN 'Industrials' WHEN contains(upper(issuer), 'PLATE') THEN 'Consumer Defensive' ELSE 'Other' END AS sector FROM (SELECT DISTINCT issuer FROM h))"""


@query("SELECT issuer, sector FROM sec", _SECTOR)
def sector_of(s, d):
    return matching.sector_of(holdings(s, d), SECTORS)


_SP = "round(ps, 2) AS previous_shares, round(cs, 2) AS current_shares, round(pv, 2) AS previous_value, round(cv, 2) AS current_value"
_SP4 = ["previous_shares", "current_shares", "previous_value", "current_value"]


@query(f"SELECT cik, fund_name, category, security, {_SP}, action FROM sp")
def security_positions(s, d):
    return tidy(radar(s, d).security_positions().select("cik", "fund_name", "category", "security", *_SP4, "action"))


_NAMES = {"buyer": "'initiated', 'increased'", "seller": "'liquidated', 'decreased'", "initiated": "'initiated'", "liquidated": "'liquidated'"}
_MV = """mv AS (SELECT category, security, count(*) FILTER (cs > 0) AS holders_now, count(*) FILTER (ps > 0) AS holders_before, count(*) FILTER (action IN ('initiated', 'increased')) AS buyers, count(*) FILTER (action IN ('liquidated', 'decreased')) AS sellers,
 count(*) FILTER (action = 'initiated') AS initiated, count(*) FILTER (action = 'liquidated') AS liquidated, sum(pv) AS pv, sum(cv) AS cv,
""" + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT fund_name) FILTER (action IN ({a})))[1:5], '; '), '') AS {n}_names" for n, a in _NAMES.items()) + " FROM sp GROUP BY 1, 2)"
_MVC = "category, security, holders_now, holders_before, buyers, sellers, buyers - sellers AS net, initiated, liquidated, round(pv, 2) AS previous_value, round(cv, 2) AS current_value, buyer_names, seller_names, initiated_names, liquidated_names"
_MVS = ["category", "security", "holders_now", "holders_before", "buyers", "sellers", "net", "initiated", "liquidated", "previous_value", "current_value", "buyer_names", "seller_names", "initiated_names", "liquidated_names"]


@query(f"SELECT {_MVC} FROM mv", _MV)
def security_movements(s, d):
    return tidy(radar(s, d).security_movements().select(*_MVS))


@query(f"SELECT {_MVC} FROM mv ORDER BY initiated + liquidated DESC, pv + cv DESC, category, security LIMIT 100", _MV)
def top_security_movements(s, d):
    return tidy(radar(s, d).top_security_movements().select(*_MVS))


@query(f"SELECT {_MVC} FROM mv WHERE initiated > 0 ORDER BY initiated DESC, cv DESC, category, security LIMIT 50", _MV)
def top_initiations(s, d):
    return tidy(radar(s, d).top_initiations().select(*_MVS))


@query(f"SELECT {_MVC} FROM mv WHERE liquidated > 0 ORDER BY liquidated DESC, pv DESC, category, security LIMIT 50", _MV)
def top_liquidations(s, d):
    return tidy(radar(s, d).top_liquidations().select(*_MVS))


@query(f"SELECT cik, fund_name, category, {_SP}, n AS n_securities, action FROM fc")
def filer_category_positions(s, d):
    return tidy(radar(s, d).filer_category_positions().select("cik", "fund_name", "category", *_SP4, "n_securities", "action"))


@query(f"SELECT cik, category, item_key, label, {_SP}, action FROM it")
def filer_item_details(s, d):
    return tidy(radar(s, d).filer_item_details().select("cik", "category", "item_key", "label", *_SP4, "action"))


_PCT = lambda a, b: f"CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / {b} * 100, 1) ELSE 0 END"
_CAT = """cs0 AS (SELECT c.category, coalesce(holders_now, 0) AS holders_now, coalesce(holders_before, 0) AS holders_before, coalesce(exposed, 0) AS exposed, coalesce(buyers, 0) AS buyers, coalesce(sellers, 0) AS sellers, coalesce(initiated, 0) AS initiated, coalesce(liquidated, 0) AS liquidated,
 coalesce(increased, 0) AS increased, coalesce(decreased, 0) AS decreased, coalesce(unchanged, 0) AS unchanged, coalesce(round(pv, 2), 0) AS previous_value, coalesce(round(cv, 2), 0) AS current_value, (SELECT count(*) FROM comp) AS comparable
 FROM (SELECT DISTINCT category FROM al) c LEFT JOIN (SELECT category, count(*) FILTER (cs > 0) AS holders_now, count(*) FILTER (ps > 0) AS holders_before, count(*) AS exposed, count(*) FILTER (action IN ('initiated', 'increased')) AS buyers, count(*) FILTER (action IN ('liquidated', 'decreased')) AS sellers,
 count(*) FILTER (action = 'initiated') AS initiated, count(*) FILTER (action = 'liquidated') AS liquidated, count(*) FILTER (action = 'increased') AS increased, count(*) FILTER (action = 'decreased') AS decreased, count(*) FILTER (action = 'unchanged') AS unchanged, sum(pv) AS pv, sum(cv) AS cv FROM fc GROUP BY 1) x USING (category))"""


@query("SELECT *, " + ", ".join(f"{_PCT(c, 'comparable')} AS {c}_pct" for c in ("exposed", "holders_now", "holders_before", "buyers", "sellers", "initiated", "liquidated")) + ", " + ", ".join(f"{_PCT(c, 'exposed')} AS {c}_pct_exposed" for c in ("buyers", "sellers", "initiated", "liquidated")) + " FROM cs0", _CAT)
def category_summary(s, d):
    return tidy(radar(s, d).category_summary())


_FM = """fm AS (SELECT fc.*, coalesce(n_details, 0) AS n_details, coalesce(n_initiated, 0) AS n_initiated, coalesce(n_liquidated, 0) AS n_liquidated, coalesce(details, '') AS details FROM fc LEFT JOIN (SELECT cik, category, count(*) AS n_details, count(*) FILTER (action = 'initiated') AS n_initiated, count(*) FILTER (action = 'liquidated') AS n_liquidated, string_agg(item_key || ' ' || label || ' ' || action, '; ' ORDER BY item_key) AS details
 FROM it WHERE action NOT IN ('absent', 'unchanged') GROUP BY 1, 2) x USING (cik, category) WHERE action NOT IN ('absent', 'unchanged'))"""
_FMC = "cik, category, action, round(cv - pv, 2) AS value_delta, n_details, n_initiated, n_liquidated, details"


def _moves(df):
    shown = F.transform("details", lambda d: F.concat_ws(" ", d["item_key"], d["label"], d["action"]))
    return tidy(df.select("cik", "category", "action", "value_delta", F.size("details").cast("long").alias("n_details"), F.col("n_initiated").cast("long").alias("n_initiated"), F.col("n_liquidated").cast("long").alias("n_liquidated"), shown.alias("details")))


@query(f"SELECT {_FMC} FROM fm", _FM)
def filer_moves(s, d):
    return _moves(radar(s, d).filer_moves())


@query(f"SELECT {_FMC} FROM fm ORDER BY abs(cv - pv) DESC, cik, category LIMIT 100", _FM)
def top_filer_moves(s, d):
    return _moves(radar(s, d).top_filer_moves())


_SM = _SECTOR + """, sm AS (SELECT sector, count(*) FILTER (cs > 0 AND ps <= 0 OR ps > 0 AND cs > ps) AS buyers, count(*) FILTER (ps > 0 AND cs < ps) AS sellers, count(*) FILTER (ps <= 0 AND cs > 0) AS initiated, count(*) FILTER (ps > 0 AND cs <= 0) AS liquidated, sum(pv) AS pv, sum(cv) AS cv FROM (
 SELECT cik, sector, sum(CASE WHEN period = 'previous' THEN shares ELSE 0 END) AS ps, sum(CASE WHEN period = 'current' THEN shares ELSE 0 END) AS cs, sum(CASE WHEN period = 'previous' THEN actual ELSE 0 END) AS pv, sum(CASE WHEN period = 'current' THEN actual ELSE 0 END) AS cv
 FROM asg JOIN sec USING (issuer) WHERE cik IN (SELECT cik FROM comp) AND issuer IN (SELECT issuer FROM m) GROUP BY 1, 2) GROUP BY 1)"""
_SMC = "sector, buyers, sellers, buyers - sellers AS net, initiated, liquidated, round(pv, 2) AS previous_value, round(cv, 2) AS current_value"
_SMS = ["sector", "buyers", "sellers", "net", "initiated", "liquidated", "previous_value", "current_value"]


@query(f"SELECT {_SMC} FROM sm", _SM)
def sector_movers(s, d):
    return tidy(radar(s, d).sector_movers(SECTORS).select(*_SMS))


@query(f"SELECT {_SMC} FROM sm ORDER BY buyers DESC, abs(buyers - sellers) DESC, sector LIMIT 1", _SM)
def top_sector_mover(s, d):
    return tidy(R.top_sector_mover(radar(s, d).sector_movers(SECTORS)).select(*_SMS))


@query("SELECT 'Other' AS filer_type, category, count(*) FILTER (cs > 0) AS holders_now, count(*) FILTER (action IN ('initiated', 'increased')) AS buyers, count(*) FILTER (action IN ('liquidated', 'decreased')) AS sellers, count(*) FILTER (action = 'initiated') AS initiated, count(*) FILTER (action = 'liquidated') AS liquidated, round(sum(pv), 2) AS previous_value, round(sum(cv), 2) AS current_value FROM fc GROUP BY 2")
def filer_type_summary(s, d):
    return tidy(radar(s, d).filer_type_summary())


@query("""SELECT it.cik, fund_name, 'Other' AS filer_type, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (it.cs > 0)), '; '), '') AS current_items, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (it.ps > 0)), '; '), '') AS previous_items,
 coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (it.action = 'initiated')), '; '), '') AS initiated_items, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (it.action = 'liquidated')), '; '), '') AS liquidated_items, round(sum(it.pv), 2) AS previous_value, round(sum(it.cv), 2) AS current_value
 FROM it JOIN fc USING (cik, category) WHERE category = 'metal' GROUP BY 1, 2""")
def institution_category_summary(s, d):
    return tidy(radar(s, d).institution_category_summary("metal", ("Other",)))


_CH = """ch0 AS (SELECT cik, category, fund_name, sum(shares) AS shares, sum(actual) AS value FROM watched WHERE period = 'current' GROUP BY 1, 2, 3 HAVING sum(shares) > 0),
ch AS (SELECT ch0.*, coalesce(ps, 0) AS previous_shares, coalesce(pv, 0) AS previous_value, CASE WHEN coalesce(ps, 0) <= 0 THEN 'initiated' WHEN shares > ps THEN 'increased' WHEN shares < ps THEN 'decreased' ELSE 'unchanged' END AS action,
 row_number() OVER (PARTITION BY category ORDER BY shares DESC, cik) AS category_rank FROM ch0 LEFT JOIN (SELECT cik, category, ps, pv FROM fc) x USING (cik, category))"""


@query("SELECT cik, category, fund_name, round(shares, 2) AS shares, round(value, 2) AS value, round(previous_shares, 2) AS previous_shares, round(previous_value, 2) AS previous_value, action, category_rank FROM ch", _CH)
def current_holders_by_category(s, d):
    return tidy(radar(s, d).current_holders_by_category())


@query("SELECT cik, category, round(shares, 2) AS shares, round(previous_shares, 2) AS previous_shares, round(previous_value, 2) AS previous_value FROM ch", _CH)
def prior_for_current_holders(s, d):
    return tidy(radar(s, d).prior_for_current_holders().select("cik", "category", "shares", "previous_shares", "previous_value"))


@query("SELECT category, cik, category_rank FROM ch", _CH)
def category_rank(s, d):
    return radar(s, d).current_holders_by_category().select("category", "cik", "category_rank")


@query(f"SELECT (SELECT count(*) FROM lat WHERE quarter = '{CURRENT}') AS current_filers, (SELECT count(*) FROM lat WHERE quarter = '{PREVIOUS}') AS previous_filers, (SELECT count(*) FROM comp) AS comparable_filers, count(DISTINCT cik) AS watched_filers, count(DISTINCT row_id) AS watched_rows FROM watched WHERE cik IN (SELECT cik FROM comp)")
def radar_coverage(s, d):
    return radar(s, d).radar_coverage()


@query("""SELECT sp.cik, category, security, round(prv, 5) AS previous_raw_value, round(crv, 5) AS current_raw_value, round(pv, 5) AS previous_value, round(cv, 5) AS current_value, action, current_accession, previous_accession,
 CASE WHEN sp.cik <> '0' THEN 'https://www.sec.gov/Archives/edgar/data/' || sp.cik || '/' || replace(current_accession, '-', '') || '/' || current_accession || '.txt' END AS current_url FROM sp JOIN comp ON sp.cik = comp.cik""")
def audit_rows(s, d):
    return tidy(radar(s, d).audit_rows().select("cik", "category", "security", "previous_raw_value", "current_raw_value", "previous_value", "current_value", "action", "current_accession", "previous_accession", "current_url"), 5)


@query("SELECT row_id, cik, accession, quarter, period, issuer, round(value, 5) AS value, round(shares, 5) AS shares, array_to_string(list_sort(list(DISTINCT category)), '; ') AS categories, array_to_string(list_sort(list(DISTINCT label)), '; ') AS labels FROM asg JOIN m USING (issuer) GROUP BY row_id, cik, accession, quarter, period, issuer, value, shares")
def raw_matched_holdings(s, d):
    return tidy(radar(s, d).raw_matched_holdings().drop("cusip"), 5)


_OC = _CH + ", ocr AS (SELECT *, shares / sum(shares) OVER (PARTITION BY category) * 100 AS pct FROM ch)"
_TOPS = ", ".join(f"round(sum(CASE WHEN category_rank <= {n} THEN pct ELSE 0 END), 2) AS top_{n}_pct" for n in (1, 5, 10, 25, 50, 100))


@query(f"SELECT category, CAST(round(sum(pct * pct)) AS BIGINT) AS hhi, {_TOPS}, count(*) AS holders, round(sum(shares), 2) AS shares, round(sum(value), 2) AS value, CASE WHEN round(sum(pct * pct)) >= 2500 THEN 'Highly concentrated' WHEN round(sum(pct * pct)) >= 1500 THEN 'Moderately concentrated' ELSE 'Unconcentrated' END AS label FROM ocr GROUP BY 1", _OC)
def ownership_concentration(s, d):
    return tidy(R.ownership_concentration(radar(s, d).current_holders_by_category()))


@query("SELECT category, CAST(round(sum(pct * pct)) AS BIGINT) AS hhi, count(*) AS holders, row_number() OVER (ORDER BY round(sum(pct * pct)) DESC, category) AS place FROM ocr GROUP BY 1", _OC)
def peer_hhi(s, d):
    """Where each category stands in the order: a row per category."""
    return placed(R.peer_hhi(radar(s, d).current_holders_by_category()).select("category", "hhi", "holders"))


@query("SELECT category, 'Other' AS filer_type, count(*) AS holders, round(sum(shares), 2) AS shares, round(sum(value), 2) AS value, 100.0 AS pct FROM ch GROUP BY 1", _CH)
def ownership_by_filer_type(s, d):
    return tidy(R.ownership_by_filer_type(radar(s, d).current_holders_by_category()))


@query("SELECT category, cik, action, round(shares, 2) AS shares FROM ch", _CH)
def holders_story_order(s, d):
    return tidy(R.holders_story_order(radar(s, d).current_holders_by_category()).select("category", "cik", "action", "shares"))


_FP = _CH + ", pt (label, pattern) AS (VALUES ('one', '00001'), ('seven', '7'), ('nobody', 'zzz')), fp AS (SELECT DISTINCT ch.*, label FROM ch JOIN pt ON contains(lower(fund_name), lower(pattern)))"


@query("SELECT label, cik, category FROM fp", _FP)
def fund_pattern_filter(s, d):
    return R.fund_pattern_filter(radar(s, d).current_holders_by_category(), s.createDataFrame(PATTERNS, "label string, pattern string")).select("label", "cik", "category")


@query("SELECT p.label, coalesce(matches, 0) AS matches, coalesce(shares, 0) AS shares, coalesce(pv, 0) AS previous_value, coalesce(categories, 0) AS categories, coalesce(matches, 0) > 0 AS found FROM (SELECT DISTINCT label FROM pt) p LEFT JOIN (SELECT label, count(*) AS matches, round(sum(shares), 2) AS shares, round(sum(previous_value), 2) AS pv, count(DISTINCT category) AS categories FROM fp GROUP BY 1) x USING (label)", _FP)
def watched_fund_summary(s, d):
    return tidy(R.watched_fund_summary(radar(s, d).current_holders_by_category(), s.createDataFrame(PATTERNS, "label string, pattern string")))


@query("SELECT quarter, row_number() OVER (ORDER BY quarter DESC) AS position, CASE row_number() OVER (ORDER BY quarter DESC) WHEN 1 THEN 'current' WHEN 2 THEN 'previous' END AS role FROM (SELECT DISTINCT quarter FROM f)")
def available_quarters(s, d):
    return R.available_quarters(filings(s, d))


@query("SELECT f.cik, fund_name, max(filing_date) AS latest, count(*) FILTER (quarter = '2001-Q3') AS current_filings, count(*) FILTER (quarter = '2001-Q2') AS previous_filings FROM f WHERE contains(upper(fund_name), 'SUPPLIER') GROUP BY 1, 2 ORDER BY latest DESC, cik LIMIT 30")
def filer_side_matches(s, d):
    aliases = matching.alias_table(s, {"all": [("SUPPLIER", "supplier", [])]})
    return R.filer_side_matches(funds(s, d), filings(s, d), aliases, CURRENT, PREVIOUS).drop("categories")


@query("SELECT cik, fund_name, 'Other' AS filer_type FROM (SELECT DISTINCT cik, fund_name FROM f)")
def classify_filer_query(s, d):
    return R.latest_filing_per_filer(filings(s, d)).select("cik", "fund_name").distinct().withColumn("filer_type", classify_filer("cik", "fund_name"))


QUERIES["classify_filer"], ORACLES["classify_filer"] = QUERIES.pop("classify_filer_query"), ORACLES.pop("classify_filer_query")
