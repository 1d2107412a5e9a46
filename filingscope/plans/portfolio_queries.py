"""Portfolio and reverse-lookup queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.functions.columns import round_double
from filingscope.operators import matching, portfolio as P
from filingscope.operators.radar import latest_filing_per_filer
from filingscope.plans.fixtures import CURRENT, PREVIOUS, SECTORS, cusip_holdings as holdings, filings, with_sql
from filingscope.plans.radar_queries import _SECTOR, tidy
from filingscope.tables import write_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_sql(sql, more)
        return f

    return add


def latest_portfolio(s, d, quarter):
    one = (quarter, quarter)
    own = latest_filing_per_filer(filings(s, d, one)).filter(F.col("quarter") == quarter).select("accession")
    return P.portfolio_aggregate(holdings(s, d, one).join(own, "accession", "left_semi"))


def difference(s, d):
    both = (PREVIOUS, CURRENT)
    own = latest_filing_per_filer(filings(s, d, both)).select("accession")
    return P.quarter_diff(P.portfolio_aggregate(holdings(s, d, both).join(own, "accession", "left_semi")), CURRENT, PREVIOUS)


_PA = "pa AS (SELECT cik, accession, quarter, security, min(issuer) AS issuer, sum(value) AS value, sum(shares) AS shares FROM h GROUP BY 1, 2, 3, 4), lp AS (SELECT pa.* FROM pa JOIN lat USING (cik, quarter, accession))"
_DF = _PA + f""", df0 AS (SELECT coalesce(a.cik, b.cik) AS cik, coalesce(a.security, b.security) AS security, coalesce(a.issuer, b.issuer) AS issuer, coalesce(a.shares, 0) AS shares, coalesce(a.value, 0) AS value, coalesce(b.shares, 0) AS previous_shares, coalesce(b.value, 0) AS previous_value
 FROM (SELECT * FROM lp WHERE quarter = '{CURRENT}') a FULL OUTER JOIN (SELECT * FROM lp WHERE quarter = '{PREVIOUS}') b ON a.cik = b.cik AND a.security = b.security),
df AS (SELECT *, shares - previous_shares AS change, CASE WHEN previous_shares > 0 THEN CASE WHEN shares <= 0 THEN -100 ELSE (shares - previous_shares) / previous_shares * 100 END WHEN shares > 0 THEN 100 ELSE 0 END AS percent,
 previous_shares <= 0 AND shares > 0 AS is_new, previous_shares > 0 AND shares > previous_shares AS is_add_on, previous_shares > 0 AND shares <= 0 AS is_exit FROM df0)"""
_DC = "cik, security, issuer, round(shares, 5) AS shares, round(value, 5) AS value, round(previous_shares, 5) AS previous_shares, round(previous_value, 5) AS previous_value, round(change, 5) AS change, round(percent, 7) AS percent, is_new, is_add_on, is_exit"


@query("SELECT cik, accession, quarter, security, issuer, round(value, 5) AS value, round(shares, 5) AS shares FROM pa", _PA)
def portfolio_aggregate(s, d):
    return tidy(P.portfolio_aggregate(holdings(s, d)), 5)


_UM = _PA + ", um AS (SELECT accession, ratio FROM (SELECT accession, value / shares AS ratio, row_number() OVER (PARTITION BY accession ORDER BY value / shares, security) AS rn, count(*) OVER (PARTITION BY accession) AS n FROM pa WHERE value > 0 AND shares > 0) WHERE rn = n // 2 + 1)"


@query("SELECT pa.accession, security, round(CASE WHEN ratio > 4 THEN value / 1000 ELSE value END, 7) AS value, round(ratio, 7) AS median_ratio FROM pa LEFT JOIN um ON um.accession = pa.accession", _UM)
def unit_normalize_by_median(s, d):
    out = P.unit_normalize_by_median(P.portfolio_aggregate(holdings(s, d)))
    return out.select("accession", "security", F.round("value", 7).alias("value"), F.round("median_ratio", 7).alias("median_ratio"))


@query(f"SELECT {_DC} FROM df", _DF)
def portfolio_diff(s, d):
    out = difference(s, d)
    return out.select(*[F.round(c, 7 if c == "percent" else 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_CU = """cu AS (SELECT l_suppkey AS k, CAST(l_partkey AS VARCHAR) AS cusip, quarter, p_name AS issuer, l_quantity AS shares, row_number() OVER (PARTITION BY l_suppkey, l_partkey, quarter ORDER BY row_id DESC) AS rn FROM (SELECT l.*, p.p_name, CAST(year(l_shipdate) AS VARCHAR) || '-Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS quarter, l_orderkey * 100 + l_linenumber AS row_id FROM lineitem l JOIN part p ON l_partkey = p_partkey)),
cd0 AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.cusip, b.cusip) AS cusip, coalesce(a.issuer, b.issuer) AS issuer, coalesce(a.shares, 0) AS shares, coalesce(b.shares, 0) AS previous_shares FROM (SELECT * FROM cu WHERE rn = 1 AND quarter = '2001-Q3') a FULL OUTER JOIN (SELECT * FROM cu WHERE rn = 1 AND quarter = '2001-Q2') b ON a.k = b.k AND a.cusip = b.cusip),
cd AS (SELECT CAST(k AS VARCHAR) AS cik, *, shares - previous_shares AS delta FROM cd0 WHERE shares <> previous_shares)"""


def by_cusip(s, d):
    rows = holdings(s, d).withColumns({"cusip": F.col("part"), "cik": F.split("accession", "-")[0]})
    return P.portfolio_diff_by_cusip(rows.filter(F.col("quarter") == CURRENT), rows.filter(F.col("quarter") == PREVIOUS))


@query("SELECT cik, cusip, issuer, round(shares, 2) AS shares, round(previous_shares, 2) AS previous_shares, round(delta, 2) AS delta, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS action FROM cd", _CU)
def portfolio_diff_by_cusip(s, d):
    return tidy(by_cusip(s, d).select("cik", "cusip", "issuer", "shares", "previous_shares", "delta", "action"))


@query("SELECT cik, round(sum(greatest(delta, 0)), 2) AS bought, round(sum(greatest(-delta, 0)), 2) AS sold, count(*) AS changes, count(*) FILTER (previous_shares = 0) AS new_positions, count(*) FILTER (shares = 0) AS exits, round(sum(delta), 2) AS net_conviction, CASE WHEN sum(delta) > 0 THEN 'BULLISH' WHEN sum(delta) < 0 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal FROM cd GROUP BY 1", _CU)
def portfolio_conviction(s, d):
    return tidy(P.portfolio_conviction(by_cusip(s, d)))


_RN = "row_number() OVER (PARTITION BY cik ORDER BY {})"


@query(f"SELECT * FROM (SELECT cik, security, round(value, 5) AS value, {_RN.format('value DESC, security')} AS rank FROM lp WHERE quarter = '{CURRENT}') WHERE rank <= 5", _PA)
def top_holdings(s, d):
    return tidy(P.top_holdings(latest_portfolio(s, d, CURRENT)).select("cik", "security", "value", "rank"), 5)


@query(f"SELECT * FROM (SELECT cik, security, round(change, 2) AS change, {_RN.format('change DESC, security')} AS rank FROM df WHERE change > 0) WHERE rank <= 5", _DF)
def top_buys(s, d):
    return tidy(P.top_buys(difference(s, d)).select("cik", "security", "change", "rank"))


@query(f"SELECT * FROM (SELECT cik, security, round(change, 2) AS change, {_RN.format('change, security')} AS rank FROM df WHERE change < 0) WHERE rank <= 5", _DF)
def top_sells(s, d):
    return tidy(P.top_sells(difference(s, d)).select("cik", "security", "change", "rank"))


@query(f"SELECT cik, security, round(change, 2) AS change, {_RN.format('CASE WHEN is_new THEN 0 WHEN is_exit THEN 1 ELSE 2 END, abs(change) DESC, value DESC, security')} AS rank FROM df WHERE change <> 0", _DF)
def ranked_changes(s, d):
    return tidy(P.ranked_changes(difference(s, d)).select("cik", "security", "change", "rank"))


@query(f"SELECT a.cik AS cik_a, b.cik AS cik_b, security, round(a.shares, 5) AS shares_a, round(b.shares, 5) AS shares_b, round(a.value + b.value, 5) AS combined FROM (SELECT * FROM lp WHERE quarter = '{CURRENT}') a JOIN (SELECT * FROM lp WHERE quarter = '{CURRENT}') b USING (security) WHERE a.cik < b.cik", _PA)
def portfolio_overlap_all_pairs(s, d):
    own = latest_portfolio(s, d, CURRENT).withColumn("shares", round_double("shares", 5))  # once for a position, not for each pair
    own = write_table(own, "portfolios")
    return P.portfolio_overlap_all_pairs(own).select("cik_a", "cik_b", "security", "shares_a", "shares_b", round_double("combined", 5).alias("combined"))


_PAIR = _PA + f""", cur AS (SELECT * FROM lp WHERE quarter = '{CURRENT}'), pair AS (SELECT a.cik AS cik_a, b.cik AS cik_b FROM cur a JOIN cur b USING (security) WHERE a.cik < b.cik GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)"""


@query("SELECT cik_a, cik_b, a.security AS security, round(a.shares, 5) AS shares_a, round(b.shares, 5) AS shares_b, round(a.value, 5) AS value_a, round(b.value, 5) AS value_b, round(a.value + b.value, 5) AS combined FROM pair JOIN cur a ON a.cik = cik_a JOIN cur b ON b.cik = cik_b AND a.security = b.security ORDER BY a.value + b.value DESC, a.security LIMIT 50", _PAIR)
def portfolio_overlap(s, d):
    """Of the two filers that have the most securities in common."""
    own = write_table(latest_portfolio(s, d, CURRENT), "portfolios")
    a, b = P.closest_pair(own) or ("", "")
    return tidy(P.portfolio_overlap(own, a, b).select("cik_a", "cik_b", "security", "shares_a", "shares_b", "value_a", "value_b", "combined"), 5)


@query(f"SELECT count(*) FILTER (va IS NOT NULL AND vb IS NOT NULL) AS n_common, count(*) FILTER (vb IS NULL) AS n_only_a, count(*) FILTER (va IS NULL) AS n_only_b, round(coalesce(sum(va) FILTER (vb IS NOT NULL), 0), 5) AS value_a, round(coalesce(sum(vb) FILTER (va IS NOT NULL), 0), 5) AS value_b FROM (SELECT security, max(value) FILTER (cik = '3') AS va, max(value) FILTER (cik = '7') AS vb FROM lp WHERE quarter = '{CURRENT}' AND cik IN ('3', '7') GROUP BY 1)", _PA)
def overlap_summary(s, d):
    return tidy(P.overlap_summary(latest_portfolio(s, d, CURRENT), "3", "7").na.fill(0.0), 5)


@query(f"SELECT cik, sector, round(sum(value), 5) AS value FROM (SELECT *, {_RN.format('value DESC, security')} AS rank FROM lp WHERE quarter = '{CURRENT}') JOIN sec USING (issuer) WHERE rank <= 50 GROUP BY 1, 2", _PA + ", " + _SECTOR)
def sector_allocation(s, d):
    own = latest_portfolio(s, d, CURRENT)
    return tidy(P.sector_allocation(own, matching.sector_of(own, SECTORS)), 5)


@query("SELECT issuer, count(*) AS n FROM h WHERE upper(issuer) LIKE 'RED%' GROUP BY 1")
def issuer_prefix_filter(s, d):
    return P.issuer_prefix_filter(holdings(s, d), P.issuer_prefix("red widget")).groupBy("issuer").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT h.cik, h.accession, issuer, h.row_id, f.filing_date, fund_name FROM h JOIN f USING (cik, accession) WHERE upper(issuer) LIKE 'RED%' ORDER BY f.filing_date DESC, h.accession, row_id LIMIT 10000")
def issuer_prefix_lookup(s, d):
    return P.issuer_prefix_lookup(holdings(s, d), filings(s, d), "RED").select("cik", "accession", "issuer", "row_id", "filing_date", "fund_name")


@query("SELECT cik, accession, quarter, filing_date, fund_name FROM f WHERE cik IN (SELECT cik FROM h WHERE upper(issuer) LIKE 'RED W%')")
def filings_of_matching_filers(s, d):
    return P.filings_of_matching_filers(filings(s, d), holdings(s, d), "RED W").select("cik", "accession", "quarter", "filing_date", "fund_name")


@query("SELECT count(*) AS n, round(sum(shares), 2) AS shares FROM h WHERE putcall IS NULL")
def share_type_filter(s, d):
    rows = holdings(s, d).withColumn("share_type", F.when(F.col("putcall") == "Put", "OPT").when(F.col("row_id") % 2 == 0, "SH"))
    return tidy(P.share_type_filter(rows).agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares")))


def red(s, d):
    return P.issuer_prefix_filter(holdings(s, d).filter("putcall is null"), "RED")


_PF = """pf AS (SELECT accession, sum(shares) AS shares, sum(CASE WHEN value <= 0 THEN 0 WHEN shares <= 0 THEN value WHEN abs(value / shares) > 4 THEN value ELSE value * 1000 END) AS value, array_to_string(list_sort(list(DISTINCT issuer))[1:3], '; ') AS issuers FROM h WHERE upper(issuer) LIKE 'RED%' AND putcall IS NULL GROUP BY 1),
ps AS (SELECT cik, fund_name, quarter, accession, filing_date, coalesce(shares, 0) AS shares, coalesce(value, 0) AS value, issuers FROM lat LEFT JOIN pf USING (accession)),
rl0 AS (SELECT *, lag(shares) OVER (PARTITION BY cik ORDER BY quarter) AS previous_shares, lag(quarter) OVER (PARTITION BY cik ORDER BY quarter) AS previous_quarter, max(shares) OVER (PARTITION BY cik) AS held, row_number() OVER (PARTITION BY cik ORDER BY quarter DESC) AS rn FROM ps),
rl AS (SELECT *, shares - coalesce(previous_shares, 0) AS delta, CASE WHEN previous_shares > 0 THEN (shares - previous_shares) / previous_shares * 100 END AS delta_pct, CASE WHEN previous_shares IS NULL THEN CASE WHEN shares > 0 THEN 'no_prior' ELSE 'absent' END WHEN previous_shares <= 0 AND shares <= 0 THEN 'absent' WHEN previous_shares <= 0 THEN 'initiated' WHEN shares <= 0 THEN 'liquidated' WHEN shares > previous_shares THEN 'increased' WHEN shares < previous_shares THEN 'decreased' ELSE 'unchanged' END AS action FROM rl0 WHERE rn = 1 AND held > 0),
rr AS (SELECT * FROM rl WHERE action <> 'absent')"""


@query("SELECT accession, round(shares, 2) AS shares, round(value, 2) AS value, issuers FROM pf", _PF)
def position_by_filing(s, d):
    return tidy(P.position_by_filing(red(s, d)).select("accession", "shares", "value", "issuers"))


@query("SELECT cik, quarter, accession, round(shares, 2) AS shares, round(value, 2) AS value FROM ps", _PF)
def position_series(s, d):
    return tidy(P.position_series(filings(s, d), red(s, d)).select("cik", "quarter", "accession", "shares", "value"))


_RC = "cik, fund_name, quarter, previous_quarter, filing_date, round(shares, 2) AS shares, round(previous_shares, 2) AS previous_shares, round(delta, 2) AS delta, round(delta_pct, 2) AS delta_pct, action"
_RS = ["cik", "fund_name", "quarter", "previous_quarter", "filing_date", "shares", "previous_shares", "delta", "delta_pct", "action"]


@query(f"SELECT {_RC} FROM rr", _PF)
def reverse_lookup(s, d):
    return tidy(P.reverse_lookup(filings(s, d), red(s, d)).select(*_RS))


@query(f"SELECT {_RC} FROM rr ORDER BY filing_date DESC, list_position(['initiated', 'liquidated', 'increased', 'decreased', 'unchanged', 'no_prior'], action), abs(delta) DESC, fund_name, cik LIMIT 1000", _PF)
def reverse_lookup_ranked(s, d):
    return tidy(P.reverse_lookup_ranked(P.reverse_lookup(filings(s, d), red(s, d))).select(*_RS))


@query("SELECT action, count(*) AS n FROM rr GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM rr", _PF)
def reverse_action_counts(s, d):
    return P.reverse_action_counts(P.reverse_lookup(filings(s, d), red(s, d)))


@query("SELECT cik, quarter, round(shares, 2) AS shares FROM (SELECT *, max(CASE WHEN shares > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cik ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS begun FROM ps) WHERE begun = 1", _PF)
def position_history(s, d):
    return tidy(P.position_history(filings(s, d), red(s, d)).select("cik", "quarter", "shares"))


@query("SELECT * FROM (SELECT cik, accession, filing_date, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) AS recency FROM f) WHERE recency <= 8")
def last_n_filings(s, d):
    return P.last_n_filings(filings(s, d), 8).select("cik", "accession", "filing_date", "recency")


@query("SELECT cik, accession, recency, round(coalesce(shares, 0), 2) AS shares, round(coalesce(value, 0), 5) AS value, round(CASE WHEN coalesce(shares, 0) > 0 THEN value * 1000 / shares ELSE 0 END, 7) AS implied_price FROM (SELECT cik, accession, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) AS recency FROM f) LEFT JOIN (SELECT accession, sum(shares) AS shares, sum(value) AS value FROM h WHERE contains(upper(issuer), 'GEAR') GROUP BY 1) USING (accession) WHERE recency <= 8")
def holding_history(s, d):
    out = P.holding_history(filings(s, d), holdings(s, d), "gear")
    return out.select("cik", "accession", "recency", F.round("shares", 2).alias("shares"), F.round("value", 5).alias("value"), F.round("implied_price", 7).alias("implied_price"))


@query("SELECT cik, accession, round(coalesce(shares, 0), 2) AS shares, round(coalesce(value, 0), 2) AS value FROM (SELECT cik, accession, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession) AS rn FROM f) LEFT JOIN (SELECT accession, sum(shares) AS shares, sum(value) * 1000 AS value FROM h WHERE contains(upper(replace(issuer, ' ', '')), 'REDGEAR') OR contains(upper(issuer), 'ANVIL') GROUP BY 1) USING (accession) WHERE rn = 1")
def live_holder_positions(s, d):
    hits = filings(s, d).withColumn("position", F.struct(-F.unix_date("filing_date"), F.col("accession")))
    return tidy(P.live_holder_positions(hits, holdings(s, d), ["red gear", "anvil"]).select("cik", "accession", "shares", "value"))
