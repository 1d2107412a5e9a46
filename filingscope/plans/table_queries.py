"""Queries of table maintenance, verification and joins on dimensions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.operators import maintenance as M
from filingscope.plans.fixtures import filings, funds, holdings, padded, read, with_sql
from filingscope.plans.radar_queries import tidy

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_sql(sql, more)
        return f

    return add


def numbered(s, d):
    """Filings, every third from another index source; a third of them twice."""
    rows = filings(s, d).withColumn("k", F.crc32("accession") % 3)
    one = rows.withColumn("source", F.element_at(F.array(F.lit("master"), F.lit("daily"), F.lit("feed")), (F.col("k") + 1).cast("int")))
    return one, rows.filter("k < 2").withColumn("source", F.lit("feed"))


@query("SELECT accession, quarter, source FROM (SELECT accession, quarter, 'feed' AS source FROM f)")
def union_index_sources(s, d):
    return M.union_index_sources(*numbered(s, d)).select("accession", "quarter", "source")


@query("SELECT accession, 'feed' AS source FROM f")
def first_wins_dedupe(s, d):
    a, b = numbered(s, d)
    return M.first_wins_dedupe(a.unionByName(b)).select("accession", "source")


@query("SELECT accession FROM f WHERE quarter >= '2001-Q1'")
def missing_accessions(s, d):
    rows = filings(s, d)
    return M.missing_accessions(rows, rows.filter("quarter < '2001-Q1'")).select("accession")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(o_orderdate AS DATE) = DATE '1996-06-30'")
def eligible_submissions(s, d):
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "13F-HR").when(F.col("o_orderpriority") == "2-HIGH", "13F-HR/A").otherwise("13F-NT")
    rows = read(s, d, "orders").select("o_orderkey", form.alias("form"), F.to_date("o_orderdate").alias("period"))
    return M.eligible_submissions(rows, "1996-Q2").select("o_orderkey")


@query("SELECT accession, CASE WHEN CAST(cik AS BIGINT) % 3 = 0 THEN cik ELSE fund_name END AS manager_name FROM f")
def manager_name_lookup(s, d):
    rows = filings(s, d).withColumn("cik", F.split("accession", "-")[0])
    cover = rows.select("accession", F.when(F.col("cik").cast("long") % 3 == 0, " ").otherwise(F.col("fund_name")).alias("manager_name"))
    return M.manager_name_lookup(rows, cover).select("accession", "manager_name")


@query("SELECT accession, CASE WHEN CAST(cik AS BIGINT) % 5 = 0 THEN cik ELSE fund_name END AS fund_name FROM f")
def filings_with_fund_name(s, d):
    known = funds(s, d).filter(F.col("cik").cast("long") % 5 != 0)
    return M.filings_with_fund_name(filings(s, d), known).select("accession", "fund_name")


@query("SELECT row_id, 'NO_CUSIP|' || upper(issuer) AS security_key, upper(issuer) AS issuer_search FROM h")
def holdings_with_security(s, d):
    rows = holdings(s, d)
    return M.holdings_with_security(rows, M.securities(rows)).select("row_id", "security_key", "issuer_search")


@query("SELECT cik, name, ticker FROM (SELECT CAST(s_suppkey AS VARCHAR) AS cik, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' NEW' ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'OLD' WHEN s_suppkey % 2 = 0 THEN 'NEW' END AS ticker FROM supplier)")
def upsert_funds(s, d):
    rows = read(s, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("cik"), F.col("s_name").alias("name"))
    stored = rows.withColumn("ticker", F.when(F.col("s_suppkey") % 4 == 0, "OLD")).drop("s_suppkey")
    new = rows.filter("s_suppkey % 2 = 0").withColumns({"name": F.concat("name", F.lit(" NEW")), "ticker": F.lit("NEW"), "position": F.lit(2)})
    older = new.withColumns({"name": F.lit("older"), "position": F.lit(1)})
    return M.upsert_funds(stored, new.unionByName(older).drop("s_suppkey"))


@query("SELECT accession, CASE WHEN quarter = '2001-Q3' THEN 'live' ELSE 'bulk' END AS source FROM f")
def upsert_filings(s, d):
    rows = filings(s, d).select("accession", F.lit("bulk").alias("source"), "quarter")
    new = rows.filter("quarter = '2001-Q3'").withColumns({"source": F.lit("live"), "position": F.lit(1)}).drop("quarter")
    return M.upsert_filings(rows.drop("quarter"), new)


@query("SELECT 'NO_CUSIP|' || upper(issuer) AS security_key, issuer FROM (SELECT DISTINCT issuer FROM h)")
def upsert_securities(s, d):
    rows = M.securities(holdings(s, d)).select("security_key", "issuer", "cusip")
    return M.upsert_securities(rows.filter("issuer < 'n'"), rows.withColumn("position", F.lit(1))).select("security_key", "issuer")


@query("SELECT quarter, count(*) AS n, round(sum(CASE WHEN quarter = '2001-Q3' THEN shares * 2 ELSE shares END), 2) AS shares FROM h GROUP BY 1")
def replace_holdings(s, d):
    rows = holdings(s, d)
    new = rows.filter("quarter = '2001-Q3'").withColumn("shares", F.col("shares") * 2)
    return tidy(M.replace_holdings(M.replace_holdings(rows, new), new).groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares")))


@query("SELECT DISTINCT issuer FROM h WHERE issuer NOT IN (SELECT issuer FROM h WHERE quarter = '2001-Q3' AND shares > 45)")
def orphan_rows(s, d):
    rows = holdings(s, d)
    return M.orphan_rows(rows.select("issuer").distinct(), rows.filter("quarter = '2001-Q3' and shares > 45"), "issuer")


@query("SELECT (SELECT count(*) FROM f WHERE quarter IN ('2001-Q3', '2001-Q2')) AS filings, (SELECT count(*) FROM h WHERE quarter IN ('2001-Q3', '2001-Q2')) AS holdings, (SELECT count(DISTINCT issuer) FROM h WHERE quarter IN ('2001-Q3', '2001-Q2')) AS securities")
def retain_quarters(s, d):
    rows = holdings(s, d)
    keyed = rows.withColumn("security_key", F.concat(F.lit("NO_CUSIP|"), F.upper("issuer")))
    a, b, c = M.retain_quarters(filings(s, d), keyed, M.securities(rows), ["2001-Q3", "2001-Q2"])
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return one(a, "filings").crossJoin(one(b, "holdings")).crossJoin(one(c, "securities"))  # each has one row


@query("SELECT (SELECT count(*) FROM f WHERE quarter = '2001-Q3') AS filings, (SELECT count(*) FROM h WHERE quarter = '2001-Q3') AS holdings, (SELECT count(*) FROM supplier WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT cik FROM f WHERE quarter <> '2001-Q3')) AS orphan_funds")
def trim_quarter(s, d):
    return M.trim_quarter(filings(s, d), holdings(s, d), funds(s, d), "2001-Q3")


@query("SELECT h.quarter, count(*) AS n FROM h JOIN lat USING (accession) GROUP BY 1")
def latest_only_migration(s, d):
    return M.latest_only_migration(filings(s, d), holdings(s, d))[1].groupBy("quarter").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT accession, 'NO_CUSIP' AS cusip, upper(issuer) AS issuer, round(sum(value), 5) AS value, round(sum(shares), 5) AS shares FROM h GROUP BY 1, 3")
def snapshot_dedupe(s, d):
    return tidy(M.snapshot_dedupe(holdings(s, d)), 5)


@query("SELECT accession, 'NO_CUSIP' AS cusip, upper(issuer) AS issuer, round(sum(shares) * CASE WHEN any_value(quarter) = '2001-Q3' THEN 2 ELSE 1 END, 2) AS shares FROM h WHERE quarter IN ('2001-Q3', '2001-Q2') GROUP BY 1, 3")
def snapshot_union(s, d):
    rows = holdings(s, d).filter("quarter in ('2001-Q3', '2001-Q2')")
    older = M.snapshot_dedupe(rows).withColumn("generated_at", F.lit(1))
    newer = M.snapshot_dedupe(rows.filter("quarter = '2001-Q3'")).withColumns({"shares": F.col("shares") * 2, "generated_at": F.lit(2)})
    return tidy(M.snapshot_union(older.unionByName(newer)).select("accession", "cusip", "issuer", "shares"))


@query("SELECT quarter, count(*) AS n FROM h WHERE quarter <= '2001-Q2' OR quarter = '2001-Q3' AND row_id NOT IN (SELECT row_id FROM h WHERE quarter <= '2001-Q2') GROUP BY 1")
def snapshot_merge_new(s, d):
    rows = holdings(s, d).select("row_id", "accession", "quarter")
    stored, new = rows.filter("quarter <= '2001-Q2'"), rows.filter("quarter in ('2001-Q2', '2001-Q3')")
    merged = M.snapshot_merge_new(stored, new, ["row_id"], None)
    return merged.groupBy("quarter").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT accession, filing_date, CASE WHEN quarter < '2001-Q3' THEN 'stored' ELSE 'live' END AS note FROM f ORDER BY filing_date DESC, accession LIMIT 250")
def feed_merge(s, d):
    rows = filings(s, d).select("accession", "filing_date", "quarter")
    live = rows.filter("quarter >= '2001-Q1'").withColumn("note", F.lit("live"))
    stored = rows.filter("quarter < '2001-Q3'").withColumn("note", F.lit("stored"))
    return M.feed_merge(live.drop("quarter"), stored.drop("quarter")).select("accession", "filing_date", "note")


@query("SELECT count(*) AS seen, count(*) FILTER (event_type = 'view') AS inserted, count(*) FILTER (event_type = 'click') AS skipped_existing, count(*) FILTER (event_type = 'signup') AS skipped_wrong_quarter, count(*) FILTER (event_type = 'purchase') AS skipped_no_holdings, count(*) FILTER (event_type = 'error') AS skipped_error, count(*) FILTER (event_type IN ('view', 'click')) AS matched FROM events")
def ingestion_counters(s, d):
    outcome = F.create_map(*[F.lit(x) for x in ("view", "inserted", "click", "skipped_existing", "signup", "skipped_wrong_quarter", "purchase", "skipped_no_holdings", "error", "skipped_error")])
    return M.ingestion_counters(read(s, d, "events").withColumn("outcome", outcome[F.col("event_type")]))


@query("SELECT quarter, source, id, any_success, CASE WHEN NOT any_success THEN 'full' WHEN status = 'completed' THEN 'incremental' ELSE 'refresh-existing' END AS mode FROM (SELECT 'Q' || CAST(user_id % 7 AS VARCHAR) AS quarter, event_type AS source, event_id AS id, CASE WHEN value > 80 THEN 'completed' ELSE 'failed' END AS status, bool_or(value > 80) OVER (PARTITION BY user_id % 7, event_type) AS any_success, row_number() OVER (PARTITION BY user_id % 7, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_run_status(s, d):
    runs = read(s, d, "events").select(F.concat(F.lit("Q"), (F.col("user_id") % 7).cast("string")).alias("quarter"), F.col("event_type").alias("source"), F.col("event_id").alias("id"), F.when(F.col("value") > 80, "completed").otherwise("failed").alias("status"), F.col("ts").alias("started_at"))
    return M.latest_run_status(runs).select("quarter", "source", "id", "any_success", "mode")


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT 'missing', count(*) FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0")
def report_quarter_distribution(s, d):
    return M.report_quarter_distribution(read(s, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("report_date")))


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END AS source, o_orderpriority AS form, CAST(date_trunc('month', o_orderdate) AS DATE) AS report_date, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4")
def verify_filings_breakdown(s, d):
    from filingscope.functions.columns import quarter_of_date

    rows = read(s, d, "orders").select(quarter_of_date("o_orderdate").alias("quarter"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("source"), F.col("o_orderpriority").alias("form"), F.to_date(F.trunc("o_orderdate", "month")).alias("report_date"))
    return M.verify_filings_breakdown(rows)


@query("SELECT quarter, count(DISTINCT accession) AS filings, count(DISTINCT cik) AS filers, CAST(sum(n) AS BIGINT) AS holdings FROM f LEFT JOIN (SELECT accession, count(*) AS n FROM h GROUP BY 1) USING (accession) GROUP BY 1")
def verify_quarter_totals(s, d):
    return M.verify_quarter_totals(filings(s, d), holdings(s, d))


@query("SELECT CAST(year(filing_date) AS VARCHAR) AS year, count(*) AS n FROM f GROUP BY 1")
def filing_year_distribution(s, d):
    return M.filing_year_distribution(filings(s, d))


@query("SELECT DISTINCT issuer FROM h")
def distinct_issuers(s, d):
    from filingscope.operators.documents import distinct_issuers

    return distinct_issuers(holdings(s, d))


@query("SELECT l_suppkey, CAST(l_suppkey AS VARCHAR) AS cik, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS padded FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey > 0)")
def normalize_cik(s, d):
    from filingscope.functions import columns as C

    rows = read(s, d, "lineitem").select("l_suppkey").distinct().filter("l_suppkey > 0")
    return rows.select("l_suppkey", C.normalize_cik(padded(F.col("l_suppkey"))).alias("cik"), C.pad_cik("l_suppkey").alias("padded"))


@query("""SELECT o_orderkey, CAST(year(d) AS VARCHAR) || '-Q' || CAST(quarter(d) AS VARCHAR) AS quarter, year(d) * 4 + quarter(d) AS sort_key, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
 CAST(year(d - INTERVAL 3 MONTH) AS VARCHAR) || '-Q' || CAST(quarter(date_trunc('quarter', d) - INTERVAL 1 DAY) AS VARCHAR) AS quarter_previous_odd, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY + INTERVAL 45 DAY AS DATE) AS deadline FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""".replace("CAST(year(d - INTERVAL 3 MONTH) AS VARCHAR)", "CAST(year(date_trunc('quarter', d) - INTERVAL 1 DAY) AS VARCHAR)").replace("quarter_previous_odd", "previous"))
def quarter_calendar(s, d):
    from filingscope.functions import columns as C

    q = C.quarter_of_date("o_orderdate")
    return read(s, d, "orders").select("o_orderkey", q.alias("quarter"), C.quarter_sort_key(q).alias("sort_key"), C.quarter_end(q).alias("quarter_end"), C.quarter_previous(q).alias("previous"), C.filing_deadline(q).alias("deadline"))


@query("SELECT row_id, round(CASE WHEN value <= 0 THEN 0 WHEN shares <= 0 THEN value WHEN abs(value / shares) > 4 THEN value ELSE value * 1000 END, 2) AS actual FROM h")
def estimate_actual_value(s, d):
    from filingscope.functions import columns as C

    return holdings(s, d).select("row_id", F.round(C.estimate_actual_value("value", "shares"), 2).alias("actual"))


@query("SELECT o_orderkey, o_orderdate IS NOT NULL AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND contains(upper(o_orderpriority), 'HIGH') AS hit FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND contains(o_orderpriority, 'HIGH')")
def filing_date_form_filter(s, d):
    from filingscope.operators.signals import filing_date_form_filter

    rows = read(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderpriority").alias("form"))
    return filing_date_form_filter(rows, "1996-01-01", "1997-06-30", "high").select("o_orderkey", F.lit(True).alias("hit"))
