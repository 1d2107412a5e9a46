"""Queries over documents that Spark builds from the given tables: sources, exposure, offerings, streams' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.operators import exposure as X, offerings as O
from filingscope.operators.audit import audit_export_tables
from filingscope.plans.fixtures import SECTORS, filings, holdings, radar, read, with_sql
from filingscope.plans.radar_queries import tidy
from filingscope.sources import filings as SRC
from filingscope.streaming import alerts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, cte: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_sql(sql) if cte else sql
        return f

    return add


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("SELECT cik, accession, filing_date FROM f WHERE CAST(cik AS BIGINT) % 2 = 0")
def scan_master_index(s, d):
    form = F.when(F.split("accession", "-")[0].cast("long") % 2 == 0, "13F-HR").otherwise("10-K")
    acc = F.regexp_replace("accession", "-", "")
    lines = filings(s, d).select(F.concat_ws("|", F.split("accession", "-")[0], F.coalesce("fund_name", F.lit("x")), form, F.col("filing_date").cast("string"), text("edgar/data/", F.lpad(acc, 18, "0"), ".txt")).alias("value"))
    out = SRC.parse_master_index(lines)
    return out.select("cik", F.concat_ws("-", "cik", F.substring(F.col("accession"), -6, 6)).alias("accession"), "filing_date")


@query("SELECT DISTINCT cik, accession, filing_date FROM f")
def scan_current_feed(s, d):
    key = F.split("accession", "-")[0]
    entry = text("<entry><title>13F-HR - ", F.coalesce("fund_name", F.lit("x")), " (", key, ") (Filer)</title><link rel=\"alternate\" href=\"https://x/", F.lpad(F.regexp_replace("accession", "-", ""), 18, "0"), "-index.htm\"/><summary>&lt;b&gt;Filed:&lt;/b&gt; ", F.col("filing_date").cast("string"), "</summary></entry>")
    page = F.pmod(F.xxhash64("accession"), F.lit(1 << 20))  # a feed's page has a few entries, however many there are
    feeds = filings(s, d).groupBy("quarter", page.alias("page")).agg(F.array_join(F.collect_list(entry), "\n").alias("value"))
    out = feeds.select(F.explode(SRC.parse_current_feed(F.col("value"))).alias("e"))
    return out.select("e.cik", F.concat_ws("-", "e.cik", F.regexp_extract("e.file", r"(\d{6})-index", 1)).alias("accession"), F.to_date("e.date").alias("filing_date"))


def xml(s, d):
    """Each filing's information table as XML with a namespace prefix."""
    row = text("<n1:infoTable><n1:nameOfIssuer>", F.col("issuer"), "</n1:nameOfIssuer><n1:value>", F.format_number("value", 5), "</n1:value><n1:shrsOrPrnAmt><n1:sshPrnamt>", F.col("shares").cast("string"), "</n1:sshPrnamt><n1:sshPrnamtType>SH</n1:sshPrnamtType></n1:shrsOrPrnAmt>", F.coalesce(text("<n1:putCall>", F.col("putcall"), "</n1:putCall>"), F.lit("")), "</n1:infoTable>")
    return holdings(s, d).groupBy("accession").agg(text('<?xml version="1.0"?><n1:informationTable xmlns:n1="urn:x"><n1:periodOfReport>06-30-2001</n1:periodOfReport>', F.array_join(F.collect_list(row), ""), "</n1:informationTable>").alias("xml"))


@query("SELECT accession, upper(issuer) AS issuer, putcall, '2001-06-30' AS report_date, count(*) AS n, round(sum(value), 5) AS value, round(sum(shares), 2) AS shares FROM h GROUP BY 1, 2, 3")
def scan_13f_xml(s, d):
    out = SRC.scan_13f_xml(xml(s, d), ["accession"])
    return out.groupBy("accession", "issuer", "putcall", "report_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("value"), F.round(F.sum("shares"), 2).alias("shares"))


@query("SELECT accession, '2001-06-30' AS report_date, count(*) AS n, round(sum(shares), 2) AS shares FROM h GROUP BY 1")
def scan_13f_submission_text(s, d):
    docs = xml(s, d).select("accession", text("<SEC-DOCUMENT>\n<XML>\n<edgarSubmission><periodOfReport>06-30-2001</periodOfReport></edgarSubmission>\n</XML>\n<XML>\n", F.col("xml"), "\n</XML>\n").alias("text"))
    return SRC.scan_13f_submission_text(docs, ["accession"]).groupBy("accession", "report_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("shares"), 2).alias("shares"))


@query("SELECT accession, issuer AS name, count(*) AS n, round(sum(shares), 2) AS balance FROM h WHERE contains(issuer, 'red') OR contains(issuer, 'anvil') GROUP BY 1, 2")
def scan_nport_xml(s, d):
    row = text("<invstOrSec><name>", F.col("issuer"), "</name><title>N/A</title><balance>", F.col("shares").cast("string"), "</balance></invstOrSec>")
    docs = holdings(s, d).groupBy("accession").agg(text("<edgarSubmission><genInfo><regName>R</regName><seriesName>S</seriesName></genInfo><invstOrSecs>", F.array_join(F.collect_list(row), ""), "</invstOrSecs></edgarSubmission>").alias("xml"))
    return SRC.scan_nport_xml(docs, ["accession"], ["RED", "ANVIL"]).groupBy("accession", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT CAST(user_id AS VARCHAR) AS insider, CASE WHEN event_type = 'purchase' THEN 'A' ELSE 'D' END AS code, 'Director' AS title, count(*) AS n, round(sum(round(value, 2) * 2), 1) AS value FROM events GROUP BY 1, 2", cte=False)
def scan_form4_xml(s, d):
    v = lambda tag, x: text(f"<{tag}><value>", x, f"</value></{tag}>")
    row = text("<nonDerivativeTransaction>", v("transactionDate", F.to_date("ts").cast("string")), "<transactionAmounts>", v("transactionShares", F.round("value", 2).cast("string")), v("transactionPricePerShare", F.lit("2")), v("transactionAcquiredDisposedCode", F.when(F.col("event_type") == "purchase", "A").otherwise("D")), "</transactionAmounts></nonDerivativeTransaction>")
    docs = read(s, d, "events").groupBy("user_id").agg(text("<ownershipDocument><issuer><issuerTradingSymbol>X</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>", F.col("user_id").cast("string"), "</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable>", F.array_join(F.collect_list(row), ""), "</nonDerivativeTable></ownershipDocument>").alias("xml"))
    return SRC.scan_form4_xml(docs, ["user_id"]).groupBy("insider", "code", "title").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 1).alias("value"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS cik, s_name AS title, 'T' || s_suppkey AS ticker FROM supplier", cte=False)
def scan_company_tickers(s, d):
    rows = read(s, d, "supplier").select(F.to_json(F.create_map(F.col("s_suppkey").cast("string"), F.struct(F.col("s_suppkey").alias("cik_str"), text("T", F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("title")))).alias("json"))
    return SRC.scan_company_tickers(rows).select("cik", "title", "ticker")


@query("SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(o_orderkey AS VARCHAR) AS accession, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS filing_date FROM orders", cte=False)
def scan_submissions(s, d):
    arrays = [F.collect_list(x).alias(n) for n, x in (("accessionNumber", F.col("o_orderkey").cast("string")), ("form", F.col("o_orderpriority")), ("filingDate", F.to_date("o_orderdate").cast("string")), ("reportDate", F.lit("")), ("primaryDocument", F.lit("d.htm")))]
    rows = read(s, d, "orders").groupBy("o_custkey").agg(F.struct(*arrays).alias("recent"))
    docs = rows.select("o_custkey", F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.lit("n").alias("name"), F.struct("recent").alias("filings"))).alias("json"))
    return SRC.scan_submissions(docs, ["o_custkey"]).select("cik", "accession", "form", "filing_date")


@query("SELECT CAST(o_custkey AS VARCHAR) AS cik, 'C' || o_orderkey % 3 AS concept, 'USD' AS unit, CAST(o_orderdate AS DATE) AS \"end\", o_totalprice AS val FROM orders", cte=False)
def scan_company_facts(s, d):
    rows = read(s, d, "orders").groupBy("o_custkey", text("C", (F.col("o_orderkey") % 3).cast("string")).alias("concept")).agg(F.collect_list(F.struct(F.to_date("o_orderdate").cast("string").alias("end"), F.col("o_totalprice").alias("val"))).alias("f"))
    per = rows.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.create_map(F.lit("USD"), "f").alias("units"))))).alias("m"))
    docs = per.select("o_custkey", F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.struct(F.col("m").alias("us-gaap")).alias("facts"))).alias("json"))
    return SRC.scan_company_facts(docs, ["o_custkey"]).select("cik", "concept", "unit", "end", "val")


def hits(s, d):
    row = F.struct(text(F.col("page_id").cast("string"), ":d.htm").alias("_id"), F.struct(F.array(F.col("page_id").cast("string")).alias("ciks"), F.array(F.regexp_extract("url", r"//([^/]+)", 1)).alias("display_names"), F.when(F.col("page_id") % 3 == 0, "13F-HR").when(F.col("page_id") % 3 == 1, "NPORT-P").otherwise("8-K").alias("form"), F.lit("2001-06-30").alias("file_date"), F.lit("2001-03-31").alias("period_ending"), F.col("page_id").cast("string").alias("adsh")).alias("_source"))
    docs = read(s, d, "pages").groupBy(F.floor(F.col("page_id") / 100).alias("k")).agg(F.to_json(F.struct(F.struct(F.collect_list(row).alias("hits")).alias("hits"))).alias("json"))
    return SRC.scan_search_hits(docs, ["k"]).drop("k")


@query("SELECT CAST(page_id AS VARCHAR) AS accession, 'd.htm' AS document, regexp_extract(url, '//([^/]+)', 1) AS filer FROM pages", cte=False)
def scan_search_hits(s, d):
    return hits(s, d).select("accession", "document", "filer")


@query("SELECT CAST(page_id AS VARCHAR) AS accession, CASE page_id % 3 WHEN 0 THEN '13F-HR' WHEN 1 THEN 'NPORT-P' ELSE '8-K' END AS form FROM pages ORDER BY CASE page_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 4 END, regexp_extract(url, '//([^/]+)', 1), page_id LIMIT 1000000", cte=False)
def search_hits_ranked(s, d):
    rows = hits(s, d).withColumn("matched_terms", F.array(F.lit("a")))
    return X.search_hits_ranked(rows.unionByName(rows)).select("accession", "form")


@query("SELECT CAST(page_id AS VARCHAR) AS accession, 'a; b' AS terms FROM pages", cte=False)
def dedupe_search_hits(s, d):
    rows = hits(s, d)
    return X.dedupe_search_hits(rows.withColumn("matched_terms", F.array(F.lit("b"))).unionByName(rows.withColumn("matched_terms", F.array(F.lit("a"), F.lit("b"))))).select("accession", F.concat_ws("; ", "matched_terms").alias("terms"))


_ALIASES, _CONTEXT = ["the entire", "disgusting"], ["apache license"]
_CLEAN = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_MATCH = f"(SELECT doc_id, text, source, contains({_CLEAN}, 'the entire') AS a, contains({_CLEAN}, 'disgusting') AS b, contains({_CLEAN}, 'apache license') AS c FROM documents)"


@query(f"SELECT doc_id, concat_ws('; ', CASE WHEN a THEN 'the entire' END, CASE WHEN b THEN 'disgusting' END, CASE WHEN c THEN 'apache license' END) AS terms FROM {_MATCH} WHERE a OR b OR c", cte=False)
def exposure_term_match(s, d):
    return X.exposure_term_match(read(s, d, "documents"), _ALIASES, _CONTEXT).select("doc_id", F.concat_ws("; ", "matched_terms").alias("terms"))


_PAIRS = "SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark))"


@query(f"SELECT doc_id, term FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents) JOIN ({_PAIRS}) ON contains(t, term)", cte=False)
def exposure_terms(s, d):
    """All pairs of neighbouring words of all test items, looked up in all documents."""
    words = F.split(X.plain(F.col("text")), " ")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    terms = read(s, d, "benchmark").select(words.alias("w")).filter(F.size("w") > 1).select(F.explode(pairs).alias("term")).distinct()
    return X.exposure_terms(read(s, d, "documents"), terms, ["doc_id"])


_RX = lambda p: "regexp_matches(text, '" + p.replace("'", "''") + "')"


@query(f"SELECT doc_id, CASE WHEN NOT (a OR b) AND c THEN 'commercial_context' WHEN {_RX(X.HOLDING)} AND {_RX(X.VALUE)} THEN 'portfolio_schedule_holding' WHEN {_RX(X.COMMERCIAL)} THEN 'commercial_context' WHEN {_RX(X.FUND)} THEN 'spv_or_fund_name' ELSE 'ambiguous_review' END AS relation FROM {_MATCH}", cte=False)
def exposure_classify(s, d):
    return read(s, d, "documents").select("doc_id", X.exposure_classify(F.col("text"), _ALIASES, _CONTEXT).alias("relation"))


def landed(s, d):
    return read(s, d, "pages").select(F.col("page_id").cast("string").alias("accession"), F.lit("d.htm").alias("document"), "html")


@query()
def exposure_parse_documents(s, d):
    return X.exposure_parse_documents(landed(s, d), ["accession", "document"], ["the", "de la"], ["und"])


@query()
def exposure_radar(s, d):
    return X.exposure_radar(hits(s, d).withColumn("matched_terms", F.array(F.lit("the"))), landed(s, d), ["the", "de la"], ["und"])


def exposed(s, d):
    kind = F.element_at(F.array(*map(F.lit, X.RELATIONS)), (F.col("event_id") % 6 + 1).cast("int"))
    return read(s, d, "events").select(F.col("event_id").cast("string").alias("accession"), F.lit("d").alias("document"), kind.alias("relation"), F.col("event_type").alias("form"), F.col("user_id").cast("string").alias("filer"), F.to_date("ts").alias("filing_date"), F.round("value", 2).alias("confidence"), F.col("event_type").alias("security_name"), F.col("props").alias("snippet"), F.array("event_type").alias("matched_terms"), F.when(F.col("event_id") % 7 == 0, "review").alias("status"))


_EXP = "(SELECT *, ['direct_holding', 'portfolio_schedule_holding', 'ambiguous_review', 'spv_or_fund_name', 'commercial_context', 'false_positive'][event_id % 6 + 1] AS relation FROM events)"


@query(f"SELECT count(*) AS rows, count(*) FILTER (relation IN ('direct_holding', 'portfolio_schedule_holding')) AS holdings, count(*) FILTER (relation = 'commercial_context') AS commercial, count(*) FILTER (relation IN ('ambiguous_review', 'spv_or_fund_name')) AS review, count(DISTINCT user_id) AS filers FROM {_EXP}", cte=False)
def exposure_summary(s, d):
    return X.exposure_summary(exposed(s, d))


@query("SELECT event_type AS form, count(*) AS n FROM events GROUP BY 1", cte=False)
def exposure_coverage(s, d):
    return X.exposure_coverage(exposed(s, d))


@query(f"SELECT CAST(event_id AS VARCHAR) AS accession, relation FROM {_EXP}", cte=False)
def exposure_ranked(s, d):
    return X.exposure_ranked(exposed(s, d)).select("accession", "relation")


@query(f"SELECT CAST(event_id AS VARCHAR) AS accession, relation, event_type AS terms, round(value, 2) AS confidence FROM {_EXP}", cte=False)
def dedupe_exposure_rows(s, d):
    rows = exposed(s, d)
    return X.dedupe_exposure_rows(rows.unionByName(rows.withColumn("confidence", F.lit(-1.0)))).select("accession", "relation", F.concat_ws("; ", "matched_terms").alias("terms"), "confidence")


@query(f"SELECT 'holdings' AS subset, count(*) AS n FROM {_EXP} WHERE relation IN ('direct_holding', 'portfolio_schedule_holding') UNION ALL SELECT 'review', count(*) FROM {_EXP} WHERE relation IN ('ambiguous_review', 'spv_or_fund_name') OR event_id % 7 = 0 UNION ALL SELECT 'commercial', count(*) FROM {_EXP} WHERE relation = 'commercial_context' UNION ALL SELECT '13f', 0", cte=False)
def exposure_subset_filters(s, d):
    sets = X.exposure_subset_filters(exposed(s, d))
    return X.union_all([t.agg(F.lit(name).alias("subset"), F.count(F.lit(1)).alias("n")) for name, t in sets.items()])


@query(f"SELECT 'Holdings' AS sheet, count(*) AS n FROM {_EXP} WHERE relation IN ('direct_holding', 'portfolio_schedule_holding') UNION ALL SELECT 'Narrative', count(*) FROM {_EXP} WHERE relation NOT IN ('direct_holding', 'portfolio_schedule_holding') UNION ALL SELECT '13F Check', 0 UNION ALL SELECT 'Reviewed', count(*) FROM {_EXP} WHERE event_id % 7 = 0", cte=False)
def exposure_export_tables(s, d):
    return X.union_all([t.agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("n")) for name, t in X.exposure_export_tables(exposed(s, d)).items()])


@query("SELECT row_id, issuer, round(value * 1000, 2) AS value, 0.9 AS confidence FROM h WHERE contains(issuer, 'red widget') OR contains(issuer, 'gear')")
def exposure_parse_13f(s, d):
    out = X.exposure_parse_13f(holdings(s, d), ["red widget", "gear"])
    return tidy(out.select("row_id", "issuer", "value", "confidence"))


@query("SELECT 'Read Me' AS sheet, 4 AS n UNION ALL SELECT 'Coverage', 1 UNION ALL SELECT 'Category Trends', (SELECT count(DISTINCT category) FROM al) UNION ALL SELECT 'Filer Security Audit', least(1000, (SELECT count(*) FROM sp)) UNION ALL SELECT 'Security Movements', least(1000, (SELECT count(*) FROM (SELECT DISTINCT category, security FROM sp)))")
def audit_export_tables_query(s, d):
    sheets = audit_export_tables(radar(s, d).materialise(), SECTORS, "metal")
    return X.union_all([sheets[name].agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("n")) for name in ("Read Me", "Coverage", "Category Trends", "Filer Security Audit", "Security Movements")])


QUERIES["audit_export_tables"], ORACLES["audit_export_tables"] = QUERIES.pop("audit_export_tables_query"), ORACLES.pop("audit_export_tables_query")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'IPO' WHEN doc_id % 3 = 1 THEN 'Uplisting' ELSE 'Secondary' END AS offering_type, CASE WHEN doc_id % 3 < 2 THEN 'ABCD' END AS symbol, 5000000.0 AS shares_offered, 10.0 AS price_low, 12.0 AS price_high, '$50.0M - $60.0M' AS deal FROM documents", cte=False)
def ipo_deal_size(s, d):
    return O.ipo_deal_size(offered(s, d)).select("doc_id", "offering_type", "symbol", "shares_offered", "price_low", "price_high", "deal")


def offered(s, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "This is the initial public offering of shares.").when(F.col("doc_id") % 3 == 1, "We are offering shares.").otherwise("Holders sell.")
    name = F.when(F.col("doc_id") % 3 < 2, " They list on the NYSE American under the symbol 'ABCD'.").otherwise("")
    rows = read(s, d, "documents").select("doc_id", text(kind, name, " An offering of 5,000,000 ordinary shares at between $10.00 and $12.00 per share. Goldstone Partners acts as underwriter. ", F.col("text")).alias("text"))
    return O.ipo_terms(rows, ["doc_id"], ["Goldstone Partners"])


#: Phrases of offerings and what they say: exchange, shares offered and outstanding, prices and their form.
_PHRASES = [
    ("We have applied to list our units on the Nasdaq Capital Market. 20,000,000 units at $10.00 per unit. The founder shares will represent 20% of the outstanding shares.", "Nasdaq Capital Market", "20000000", "25000000", "10", "10", "$10.00 / Unit"),
    ("We compete with New York Stock Exchange members. Shares of our Class A common stock offered by us 4,500,000. THE OFFERING Shares of Class B common stock offered by us: 3,000,000 at an assumed offering price of $5.50 per share.", None, "3000000", None, "5.5", "5.5", "$5.50"),
    ("The closing price was $3.25 on the NYSE American under the symbol XYZW. 1,250,000 shares of Class A common stock. Total Class A common stock to be outstanding after this offering: 62,942,998 shares.", "NYSE American", "1250000", "62942998", "3.25", "3.25", "$3.25 (Last Close)"),
    ("Listed on the New York Stock Exchange at a proposed maximum price of $7 each. Number of shares to be sold: 800,000 shares. 9,000,000 shares of common stock outstanding after the offering.", "New York Stock Exchange", "800000", "9000000", "7", "7", "$7"),
    ("A par value price of $0.01 a share.", None, None, None, None, None, None),
    ("In a range of $14 and $16.5 a share.", None, None, None, "14", "16.5", "$14 - $16.5"),
]
_SAID = ", ".join(f"({i}, " + ", ".join("NULL" if x is None else f"'{x}'" if at in (0, 5) else f"CAST({x} AS DOUBLE)" for at, x in enumerate(p[1:])) + ")" for i, p in enumerate(_PHRASES))


@query(f"SELECT doc_id, exchange, shares_offered, shares_outstanding, price_low, price_high, price_range FROM documents JOIN (VALUES {_SAID}) x (k, exchange, shares_offered, shares_outstanding, price_low, price_high, price_range) ON doc_id % 6 = k", cte=False)
def ipo_terms_phrases(s, d):
    """Each document with one of several phrasings before its text."""
    phrase = F.element_at(F.array(*[F.lit(p[0]) for p in _PHRASES]), (F.col("doc_id") % 6 + 1).cast("int"))
    terms = O.ipo_terms(read(s, d, "documents").select("doc_id", text(phrase, "\n\n", F.col("text")).alias("text")), ["doc_id"], [])
    return terms.select("doc_id", "exchange", "shares_offered", "shares_outstanding", "price_low", "price_high", "price_range")


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'NYSE American' END AS exchange, 'Goldstone Partners' AS underwriters FROM documents", cte=False)
def ipo_terms(s, d):
    return offered(s, d).select("doc_id", "exchange", F.concat_ws("; ", "underwriters").alias("underwriters"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'IPO' ELSE 'Secondary' END AS offering_type FROM documents", cte=False)
def ipo_offering_type(s, d):
    body = text(F.when(F.col("doc_id") % 2 == 0, "This is  our initial public\noffering. ").otherwise(""), F.col("text"))
    return read(s, d, "documents").select("doc_id", O.ipo_offering_type(body).alias("offering_type"))


@query("SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) * 1000 AS revenue, CAST(-s_suppkey AS DOUBLE) * 1000 AS net_income, CAST(s_suppkey + 5 AS DOUBLE) * 1000000 AS total_assets FROM supplier WHERE s_suppkey > 0", cte=False)
def ipo_financials(s, d):
    """An income statement in thousands between a footnote that scores and a balance sheet in millions."""
    k = F.col("s_suppkey").cast("string")
    html = text(
        "<table><tr><td>revenue, net income and gross profit are explained below</td><td>7</td></tr></table>",
        "<table><tr><th>(in thousands)</th></tr><tr><td>Total revenue</td><td>$</td><td>", k, "</td><td>1</td></tr><tr><td>Operating expenses</td><td>9</td></tr><tr><td>Net loss</td><td>(", k, ")</td></tr></table>",
        "<p>in millions</p><table><tr><td>Cash</td><td>3</td></tr><tr><td>Total assets</td><td>$", (F.col("s_suppkey") + 5).cast("string"), "</td></tr><tr><td>Total liabilities and net income, revenue</td><td>2</td></tr></table>",
    )
    rows = read(s, d, "supplier").filter("s_suppkey > 0").select("s_suppkey", html.alias("html"))
    return O.ipo_financials(rows, ["s_suppkey"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'Unknown' ELSE 'ALPHA HOLDINGS' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) END AS reporting_person, CASE WHEN s_suppkey % 7 = 0 THEN 'N/A' ELSE CAST(s_suppkey % 90 + 1 AS VARCHAR) || '.5%' END AS percent_of_class, CAST(s_suppkey + 1000 AS VARCHAR) AS shares, CASE WHEN s_suppkey % 3 = 0 THEN repeat('hold on ', 37) || 'hold...' WHEN s_suppkey % 3 = 1 THEN 'To hold.' ELSE 'See filing for details.' END AS purpose FROM supplier", cte=False)
def activist_extract(s, d):
    k = F.col("s_suppkey")
    person = F.when(k % 5 != 0, text("NAME OF REPORTING PERSONS: ALPHA HOLDINGS", F.chr(65 + k % 26), "  I.R.S IDENTIFICATION ")).otherwise("")
    percent = F.when(k % 7 != 0, text(" PERCENT OF CLASS REPRESENTED BY AMOUNT IN ROW ", (k % 90 + 1).cast("string"), F.when(k % 2 == 0, ".5%").otherwise(".5"))).otherwise("")
    purpose = F.when(k % 3 == 0, text(" Item 4. Purpose of Transaction ", F.repeat(F.lit("hold on "), F.lit(50)), " Item 5")).when(k % 3 == 1, " Item 4. Purpose of Transaction To\n hold. SIGNATURE").otherwise("")
    body = text(person, "AGGREGATE AMOUNT BENEFICIALLY OWNED BY EACH ", (k + 1000).cast("string"), percent, purpose)
    return O.activist_extract(read(s, d, "supplier").select("s_suppkey", body.alias("text")), ["s_suppkey"])


def feed(s, d):
    return read(s, d, "events").select(F.col("event_id").cast("string").alias("accession"), F.col("event_type").alias("form"), F.col("user_id").cast("string").alias("ticker"), F.col("ts").alias("filed_at"))


@query("SELECT CAST(event_id AS VARCHAR) AS accession FROM events WHERE contains(upper(event_type), 'PURCHASE') AND ts >= (SELECT max(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 7 DAY", cte=False)
def new_filing_alerts(s, d):
    rows = feed(s, d)
    return alerts.new_filing_alerts(rows.unionByName(rows), "purchase", 7).select("accession")


@query("SELECT CAST(event_id AS VARCHAR) AS accession, CAST(user_id AS VARCHAR) AS ticker FROM events WHERE user_id % 3 = 0 AND event_type IN ('view', 'click')", cte=False)
def followed_filings(s, d):
    rows = feed(s, d)
    follows = rows.filter(F.col("ticker").cast("long") % 3 == 0).select("ticker").distinct().withColumn("forms", F.array(F.lit("view"), F.lit("click")))
    return alerts.followed_filings(rows.unionByName(rows), follows).select("accession", "ticker")


@query("SELECT quarter, count(*) AS n FROM h WHERE quarter < '2001-Q3' OR quarter = '2001-Q3' GROUP BY 1")
def incremental_ingest(s, d):
    rows = holdings(s, d).select("row_id", "accession", "quarter", "shares")
    stored = rows.filter("quarter < '2001-Q3'")
    once = alerts.incremental_ingest(rows, stored, "2001-Q3")
    return alerts.incremental_ingest(rows, once, "2001-Q3").groupBy("quarter").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS theme, count(*) AS n, count(DISTINCT event_id) AS filings FROM events GROUP BY 1 UNION ALL SELECT 'shared', count(*), count(*) FROM events", cte=False)
def incremental_theme_append(s, d):
    """Each filing has two themes; those of some are stored; the batch comes twice."""
    rows = feed(s, d).select("accession", F.explode(F.array("form", F.lit("shared"))).alias("theme"))
    stored = rows.join(rows.filter("theme < 'p'").select("accession").distinct(), "accession", "left_semi")
    once = alerts.incremental_theme_append(rows.unionByName(rows), stored)
    return once.groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("accession").alias("filings"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS accession, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'old' END AS note FROM orders WHERE o_orderstatus <> 'O' UNION ALL (SELECT CAST(o_orderkey AS VARCHAR), 'new' FROM orders WHERE o_orderstatus = 'O' ORDER BY CAST(o_orderdate AS DATE) DESC, CAST(o_orderkey AS VARCHAR) LIMIT 25)", cte=False)
def incremental_ipo_enrich(s, d):
    rows = read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("accession"), F.to_date("o_orderdate").alias("filing_date"), "o_orderstatus")
    stored = rows.filter("o_orderstatus <> 'O'").drop("o_orderstatus").withColumn("note", F.lit("old"))
    return alerts.incremental_ipo_enrich(rows.drop("o_orderstatus"), stored, lambda x: x.withColumn("note", F.lit("new"))).select("accession", "note")
