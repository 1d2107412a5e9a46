"""Scalar rules over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.functions import columns as C
from filingscope.plans.fixtures import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def part(s, d):
    return read(s, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" & Co. ")).alias("name"), "p_size", "p_retailprice")


@query("SELECT p_partkey, upper(p_name) || ' AND CO' AS normalized, replace(upper(p_name), ' ', '') || 'ANDCO' AS compact, upper(p_name) || ' & CO.' AS stored, 'NO_CUSIP|' || upper(p_name) || ' & CO.' AS security_key FROM part")
def normalize_issuer(s, d):
    none = F.lit(None).cast("string")
    return part(s, d).select("p_partkey", C.normalize_issuer("name").alias("normalized"), C.compact_issuer("name").alias("compact"), C.storage_issuer("name").alias("stored"), C.security_key(none, F.col("name")).alias("security_key"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p <= 0 AND c <= 0 THEN 'absent' WHEN p <= 0 THEN 'initiated' WHEN c <= 0 THEN 'liquidated' WHEN c > p THEN 'increased' WHEN c < p THEN 'decreased' ELSE 'unchanged' END AS movement, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN c > 0 THEN 'no_prior' ELSE 'absent' END WHEN p <= 0 AND c <= 0 THEN 'absent' WHEN p <= 0 THEN 'initiated' WHEN c <= 0 THEN 'liquidated' WHEN c > p THEN 'increased' WHEN c < p THEN 'decreased' ELSE 'unchanged' END AS reverse FROM (SELECT *, l_quantity - 25 AS c, CAST(l_linenumber * 7 - 20 AS DOUBLE) AS p FROM lineitem)")
def classify_movement(s, d):
    rows = read(s, d, "lineitem").withColumns({"c": F.col("l_quantity") - 25, "p": (F.col("l_linenumber") * 7 - 20).cast("double")})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.classify_movement("p", "c").alias("movement"), C.classify_reverse_movement(F.when(F.col("l_linenumber") % 3 != 0, F.col("p")), F.col("c")).alias("reverse"))


@query("SELECT o_orderkey, CASE WHEN k > 0 THEN 'https://www.sec.gov/Archives/edgar/data/' || k || '/' || lpad(CAST(o_orderkey AS VARCHAR), 18, '0') || '/' END AS folder, regexp_replace(lpad(CAST(o_orderkey AS VARCHAR), 18, '0'), '^(.{10})(.{2})(.{6})$', '\\1-\\2-\\3') AS accession FROM (SELECT *, o_custkey AS k FROM orders)")
def sec_urls(s, d):
    acc = C.format_accession(F.lpad(F.col("o_orderkey").cast("string"), 18, "0"))
    return read(s, d, "orders").select("o_orderkey", C.sec_folder_url(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), acc).alias("folder"), acc.alias("accession"))


@query("SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DOUBLE) AS amount, CASE WHEN contains(upper(o_orderpriority), 'HIGH') THEN true ELSE false END AS matches, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 4 END AS rank FROM orders")
def parse_number(s, d):
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "13F-HR").otherwise(F.col("o_orderpriority"))
    return read(s, d, "orders").select("o_orderkey", C.parse_number(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("amount"), C.form_matches("o_orderpriority", "high").alias("matches"), C.form_fetch_rank(form).alias("rank"))


@query("SELECT p_partkey, CASE WHEN p_size * 100 >= 2500 THEN 'Highly concentrated' WHEN p_size * 100 >= 1500 THEN 'Moderately concentrated' ELSE 'Unconcentrated' END AS label, left(md5(p_name), 8) || '_chunk_' || p_size AS chunk_id, CASE WHEN p_size > 0 THEN 100.0 ELSE 0 END AS pct, CASE WHEN p_size > 20 THEN -100.0 WHEN p_size > 0 THEN 0 ELSE 0 END AS change FROM part")
def hhi_label(s, d):
    rows = read(s, d, "part")
    return rows.select("p_partkey", C.hhi_label(F.col("p_size") * 100).alias("label"), C.chunk_id("p_name", "p_size").alias("chunk_id"), C.pct1("p_size", "p_size").alias("pct"), C.percent_change_tracker("p_size", F.when(F.col("p_size") > 20, 0).otherwise(F.col("p_size"))).alias("change"))


@query("SELECT o_orderkey, CASE WHEN month(d) % 3 = 0 THEN CAST(year(d) AS VARCHAR) || '-Q' || quarter(d) ELSE NULL END AS from_dmy, CAST(d AS VARCHAR) AS iso, CAST(year(q) AS VARCHAR) || '-Q' || quarter(q) AS completed FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY AS q FROM orders)")
def quarter_from_dmy(s, d):
    text = F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    return read(s, d, "orders").select("o_orderkey", C.quarter_from_dmy(text).alias("from_dmy"), C.normalize_sec_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("iso"), C.latest_completed_quarter("o_orderdate").alias("completed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE year(d) END AS year, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE quarter(d) END AS quarter, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(year(d + INTERVAL 3 MONTH) AS VARCHAR) || '-Q' || quarter(d + INTERVAL 3 MONTH) END AS due FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def quarter_parse(s, d):
    rows = read(s, d, "orders").withColumn("q", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q5"))).otherwise(C.quarter_of_date("o_orderdate")))
    return rows.select("o_orderkey", *[F.when(C.quarter_valid("q"), F.substring("q", at, n).cast("int")).alias(name) for name, at, n in (("year", 1, 4), ("quarter", 7, 1))], C.filing_index_quarter("q").alias("due"))


QUERIES["filing_index_quarter"], ORACLES["filing_index_quarter"] = QUERIES["quarter_parse"], ORACLES["quarter_parse"]


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p > 0 THEN round((l_quantity - p) / p * 100, 6) WHEN l_quantity > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS change FROM (SELECT *, CAST(l_linenumber * 7 - 20 AS DOUBLE) AS p FROM lineitem)")
def share_pct_change(s, d):
    rows = read(s, d, "lineitem").withColumn("p", (F.col("l_linenumber") * 7 - 20).cast("double"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", C.round_double(C.share_pct_change("p", "l_quantity"), 6).alias("change"))


@query("SELECT o_orderkey, upper(o_orderpriority) AS form, upper(o_orderpriority) || '; 10-K' AS forms, o_orderpriority || '|b c' AS parts FROM orders")
def strip_amendment(s, d):
    """Forms with and without an amendment's ending, and lists of them by three separators."""
    amended = F.concat(F.lit(" "), F.lower("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "/a ").otherwise(""))
    both = F.array(amended, F.lit("10-K/A"), F.lit(" "), F.lit("10-k"))
    mark = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\n")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    listed = F.concat(F.col("o_orderpriority"), mark, F.lit("  "), mark, F.lit(" b c "))
    return read(s, d, "orders").select("o_orderkey", C.strip_amendment(amended).alias("form"), F.concat_ws("; ", C.distinct_forms(both)).alias("forms"), F.concat_ws("|", C.split_delimited(listed)).alias("parts"))


QUERIES["split_delimited"], ORACLES["split_delimited"] = QUERIES["strip_amendment"], ORACLES["strip_amendment"]


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || ' HOLDINGS; ' || upper(p_name) WHEN 1 THEN upper(p_name) ELSE 'THE ' || upper(p_name) || ' CORP; THE ' || upper(p_name) END || CASE WHEN p_partkey % 3 < 2 AND length(split_part(p_name, ' ', 1)) > 4 THEN '; ' || upper(split_part(p_name, ' ', 1)) ELSE '' END AS terms FROM part")
def company_search_terms(s, d):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat("p_name", F.lit(" Holdings."))).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("The "), "p_name", F.lit(", Corp.")))
    return read(s, d, "part").select("p_partkey", F.concat_ws("; ", C.company_search_terms(name)).alias("terms"))
