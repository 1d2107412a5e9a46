"""Readers of landed filing data: TSV, index, Atom, XML and JSON files, and the tables that exports have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingscope.functions.columns import format_accession, normalize_sec_date, parse_number
from filingscope.sources.whole import openable, read_files


def scan_bulk_tsv(spark: SparkSession, path) -> DataFrame:
    """Tab-separated text without quotes: header names in A-Z, 0-9 and _ without a byte order mark, missing cells ''."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "\0").csv(path)
    names = ["".join(c if c.isascii() and c.isalnum() else "_" for c in n.replace("﻿", "").strip().upper()) for n in rows.columns]
    return rows.toDF(*names).na.fill("")


def bulk_submissions(submissions: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """SUBMISSION rows (and names of COVERPAGE) -> accession, form, period, cik, filing_date, manager_name."""
    out = submissions.select(F.col("ACCESSION_NUMBER").alias("accession"), F.col("SUBMISSIONTYPE").alias("form"), F.to_date(normalize_sec_date("PERIODOFREPORT")).alias("period"), F.col("CIK").alias("cik"), F.to_date(normalize_sec_date("FILING_DATE")).alias("filing_date"))
    if covers is None:
        return out
    return out.join(covers.select(F.col("ACCESSION_NUMBER").alias("accession"), F.col("FILINGMANAGER_NAME").alias("manager_name")), "accession", "left")


def bulk_holdings(info: DataFrame) -> DataFrame:
    return info.select(F.col("ACCESSION_NUMBER").alias("accession"), F.upper(F.trim("NAMEOFISSUER")).alias("issuer"), F.nullif(F.upper(F.trim("CUSIP")), F.lit("")).alias("cusip"), parse_number("VALUE", 0).alias("value"), parse_number("SSHPRNAMT", 0).alias("shares"), F.nullif(F.trim("SSHPRNAMTTYPE"), F.lit("")).alias("share_type"), F.nullif(F.trim("PUTCALL"), F.lit("")).alias("putcall"))


def parse_master_index(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """cik|name|form|date|file lines of holdings reports; others, the header too, drop out by their form."""
    p = F.split(line_col, r"\|")
    out = lines.filter(F.size(p) >= 5).select(*[F.trim(F.get(p, F.lit(i))).alias(n) for i, n in enumerate(("cik", "name", "form", "date", "file"))])
    out = out.filter(F.col("form").isin("13F-HR", "13F-HR/A"))
    return out.select("cik", "name", "form", F.to_date(normalize_sec_date("date")).alias("filing_date"), "file", F.regexp_extract("file", r"([0-9-]{18,20})\.txt$", 1).alias("accession"))


def scan_master_index(spark: SparkSession, path) -> DataFrame:
    return parse_master_index(spark.read.text(path))


def parse_current_feed(text: Column) -> Column:
    """An Atom feed's entries as structs; those without any part drop out."""
    entries = F.regexp_extract_all(text, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    one = lambda e: F.struct(
        F.regexp_extract(e, r"<title>\s*(.+?)\s+-\s+(.+?)\s+\((\d+)\)", 3).alias("cik"), F.regexp_extract(e, r"<title>\s*(.+?)\s+-\s+(.+?)\s+\((\d+)\)", 2).alias("name"), F.regexp_extract(e, r"<title>\s*(.+?)\s+-\s+(.+?)\s+\((\d+)\)", 1).alias("form"),
        F.regexp_extract(e, r"Filed:\s*(?:</b>|&lt;/b&gt;)\s*(\d{4}-\d{2}-\d{2})", 1).alias("date"), F.regexp_extract(e, r'<link[^>]*href="([^"]+)"', 1).alias("file"))
    return F.filter(F.transform(entries, one), lambda x: (x["cik"] != "") & (x["name"] != "") & (x["date"] != "") & (x["file"] != ""))


def scan_current_feed(spark: SparkSession, path) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.explode(parse_current_feed(F.col("value"))).alias("e"))
    return rows.select("e.cik", "e.name", "e.form", F.to_date("e.date").alias("filing_date"), "e.file", format_accession(F.regexp_replace(F.regexp_extract("e.file", r"([0-9-]{18,20})(?:-index)?\.\w+$", 1), "-", "")).alias("accession"))


def plain_tags(xml: Column) -> Column:
    """XML without namespace prefixes and declarations."""
    return F.regexp_replace(F.regexp_replace(xml, r"(</?)[A-Za-z0-9_]+:", "$1"), r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", "")


INFO = "struct<infoTable:array<struct<nameOfIssuer:string,titleOfClass:string,cusip:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string,sshPrnamtType:string>,putCall:string>>>"


def _body(xml: Column) -> Column:
    """All elements of a document under one root, the declaration dropped."""
    return F.concat(F.lit("<root>"), F.array_join(F.regexp_extract_all(xml, F.lit(r"(?s)<infoTable\b.*?</infoTable>"), F.lit(0)), ""), F.lit("</root>"))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is evaluated once: Spark would put its expression into each place that names it, and into the
    filters that it makes of an explode()."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def parse_13f_xml(xml: Column) -> Column:
    """Holdings of an information table as structs: issuers in upper case (UNKNOWN if there is none), numbers without commas."""
    return _holdings(plain_tags(xml))


def _holdings(clean: Column) -> Column:
    table = F.from_xml(_body(clean), INFO)["infoTable"]
    return F.transform(F.coalesce(table, F.array().cast(INFO[len("struct<infoTable:") : -1])), lambda t: F.struct(
        F.coalesce(F.nullif(F.upper(F.trim(t["nameOfIssuer"])), F.lit("")), F.lit("UNKNOWN")).alias("issuer"), F.nullif(F.upper(F.trim(t["cusip"])), F.lit("")).alias("cusip"),
        parse_number(t["value"], 0).alias("value"), parse_number(t["shrsOrPrnAmt"]["sshPrnamt"], 0).alias("shares"), t["shrsOrPrnAmt"]["sshPrnamtType"].alias("share_type"),
        F.nullif(F.trim(t["putCall"]), F.lit("")).alias("putcall"), t["titleOfClass"].alias("title")))


def report_date(xml: Column) -> Column:
    return _iso_date(_date_text(plain_tags(xml)))


def _date_text(clean: Column) -> Column:
    return F.regexp_extract(clean, r"(?s)<(?:periodOfReport|reportCalendarOrQuarter)>\s*(.*?)\s*</", 1)


def _iso_date(text: Column) -> Column:
    return F.nullif(normalize_sec_date(text), F.lit(""))


def scan_13f_xml(docs: DataFrame, keys: list[str], xml_col: str = "xml") -> DataFrame:
    """One row per holding of each document."""
    rows = docs.select(*keys, F.explode(F.array(plain_tags(F.col(xml_col)))).alias("_clean"))
    rows = once(once(rows, "_date", _date_text(F.col("_clean"))), "_holdings", _holdings(F.col("_clean")))
    rows = rows.select(*keys, _iso_date(F.col("_date")).alias("report_date"), F.explode("_holdings").alias("h"))
    return rows.select(*keys, "report_date", "h.*")


def scan_13f_submission_text(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Of a submission's XML blocks that with the most holdings (the first of several); the first report date found counts."""
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(r"(?is)<XML>(.*?)</XML>"), F.lit(1))
    rows = docs.select(*keys, F.explode(F.array(F.transform(blocks, plain_tags))).alias("_clean"))
    rows = once(rows, "_dates", F.transform("_clean", _date_text))
    rows = rows.select(*keys, F.get(F.filter(F.transform("_dates", _iso_date), lambda x: x.isNotNull()), F.lit(0)).alias("report_date"), F.posexplode("_clean").alias("block", "_xml"))
    sized = once(rows, "holdings", _holdings(F.col("_xml"))).drop("_xml")
    w = Window.partitionBy(*keys).orderBy(F.size("holdings").desc(), "block")
    best = sized.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return best.select(*keys, "report_date", F.explode("holdings").alias("h")).select(*keys, "report_date", "h.*")


def scan_nport_xml(docs: DataFrame, keys: list[str], terms: list[str], xml_col: str = "xml") -> DataFrame:
    """A fund's records with a term in name or title and any amount: confidence .96 with a value or balance, else .86."""
    docs = docs.select(*keys, F.explode(F.array(plain_tags(F.col(xml_col)))).alias("_clean"))
    clean = F.col("_clean")
    body = F.concat(F.lit("<root>"), F.array_join(F.regexp_extract_all(clean, F.lit(r"(?s)<invstOrSec\b.*?</invstOrSec>"), F.lit(0)), ""), F.lit("</root>"))
    kind = "struct<invstOrSec:array<struct<name:string,title:string,cusip:string,balance:string,units:string,valUSD:string,pctVal:string,assetCat:string,issuerCat:string,invCountry:string>>>"
    rows = once(docs, "_records", F.from_xml(body, kind)["invstOrSec"])
    rows = rows.select(*keys, F.regexp_extract(clean, r"(?s)<regName>\s*(.*?)\s*</regName>", 1).alias("reg_name"), F.regexp_extract(clean, r"(?s)<seriesName>\s*(.*?)\s*</seriesName>", 1).alias("series_name"), F.explode("_records").alias("s"))
    text = F.upper(F.concat_ws(" ", "s.name", "s.title"))
    hit = F.lit(False)
    for t in terms:
        hit = hit | text.contains(t.upper())
    out = rows.filter(hit & (F.coalesce(F.col("s.valUSD"), F.col("s.balance"), F.col("s.pctVal"), F.col("s.assetCat")).isNotNull()))
    return out.select(*keys, "reg_name", "series_name", "s.name", "s.title", "s.cusip", parse_number("s.balance").alias("balance"), "s.units", parse_number("s.valUSD").alias("value"), parse_number("s.pctVal").alias("pct"), F.col("s.assetCat").alias("asset_category"), F.when(parse_number("s.valUSD").isNotNull() | parse_number("s.balance").isNotNull(), 0.96).otherwise(0.86).alias("confidence"))


def scan_form4_xml(docs: DataFrame, keys: list[str], xml_col: str = "xml") -> DataFrame:
    """Insiders' non-derivative transactions with value = shares * price and the insider's title."""
    v = "struct<value:string>"
    owner = "struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isTenPercentOwner:string,officerTitle:string>>"
    kind = f"struct<issuer:struct<issuerTradingSymbol:string,issuerName:string>,reportingOwner:array<{owner}>,nonDerivativeTable:struct<nonDerivativeTransaction:array<struct<transactionDate:{v},transactionAmounts:struct<transactionShares:{v},transactionPricePerShare:{v},transactionAcquiredDisposedCode:{v}>>>>>"
    rows = docs.select(*keys, F.explode(F.array(F.from_xml(plain_tags(F.col(xml_col)), kind))).alias("d"))
    rows = rows.select(*keys, F.col("d.issuer.issuerTradingSymbol").alias("ticker"), F.get("d.reportingOwner", F.lit(0)).alias("o"), F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    yes = lambda c: F.lower(F.trim(c)).isin("1", "true")
    rel = "o.reportingOwnerRelationship"
    title = F.coalesce(F.nullif(F.trim(f"{rel}.officerTitle"), F.lit("")), F.when(yes(f"{rel}.isDirector"), "Director"), F.when(yes(f"{rel}.isTenPercentOwner"), "Ten Percent Owner"))
    a = "t.transactionAmounts"
    shares, price = parse_number(f"{a}.transactionShares.value", 0), parse_number(f"{a}.transactionPricePerShare.value", 0)
    return rows.select(*keys, "ticker", F.col("o.reportingOwnerId.rptOwnerName").alias("insider"), title.alias("title"), F.to_date("t.transactionDate.value").alias("date"), shares.alias("shares"), price.alias("price"), (shares * price).alias("value"), F.col(f"{a}.transactionAcquiredDisposedCode.value").alias("code"))


def scan_company_tickers(docs: DataFrame, json_col: str = "json") -> DataFrame:
    kind = "map<string,struct<cik_str:long,ticker:string,title:string>>"
    rows = docs.select(F.explode(F.from_json(json_col, kind)).alias("k", "c"))
    return rows.select(F.col("c.cik_str").cast("string").alias("cik"), "c.ticker", "c.title", F.col("k").cast("int").alias("position"))


def scan_submissions(docs: DataFrame, keys: list[str], json_col: str = "json") -> DataFrame:
    """Parallel arrays of a company's filings as rows, with URLs."""
    names = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")
    kind = f"struct<cik:string,name:string,filings:struct<recent:struct<{','.join(n + ':array<string>' for n in names)}>>>"
    rows = docs.select(*keys, F.from_json(json_col, kind).alias("d"))
    rows = rows.select(*keys, "d.cik", "d.name", F.explode(F.arrays_zip(*[F.col(f"d.filings.recent.{n}").alias(n) for n in names])).alias("f"))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace("cik", "^0+", ""), F.lit("/"), F.regexp_replace("f.accessionNumber", "-", ""), F.lit("/"), F.col("f.primaryDocument"))
    return rows.select(*keys, "cik", "name", F.col("f.accessionNumber").alias("accession"), "f.form", F.to_date("f.filingDate").alias("filing_date"), F.to_date(F.nullif("f.reportDate", F.lit(""))).alias("report_date"), F.col("f.primaryDocument").alias("document"), url.alias("url"))


def scan_company_facts(docs: DataFrame, keys: list[str], json_col: str = "json") -> DataFrame:
    """XBRL facts: concept, unit, end, value and the place in their array."""
    kind = "struct<cik:long,facts:struct<`us-gaap`:map<string,struct<units:map<string,array<struct<end:string,val:double,form:string>>>>>>>"
    rows = docs.select(*keys, F.from_json(json_col, kind).alias("d"))
    rows = rows.select(*keys, F.col("d.cik").cast("string").alias("cik"), F.explode(F.col("d.facts")["us-gaap"]).alias("concept", "c"))
    rows = rows.select(*keys, "cik", "concept", F.explode("c.units").alias("unit", "facts"))
    return rows.select(*keys, "cik", "concept", "unit", F.posexplode("facts").alias("position", "f")).select(*keys, "cik", "concept", "unit", F.to_date("f.end").alias("end"), "f.val", "position")


def scan_search_hits(docs: DataFrame, keys: list[str], json_col: str = "json") -> DataFrame:
    """Full-text search results; hits without an accession, document or CIK drop out."""
    src = "struct<ciks:array<string>,display_names:array<string>,form:string,file_type:string,file_date:string,period_ending:string,adsh:string>"
    rows = docs.select(*keys, F.explode(F.from_json(json_col, f"struct<hits:struct<hits:array<struct<_id:string,_source:{src}>>>>")["hits"]["hits"]).alias("h"))
    s = F.col("h._source")
    acc = F.coalesce(F.nullif(s["adsh"], F.lit("")), F.substring_index(F.col("h._id"), ":", 1))
    doc = F.when(F.col("h._id").contains(":"), F.substring_index(F.col("h._id"), ":", -1))
    out = rows.select(*keys, acc.alias("accession"), doc.alias("document"), F.get(s["ciks"], F.lit(0)).alias("cik"), F.get(s["display_names"], F.lit(0)).alias("filer"), s["form"].alias("form"), F.to_date(s["file_date"]).alias("filing_date"), F.to_date(s["period_ending"]).alias("period"))
    return out.filter("coalesce(accession, '') <> '' and coalesce(document, '') <> '' and coalesce(cik, '') <> ''")


def scan_documents(spark: SparkSession, path) -> DataFrame:
    """Text files as whole documents with their names; unreadable ones are left out.

    Under a URI that tasks can open, these list the files; else Spark's reader does, which has all names in the driver.
    """
    if uri := openable(spark, path):
        return read_files(spark, uri)
    rows = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def table_load_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **properties: str) -> DataFrame:
    """A SQL store's table, read in parts of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def csv_sink(rows: DataFrame, path: str) -> None:
    """All cells quoted, arrays joined by '; '."""
    cells = [F.concat_ws("; ", F.col(f.name).cast("array<string>")).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields]
    rows.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


exposure_csv_sink = csv_sink
