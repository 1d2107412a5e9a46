"""Queries that write what they read: TSV and text files, CSV sinks, snapshots; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope import ship
from filingscope.operators import maintenance as M
from filingscope.plans.fixtures import CURRENT, PREVIOUS, SQL, filings, holdings, read
from filingscope.sources import filings as SRC
from filingscope.sources.marked import scan_submission_files as scan_files
from filingscope.sources.whole import write_files
from filingscope.tables import new_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {SQL} SELECT accession, '13F-HR' AS form, filing_date, CAST(CAST(cik AS BIGINT) AS VARCHAR) AS cik, coalesce(fund_name, '') AS manager_name FROM f")
def scan_bulk_tsv(s, d):
    """Submissions and cover pages written as tab-separated files, read back and joined."""
    path = new_path(s, "bulk")
    rows = filings(s, d).select("accession", "cik", F.upper(F.date_format("filing_date", "dd-MMM-yyyy")).alias("day"), F.coalesce("fund_name", F.lit("")).alias("fund_name"))
    out = rows.select(F.col("accession").alias("\ufeffAccession_Number"), F.lit("13F-HR").alias("SubmissionType"), F.col("day").alias("PeriodOfReport"), F.col("cik").alias("CIK"), F.col("day").alias("Filing_Date"))
    put = lambda df, name: df.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(f"{path}/{name}")
    put(out, "submission")
    put(rows.select(F.col("accession").alias("Accession_Number"), F.col("fund_name").alias("FilingManager_Name")), "cover")
    found = SRC.bulk_submissions(SRC.scan_bulk_tsv(s, f"{path}/submission"), SRC.scan_bulk_tsv(s, f"{path}/cover"))
    return found.select("accession", "form", "filing_date", F.regexp_replace("cik", "^0+(?=.)", "").alias("cik"), "manager_name")


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'))) AS text_md5 FROM documents")
def scan_documents(s, d):
    """Each document written as a text file of its own, and all files read back whole."""
    ship(s)
    path = new_path(s, "texts")
    kind = F.when(F.col("text").isNull(), ".none").otherwise(".txt")
    rows = read(s, d, "documents").select(F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), kind).alias("name"), F.trim(F.regexp_replace("text", r"[\r\n]+", " ")).alias("text"))
    write_files(rows, path)
    found = SRC.scan_documents(s, path)
    doc_id = F.nullif(F.regexp_extract("path", r"doc_id=(-?\d+)\.\w+$", 1), F.lit("")).cast("long")
    return found.select(doc_id.alias("doc_id"), F.when(F.col("path").endswith(".txt"), F.md5("text")).alias("text_md5"))


@query("SELECT event_type AS form, CAST(event_id AS VARCHAR) AS accession, event_type || '; say \"so\"' AS terms FROM events")
def exposure_csv_sink(s, d):
    """Rows written by the CSV sink, with quotes and arrays, and read back."""
    path = new_path(s, "csv")
    rows = read(s, d, "events").select(F.col("event_type").alias("form"), F.col("event_id").cast("string").alias("accession"), F.array("event_type", F.lit('say "so"')).alias("terms"))
    SRC.exposure_csv_sink(rows, path)
    return s.read.option("header", True).csv(path)


def snapshots(s, d):
    """A store with two pairs of quarters, one of which was written twice; the second pair's hash is stale."""
    path = new_path(s, "snapshots")
    rows = holdings(s, d).select("row_id", "accession", "quarter", "issuer", "value", "shares")
    pair = lambda a, b: rows.filter(F.col("quarter").isin(a, b))
    M.snapshot_write(rows.limit(5), path, CURRENT, PREVIOUS, "old", ["red"])
    M.snapshot_write(pair(CURRENT, PREVIOUS), path, CURRENT, PREVIOUS, "new", ["red", "metal"])
    M.snapshot_write(pair(PREVIOUS, "2001-Q1"), path, PREVIOUS, "2001-Q1", "old", ["red"])
    return path


@query(f"WITH {SQL} SELECT row_id, accession, issuer, round(value, 5) AS value, '' AS warnings FROM h WHERE quarter IN ('{CURRENT}', '{PREVIOUS}') UNION ALL SELECT row_id, accession, issuer, round(value, 5), 'watchlist has changed; categories missing: metal' FROM h WHERE quarter IN ('{PREVIOUS}', '2001-Q1')")
def snapshot_read(s, d):
    path = snapshots(s, d)
    out = None
    for a, b in ((CURRENT, PREVIOUS), (PREVIOUS, "2001-Q1")):
        rows, about = M.snapshot_read(s, path, a, b, "new", ["red", "metal"])
        rows = rows.crossJoin(about.select(F.concat_ws("; ", "warnings").alias("warnings")))  # one row
        rows = rows.select("row_id", "accession", "issuer", F.round("value", 5).alias("value"), "warnings")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES["snapshot_write"], ORACLES["snapshot_write"] = QUERIES["snapshot_read"], ORACLES["snapshot_read"]


@query(f"WITH {SQL}, q (current_quarter, previous_quarter, watchlist_hash, categories, place) AS (VALUES ('{CURRENT}', '{PREVIOUS}', 'new', 'red; metal', 1), ('{PREVIOUS}', '2001-Q1', 'old', 'red', 2)) SELECT q.*, (SELECT count(*) FROM h WHERE quarter IN (current_quarter, previous_quarter)) AS n FROM q")
def snapshot_list(s, d):
    path = snapshots(s, d)
    listed = [(r["current_quarter"], r["previous_quarter"], r["watchlist_hash"], "; ".join(r["categories"]), i + 1) for i, r in enumerate(M.snapshot_list(s, path).collect())]  # a row per pair
    table = s.createDataFrame(listed, "current_quarter string, previous_quarter string, watchlist_hash string, categories string, place int")
    n = s.read.parquet(f"{path}/rows").groupBy(F.col("current_quarter").cast("string").alias("current_quarter"), F.col("previous_quarter").cast("string").alias("previous_quarter")).agg(F.count(F.lit(1)).alias("n"))
    return table.join(n, ["current_quarter", "previous_quarter"])


@query("SELECT CAST(page_id AS VARCHAR) AS accession, md5(coalesce(html, '')) AS body_md5 FROM pages")
def scan_submission_files(s, d):
    """Pages as submissions, landed as text files and read back by byte ranges of 4 MB."""
    path = new_path(s, "submissions")
    value = F.concat(F.lit("<SEC-DOCUMENT>x.txt\nACCESSION NUMBER: "), "page_id", F.lit("\n<TEXT>"), F.coalesce("html", F.lit("")), F.lit("</TEXT>"))
    read(s, d, "pages").select(value.alias("value")).write.text(path)
    found = scan_files(s, path, ["accession", "text"], split_bytes=4 << 20)
    return found.select("accession", F.md5(F.regexp_extract("text", r"(?s)<TEXT>(.*)</TEXT>", 1)).alias("body_md5"))
