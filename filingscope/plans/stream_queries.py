"""Streams over the given tables: rows are landed as files, read as a stream in several batches, and the sink's table is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingscope.plans.fixtures import read
from filingscope.streaming import alerts, store as B
from filingscope.tables import drop_table, new_path, write_table

QUERIES: dict = {}
ORACLES: dict = {}

#: Batches in which these streams take what is landed.
BATCHES = 4


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def landed(df):
    """(files, stream): a table as files in the shared folder, and the stream of them."""
    files = write_table(df, "landed")
    names = files.inputFiles()
    return files, df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-len(names) // BATCHES)).parquet(names[0].rsplit("/", 1)[0])


def stored(stream, begin, ordered=lambda sink: sink):
    """The rows that a stream emits, as a table; begin starts it with a sink."""
    path = new_path(stream.sparkSession, "emitted")
    begin(stream, ordered(lambda batch, _: batch.write.mode("append").parquet(path)), new_path(stream.sparkSession, "progress")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def feed(s, d):
    """Pages as filings of one minute each, every one of them filed again a little later."""
    k = F.col("page_id")
    rows = read(s, d, "pages").select(k.cast("string").alias("accession"), F.element_at(F.array(F.lit("10-K"), F.lit("8-K"), F.lit("8-K/A")), (k % 3 + 1).cast("int")).alias("form"), (k % 50).cast("string").alias("ticker"), F.timestamp_seconds(F.lit(1_767_225_600) + k * 60).alias("filed_at"))
    return rows.unionByName(rows.withColumn("filed_at", F.expr("filed_at + interval 30 seconds")))


@query("SELECT CAST(page_id AS VARCHAR) AS accession, CAST(epoch(TIMESTAMP '2026-01-01') AS BIGINT) + page_id * 60 AS filed FROM pages WHERE page_id % 3 = 0")
def new_filing_alerts_stream(s, d):
    """No row is late: the watermark's days are those of all pages."""
    files, stream = landed(feed(s, d))
    found = stored(alerts.new_filing_alerts(stream, "10-K", 36_500), alerts.start, alerts.oldest_first)
    # the two files of a filing may come in either order
    return found.select("accession", (F.floor(F.unix_timestamp("filed_at") / 60) * 60).cast("long").alias("filed"))


@query("SELECT CAST(page_id AS VARCHAR) AS accession, CAST(page_id % 50 AS VARCHAR) AS ticker FROM pages WHERE page_id % 50 % 5 = 0 AND page_id % 3 = 1")
def followed_filings_stream(s, d):
    files, stream = landed(feed(s, d).filter("accession % 5 = 0 or accession % 7 = 0"))
    follows = s.range(50).select(F.col("id").cast("string").alias("ticker"), F.array(F.lit("8-K")).alias("forms")).filter("ticker % 5 = 0")
    found = stored(alerts.followed_filings(stream, follows, 36_500), alerts.start)
    return found.select("accession", "ticker")


def document_holdings(s, d):
    """Documents as holdings: a filing of four documents, in one of three quarters; some filings have no holdings."""
    k = F.col("doc_id")
    filing = F.floor(k / 4)
    quarter = F.element_at(F.array(F.lit("2026-Q1"), F.lit("2026-Q2"), F.lit("2026-Q2")), (filing % 3 + 1).cast("int"))
    return read(s, d, "documents").select(k.alias("row_id"), filing.cast("string").alias("accession"), quarter.alias("quarter"), F.when(filing % 10 != 0, F.col("source")).alias("issuer"), F.col("n_chars").cast("long").alias("shares"))


_FILED = "SELECT doc_id AS row_id, CAST(doc_id // 4 AS VARCHAR) AS accession, source AS issuer, CAST(n_chars AS BIGINT) AS shares FROM documents WHERE (doc_id // 4) % 3 <> 0 AND (doc_id // 4) % 10 <> 0"


@query(_FILED)
def incremental_ingest_stream(s, d):
    """A filing's rows lie in one file, so a batch has filings as a whole; every file comes twice."""
    rows = document_holdings(s, d).repartition("accession")
    files, stream = landed(rows)
    store = B.BatchStore(s, new_path(s, "store"), rows.schema)
    for name in ("first", "again"):
        B.ingest_stream(stream, store, new_path(s, name), "2026-Q2").awaitTermination()
    drop_table(files)
    return store.table().select("row_id", "accession", "issuer", "shares")


@query("SELECT id, source, status, seen, inserted, skipped_existing, skipped_wrong_quarter, skipped_no_holdings FROM (SELECT count(DISTINCT doc_id // 4) AS seen, count(DISTINCT CASE WHEN (doc_id // 4) % 3 <> 0 AND (doc_id // 4) % 10 <> 0 THEN doc_id // 4 END) AS taken, count(DISTINCT CASE WHEN (doc_id // 4) % 3 = 0 THEN doc_id // 4 END) AS skipped_wrong_quarter, count(DISTINCT CASE WHEN (doc_id // 4) % 3 <> 0 AND (doc_id // 4) % 10 = 0 THEN doc_id // 4 END) AS skipped_no_holdings FROM documents), (VALUES (1, 'first'), (2, 'again')) v(id, source), LATERAL (SELECT CASE WHEN id = 1 THEN taken ELSE 0 END AS inserted, CASE WHEN id = 2 THEN taken ELSE 0 END AS skipped_existing, 'completed' AS status)")
def ingestion_ledger(s, d):
    """Two batches with the same filings: the ledger's counts. The second batch is committed twice."""
    rows = document_holdings(s, d)
    store = B.BatchStore(s, new_path(s, "store"), rows.schema)
    for number, name in enumerate(("first", "again", "again")):
        B.ingest_batch(store, rows, min(number, 1), "2026-Q2", source=name)
    return store.runs().select("id", "source", "status", *B.COUNTERS)
