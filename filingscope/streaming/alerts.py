"""Incremental jobs: alerts, followed filings, ingestion that repeats safely."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filingscope.functions.columns import form_matches
from filingscope.operators.maintenance import replace_holdings
from filingscope.streaming.first_sight import first_sight, followed, use_state

Sink = Callable[[DataFrame, int], None]


def new_filing_alerts(filings: DataFrame, form: str = "ALL", days: int = 7, since: datetime | None = None) -> DataFrame:
    """New filings of a form within the look-back, each accession once, oldest first.

    Filings have a timestamp filed_at. The look-back begins at `since`; a table's begins `days` before
    its newest filing if there is no `since`. On a stream seen accessions are kept for a time (first_sight()),
    and what arrives later than `days` behind the newest is dropped; batches are put in order by oldest_first().
    """
    rows = filings.filter(form_matches("form", form))
    if since is not None:
        rows = rows.filter(F.col("filed_at") >= F.lit(since))
    if rows.isStreaming:
        return first_sight(rows, days)
    if since is None:
        latest = rows.agg(F.max("filed_at").alias("newest"))  # one row
        rows = rows.crossJoin(latest).filter(F.col("filed_at") >= F.col("newest") - F.expr(f"interval {days} days")).drop("newest")
    return rows.dropDuplicates(["accession"]).orderBy("filed_at", "accession")


def oldest_first(sink: Sink) -> Sink:
    """A sink that gets each batch ordered by time. Sorting reads a batch twice, so it is kept: the state before it is asked once."""

    def ordered(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            sink(batch.orderBy("filed_at", "accession"), number)
        finally:
            batch.unpersist()

    return ordered


def followed_filings(filings: DataFrame, follows: DataFrame, days: int = 1) -> DataFrame:
    """Filings of followed tickers (ticker, forms), each accession once; all become seen before the forms are looked at."""
    if filings.isStreaming:
        return first_sight(followed(filings, follows), days).filter(F.array_contains("forms", F.col("form"))).drop("forms")
    return filings.dropDuplicates(["accession"]).join(follows, "ticker").filter(F.array_contains("forms", F.col("form"))).drop("forms")


def start(stream: DataFrame, sink: Sink, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a sink for each batch of new rows; with once it stops when all that is there is done."""
    use_state(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def unseen(batch: DataFrame, stored: DataFrame, key: str = "accession") -> DataFrame:
    """All rows of accessions that are not stored: a filing that was processed is skipped as a whole, a new one kept as a whole."""
    return batch.join(stored.select(key).distinct(), key, "left_anti")


def incremental_ingest(batch: DataFrame, stored: DataFrame, quarter: str, mode: str = "incremental") -> DataFrame:
    """The table after a batch of holdings: rows of the right quarter; in incremental mode only of unseen accessions.

    full and refresh-existing replace what is stored of an accession; a batch that runs twice changes nothing.
    """
    rows = batch.filter(F.col("quarter") == quarter)
    if mode == "incremental":
        rows = rows.join(stored.select("accession").distinct(), "accession", "left_anti")
    elif mode == "refresh-existing":
        rows = rows.join(stored.select("accession").distinct(), "accession", "left_semi")
    return replace_holdings(stored, rows)


def incremental_theme_append(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored themes and all themes of new filings; rows that a batch repeats count once.

    The batch and the stored accessions are dealt out once and sorted once, in as many tasks as the session has shuffle
    partitions. A join instead is planned anew for each part of a batch that is a union, all of them in one task.
    """
    n, columns = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored.columns
    each = ["accession", *[c for c in columns if c != "accession"]]
    have = stored.select("accession", F.lit(True).alias("_stored"))
    rows = batch.select(columns).withColumn("_stored", F.lit(False)).unionByName(have, allowMissingColumns=True)
    rows = rows.repartition(n, "accession").sortWithinPartitions(*each, "_stored")  # the order of both windows
    rows = rows.withColumn("_known", F.max("_stored").over(Window.partitionBy("accession")) & F.col("accession").isNotNull())
    rows = rows.withColumn("_time", F.row_number().over(Window.partitionBy(*each).orderBy("_stored")))
    return stored.unionByName(rows.filter("not _stored and not _known and _time = 1").select(columns))


def incremental_ipo_enrich(batch: DataFrame, stored: DataFrame, enrich: Callable[[DataFrame], DataFrame], n: int = 25) -> DataFrame:
    """New offerings, the newest n of a run, enriched and merged with the stored ones."""
    fresh = unseen(batch, stored).dropDuplicates(["accession"]).orderBy(F.desc("filing_date"), "accession").limit(n)
    return stored.unionByName(enrich(fresh), allowMissingColumns=True)
