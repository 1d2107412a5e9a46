"""A table that a stream fills exactly once: batches in folders of their own, and a ledger that says which of them count.

A batch writes its rows to a new folder, then the accessions that it holds, and at last one row of the ledger
`ingestion_runs`. Readers take only folders that the ledger names, so a batch that dies on the way leaves
nothing to be seen; a batch that comes again after its ledger row was written is known by its stream and number
and does nothing. Of an accession's rows only those of the newest batch count, so replacing needs no rewriting.
No table format is needed; one writer at a time is assumed, as Structured Streaming has it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from filingscope.streaming.alerts import start, unseen

COUNTERS = ("seen", "inserted", "skipped_existing", "skipped_wrong_quarter", "skipped_no_holdings")
LEDGER = "id bigint, source string, query string, batch bigint, quarter string, mode string, status string, folder string, started_at timestamp, finished_at timestamp, " + ", ".join(f"{c} bigint" for c in COUNTERS)
FILINGS = "accession string, n bigint"
#: The folder that holds nothing.
NONE = "none"

#: batch, accessions stored -> the rows to store.
Select = Callable[[DataFrame, DataFrame], DataFrame]


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class BatchStore:
    """Rows of accessions under a path, in batches. schema: of the rows; it has a column accession (string)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        for name, kind in (("rows", self.schema), ("filings", FILINGS)):
            spark.createDataFrame([], kind).write.mode("ignore").parquet(f"{self.path}/{name}/folder={NONE}")
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{self.path}/ingestion_runs")

    def _read(self, name: str, schema: T.StructType | str) -> DataFrame:
        kind = self.spark.createDataFrame([], schema).schema
        return self.spark.read.schema(T.StructType([*kind.fields, T.StructField("folder", T.StringType())])).parquet(f"{self.path}/{name}")

    def runs(self) -> DataFrame:
        """The ledger, a row per batch that ended; latest_run_status() reads it."""
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ingestion_runs")

    def accessions(self) -> DataFrame:
        """(accession, folder) of what is stored: the newest completed batch that holds it."""
        done = self.runs().filter("status = 'completed'").select("folder", "id")
        rows = self._read("filings", FILINGS).join(done, "folder")
        return rows.groupBy("accession").agg(F.max_by("folder", "id").alias("folder"))

    def table(self) -> DataFrame:
        """The rows that count."""
        return self._read("rows", self.schema).join(self.accessions(), ["accession", "folder"], "left_semi").select(self.schema.names)

    def commit(self, batch: DataFrame, number: int, select: Select, source: str = "live", quarter: str | None = None, mode: str = "incremental", counters: Callable[[DataFrame, DataFrame], DataFrame] | None = None, after: Callable[[str], None] = lambda step: None) -> bool:
        """Stores what select takes of a batch, once; False if this batch of this stream is stored already.

        counters gives one row of the ledger's counts. after is called when the rows, the accessions and the
        ledger's row are written (for tests of what a crash leaves).
        """
        query = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        runs = self.runs()
        same = (F.col("source") == source) & (F.col("query") == query) & (F.col("batch") == number)
        before = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.count_if(same & (F.col("status") == "completed")).alias("done")).first()
        if before["done"]:
            return False
        folder, started = f"{number}-{uuid.uuid4().hex}", _now()
        about = [before["last"] + 1, source, query, number, quarter, mode]
        try:
            known = self.accessions().select("accession")
            select(batch, known).select(self.schema.names).write.option("compression", "zstd").parquet(f"{self.path}/rows/folder={folder}")
            after("rows")
            written = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/folder={folder}")
            written.groupBy("accession").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/filings/folder={folder}")
            after("accessions")
            counts = counters(batch, known).first().asDict() if counters else {"inserted": self.spark.read.parquet(f"{self.path}/filings/folder={folder}").count()}
        except Exception:
            self._log([*about, "failed", folder, started, _now(), *[None] * len(COUNTERS)])
            raise
        self._log([*about, "completed", folder, started, _now(), *[counts.get(c) for c in COUNTERS]])
        after("ledger")
        return True

    def _log(self, row: list) -> None:
        self.spark.createDataFrame([tuple(row)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ingestion_runs")

    def compact(self) -> None:
        """Writes what counts as one batch; vacuum() then deletes the others."""
        self.commit(self.table(), self.runs().count(), lambda rows, known: rows, source="compaction", mode="full")

    def unused(self) -> DataFrame:
        """(folder) that no stored accession needs: of batches that died, were replaced whole, or hold nothing."""
        folders = self._read("filings", FILINGS).select("folder").unionByName(self._read("rows", self.schema).select("folder")).distinct()
        return folders.filter(F.col("folder") != NONE).join(self.accessions().select("folder").distinct(), "folder", "left_anti")

    def vacuum(self) -> int:
        """Deletes unused folders; not while a batch is being written. The number of folders is that of batches since the last time."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path
        folders = [r[0] for r in self.unused().toLocalIterator()]
        for folder in folders:
            for name in ("rows", "filings"):
                path = fs(f"{self.path}/{name}/folder={folder}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(folders)


def ingestion_outcomes(batch: DataFrame, known: DataFrame, quarter: str, mode: str, holding: str) -> DataFrame:
    """(accession, outcome) of a batch of holdings, the first that holds: another quarter, no holdings, stored already (or, in
    refresh-existing, not stored), else inserted. A filing without holdings comes as a row whose column `holding` is null."""
    right = F.col("quarter").eqNullSafe(F.lit(quarter))
    filings = batch.filter("accession is not null").groupBy("accession").agg(F.count_if(right).alias("right"), F.count_if(right & F.col(holding).isNotNull()).alias("rows"))
    found = filings.join(known.withColumn("known", F.lit(True)), "accession", "left")
    skipped = {"full": F.lit(False), "incremental": F.col("known").isNotNull(), "refresh-existing": F.col("known").isNull()}[mode]
    return found.select("accession", F.when(F.col("right") == 0, "skipped_wrong_quarter").when(F.col("rows") == 0, "skipped_no_holdings").when(skipped, "skipped_existing").otherwise("inserted").alias("outcome"))


def ingest_batch(store: BatchStore, batch: DataFrame, number: int, quarter: str, mode: str = "incremental", source: str = "live", holding: str = "issuer", after: Callable[[str], None] = lambda step: None) -> bool:
    """Stores a batch of holdings once: rows of the quarter, of accessions that the mode takes, each as a whole."""

    def select(rows: DataFrame, known: DataFrame) -> DataFrame:
        taken = ingestion_outcomes(rows, known, quarter, mode, holding).filter("outcome = 'inserted'")
        return rows.filter((F.col("quarter") == quarter) & F.col(holding).isNotNull()).join(taken, "accession", "left_semi")

    def counters(rows: DataFrame, known: DataFrame) -> DataFrame:
        outcome = ingestion_outcomes(rows, known, quarter, mode, holding)
        return outcome.agg(F.count(F.lit(1)).alias("seen"), *[F.count_if(F.col("outcome") == c).alias(c) for c in COUNTERS[1:]])

    return store.commit(batch, number, select, source, quarter, mode, counters, after)


def ingest_stream(stream: DataFrame, store: BatchStore, checkpoint: str, quarter: str, mode: str = "incremental", source: str = "live", holding: str = "issuer", once: bool = True, after: Callable[[str], None] = lambda step: None) -> StreamingQuery:
    """Ingests a stream of holdings exactly once, whatever dies on the way: start it again with its checkpoint."""
    return start(stream, lambda batch, n: ingest_batch(store, batch, n, quarter, mode, source, holding, after), checkpoint, once)


def theme_stream(stream: DataFrame, store: BatchStore, checkpoint: str, source: str = "themes", once: bool = True) -> StreamingQuery:
    """Appends all themes of filings that are not stored; rows that a batch repeats count once."""
    return start(stream, lambda batch, n: store.commit(batch, n, lambda rows, known: unseen(rows, known).select(store.schema.names).distinct(), source), checkpoint, once)


def ipo_stream(stream: DataFrame, store: BatchStore, checkpoint: str, enrich: Callable[[DataFrame], DataFrame], n: int = 25, source: str = "offerings", once: bool = True) -> StreamingQuery:
    """Per batch the newest n offerings that are not stored, enriched. What exceeds n in a batch is left for another source to bring again."""

    def select(rows: DataFrame, known: DataFrame) -> DataFrame:
        return enrich(unseen(rows, known).dropDuplicates(["accession"]).orderBy(F.desc("filing_date"), "accession").limit(n))

    return start(stream, lambda batch, number: store.commit(batch, number, select, source), checkpoint, once)
