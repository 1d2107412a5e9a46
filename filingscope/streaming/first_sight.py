"""Filings as they are first seen on a stream: keyed state with timers, so that what is remembered stays bounded."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OPTIONS = "spark.sql.streaming.stateStore.rocksdb"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs (RocksDB: on disk, so state may exceed memory).

    Batches save their changes only, and files are not allocated ahead: a store of a few rows takes little disk.
    """
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(f"{OPTIONS}.changelogCheckpointing.enabled", "true")
    spark.conf.set(f"{OPTIONS}.allowFAllocate", "false")


#: Groups of accessions that are remembered together, and days of time by which a group's timers are rounded up.
GROUPS, DAY = 1024, 86_400_000


class FirstSight(StatefulProcessor):
    """Passes an accession's oldest row when it is first seen, and forgets the accession a time after it was filed.

    A group of accessions has one state, {accession: time filed}, that a batch reads and writes once.
    """

    def __init__(self, days: int, time_col: str, columns: list[str]):
        self.keep, self.time_col, self.columns = days * DAY, time_col, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "accessions string")

    def _remembered(self, watermark: int) -> dict[str, int]:
        seen = json.loads(self.seen.get()[0]) if self.seen.exists() else {}
        return {a: filed for a, filed in seen.items() if filed + self.keep >= watermark}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self._remembered(timerValues.getCurrentWatermarkInMs())
        batch = pd.concat(list(rows))
        new = batch[~batch["accession"].isin(seen)].sort_values(self.time_col, kind="stable").drop_duplicates("accession")
        if not len(new):
            return
        filed = [int(t.timestamp() * 1000) for t in new[self.time_col]]
        self.seen.update((json.dumps(seen | dict(zip(new["accession"], filed))),))
        self.handle.registerTimer(((max(filed) + self.keep) // DAY + 1) * DAY)
        yield new[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = self._remembered(timerValues.getCurrentWatermarkInMs())
        if seen:
            self.seen.update((json.dumps(seen),))
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_sight(filings: DataFrame, days: int, time_col: str = "filed_at", groups: int = GROUPS) -> DataFrame:
    """Each accession of a stream once: its oldest row of the batch that first has it.

    An accession is remembered until the newest filing is twice `days` younger than it; rows that come later
    than `days` behind the newest are dropped, so nothing is passed twice. Accessions are remembered in `groups`
    groups, which a checkpoint fixes; more groups make each smaller. Start the stream with alerts.start(), which
    chooses the state store. Null accessions are dropped.
    """
    rows = filings.filter("accession is not null").withWatermark(time_col, f"{days} days")
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64("accession"), F.lit(groups)).cast("int")).groupBy("_group")
    return grouped.transformWithStateInPandas(FirstSight(days, time_col, filings.columns), filings.schema, "Append", "EventTime")


def followed(filings: DataFrame, follows: DataFrame) -> DataFrame:
    """Filings with the forms that their tickers' followers want (null where nobody follows); (ticker, forms) may name a ticker twice."""
    wanted = follows.groupBy("ticker").agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"))
    return filings.join(wanted, "ticker", "left")
