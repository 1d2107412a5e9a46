"""Streams that are killed, started again, and fed late and repeated rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from filingscope.streaming import alerts, store as B

ROWS = "accession string, quarter string, issuer string, shares long"


class Killed(Exception):
    pass


class Dying(B.BatchStore):
    """A store whose process dies with an error: nothing is left to log it."""

    def _log(self, row):
        if "failed" not in row:
            super()._log(row)


def landing(spark, path, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


def dies_at(step, times):
    left = [times]

    def after(at):
        if at == step and left[0]:
            left[0] -= 1
            raise Killed(step)

    return after


BATCHES = [
    [("a", "Q2", "X", 1), ("a", "Q2", "Y", 2), ("b", "Q1", "X", 3), ("c", "Q2", None, None)],
    [("a", "Q2", "X", 9), ("d", "Q2", "Z", 4), ("d", "Q1", "Z", 5)],
    [("e", "Q2", "X", 6), ("d", "Q2", "Z", 7)],
]
STORED = [("a", "Q2", "X", 1), ("a", "Q2", "Y", 2), ("d", "Q2", "Z", 4), ("e", "Q2", "X", 6)]


@pytest.mark.parametrize("step", ["rows", "accessions", "ledger"])
def test_ingestion_survives_a_kill_at_any_step(spark, tmp_path, step):
    source, path, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "store", "progress"))
    for rows in BATCHES:
        landing(spark, source, rows)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    after = dies_at(step, 2)
    for _ in range(4):  # dies in the first batch, then once more
        store = Dying(spark, path, ROWS)
        try:
            B.ingest_stream(stream, store, checkpoint, "Q2", after=after).awaitTermination()
        except Exception:
            continue
    store = B.BatchStore(spark, path, ROWS)
    got = sorted(map(tuple, store.table().collect()))
    files = [r[0] for r in store.runs().orderBy("id").select("status").collect()]
    assert files == ["completed"] * 3
    order = sorted(map(tuple, spark.read.schema(ROWS).parquet(source).filter("quarter = 'Q2' and issuer is not null").collect()))
    assert set(got) <= set(order) and {r[0] for r in got} == {"a", "d", "e"}
    assert len(got) == len(set(got)) and sum(r[0] == "a" for r in got) in (1, 2)  # files of one second come in any order; a filing is of one batch
    assert store.unused().count() >= (1 if step != "ledger" else 0)
    assert store.vacuum() >= (1 if step != "ledger" else 0) and sorted(map(tuple, store.table().collect())) == got and store.vacuum() == 0


def test_modes_ledger_and_compaction(spark, tmp_path):
    store = B.BatchStore(spark, f"file://{tmp_path}/store", ROWS)
    frames = [spark.createDataFrame(x, ROWS) for x in BATCHES]
    for n, batch in enumerate(frames):
        assert B.ingest_batch(store, batch, n, "Q2") and not B.ingest_batch(store, batch, n, "Q2")
    assert sorted(map(tuple, store.table().collect())) == STORED
    counts = [tuple(r) for r in store.runs().orderBy("id").select(*B.COUNTERS).collect()]
    assert counts == [(3, 1, 0, 1, 1), (2, 1, 1, 0, 0), (2, 1, 1, 0, 0)]
    B.ingest_batch(store, spark.createDataFrame([("a", "Q2", "N", 1), ("new", "Q2", "N", 2)], ROWS), 0, "Q2", "refresh-existing", "refresh")
    assert sorted(map(tuple, store.table().filter("issuer = 'N'").collect())) == [("a", "Q2", "N", 1)] and store.table().filter("accession = 'a'").count() == 1
    B.ingest_batch(store, spark.createDataFrame([("d", "Q2", "F", 1), ("f", "Q2", "F", 2)], ROWS), 0, "Q2", "full", "full")
    before = sorted(map(tuple, store.table().collect()))
    store.compact()
    assert store.vacuum() == 5 and sorted(map(tuple, store.table().collect())) == before
    assert not B.ingest_batch(store, frames[0], 0, "Q2")


def test_failed_batches_are_in_the_ledger(spark, tmp_path):
    from filingscope.operators.maintenance import latest_run_status

    store = B.BatchStore(spark, f"file://{tmp_path}/store", ROWS)
    bad = spark.createDataFrame(BATCHES[0], ROWS).withColumn("issuer", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        B.ingest_batch(store, bad, 0, "Q2")
    assert store.table().count() == 0 and latest_run_status(store.runs()).first()["mode"] == "full"
    B.ingest_batch(store, spark.createDataFrame(BATCHES[0], ROWS), 0, "Q2")
    assert store.table().count() == 2 and latest_run_status(store.runs()).first()["mode"] == "incremental"


def test_themes_and_offerings_are_appended_once(spark, tmp_path):
    schema = "accession string, theme string, filing_date string"
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([("1", "x", "d1"), ("1", "x", "d1"), ("1", "y", "d1"), ("2", "x", "d2")], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    themes, offers = (B.BatchStore(spark, f"file://{tmp_path}/{x}", schema) for x in ("themes", "offers"))
    for _ in range(2):
        B.theme_stream(stream, themes, f"file://{tmp_path}/p1").awaitTermination()
        B.ipo_stream(stream, offers, f"file://{tmp_path}/p2", lambda x: x.withColumn("theme", F.lit("rich")), n=1).awaitTermination()
        spark.createDataFrame([("1", "late", "d1"), ("3", "z", "d3"), ("4", "z", "d0")], schema).coalesce(1).write.mode("append").parquet(source)
    assert sorted(map(tuple, themes.table().collect())) == [("1", "x", "d1"), ("1", "y", "d1"), ("2", "x", "d2"), ("3", "z", "d3"), ("4", "z", "d0")]
    assert sorted(map(tuple, offers.table().collect())) == [("2", "rich", "d2"), ("3", "rich", "d3")]


ALERTS = "accession string, form string, ticker string, filed_at timestamp"
DAY = datetime(2026, 1, 1)


def alert_rows(*rows):
    return [(a, form, ticker, DAY + timedelta(days=d)) for a, form, ticker, d in rows]


def run_alerts(spark, folder, batches, plan):
    """Each batch is a run of its own: the stream is started again from its checkpoint each time."""
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(alert_rows(*rows), ALERTS).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
        stream = plan(spark.readStream.schema(ALERTS).parquet(f"file://{folder}/in"))
        seen = []
        alerts.start(stream, alerts.oldest_first(lambda df, _, seen=seen: seen.extend(r["accession"] for r in df.collect())), f"file://{folder}/progress").awaitTermination()
        out.append(seen)
    return out


def test_alerts_after_restart_late_rows_and_forgotten_accessions(spark, tmp_path):
    batches = [
        [("a", "8-K", "T", 10), ("b", "8-K", "T", 9), ("a", "8-K", "T", 11), ("x", "10-Q", "T", 10), (None, "8-K", "T", 10)],
        [("a", "8-K", "T", 10), ("c", "8-K", "T", 5)],  # seen; within the days
        [("late", "8-K", "T", 2), ("d", "8-K", "T", 40)],  # 2 is more than 7 days behind 11
        [("a", "8-K", "T", 10), ("e", "8-K", "T", 41)],  # forgotten by now, but late
        [("f", "8-K", "T", 60), ("d", "8-K", "T", 40)],
    ]
    got = run_alerts(spark, tmp_path, batches, lambda s: alerts.new_filing_alerts(s, "8-K", 7))
    assert got == [["b", "a"], ["c"], ["d"], ["e"], ["f"]]


def test_followed_filings_become_seen_even_if_nobody_wants_their_form(spark, tmp_path):
    table = [[("T", ["8-K"])], [("T", ["8-K", "10-Q"])], [("T", ["10-Q"]), ("T", ["8-K"])]]
    batches = [[("a", "10-Q", "T", 1), ("b", "8-K", "T", 1), ("c", "8-K", "U", 1)], [("a", "10-Q", "T", 1), ("d", "10-Q", "T", 1)], [("e", "8-K", "T", 2), ("b", "8-K", "T", 1)]]
    follows = iter(table)
    got = run_alerts(spark, tmp_path, batches, lambda s: alerts.followed_filings(s, spark.createDataFrame(next(follows), "ticker string, forms array<string>"), 30))
    assert got == [["b"], ["d"], ["e"]]
