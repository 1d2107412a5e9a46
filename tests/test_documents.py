"""Rules on documents that have no SQL: chunks, context windows, exposure rows; jobs and sources on small input."""

import os
import re

import pytest
from pyspark.sql import functions as F


def brute_context(text, headings, most, opening, before, after):
    if len(text) <= most:
        return text
    clean = re.sub(r"\s+", " ", text).strip()
    spans = [("opening summary and offering front matter", 0, min(opening, len(clean)))]
    for h in headings:
        at = clean.lower().find(h)
        if at < 0:
            continue
        lo, hi = max(0, at - before), min(len(clean), at + after)
        if not any(lo < b and a < hi for _, a, b in spans):
            spans.append((h, lo, hi))
    text = ""
    for label, lo, hi in spans:
        more = ("\n\n" if text else "") + f"--- Filing context: {label} ---\n" + clean[lo:hi]
        if len(text) + len(more) > most:
            break
        text += more
    return text or clean[:most]


def test_context_windows(spark):
    from filingscope.operators import documents as D

    filler = "plain words stand here \n"
    texts = ["short", None, "", filler * 40 + "Risk  Factors" + filler * 60 + "USE OF PROCEEDS" + filler * 10 + "the offering" + filler * 90 + "Underwriting", filler * 200, "Dilution " + filler * 100 + "Business" + filler * 5 + "Customers" + filler * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size in (dict(most=900, opening=200, before=50, after=150), dict(most=150, opening=200, before=50, after=150), dict(most=2000, opening=300, before=20, after=400)):
        got = {r["id"]: r["context"] for r in D.filing_context_windows(df, ["id"], **size).collect()}
        assert got == {i: None if t is None else brute_context(t, D.HEADINGS, size["most"], size["opening"], size["before"], size["after"]) for i, t in enumerate(texts)}


def test_chunks_cover_the_text(spark):
    from filingscope.operators import documents as D

    text = " ".join(f"Sentence number {i} is here{'.' if i % 3 else '!'}" for i in range(120))
    rows = D.chunk_text(spark.createDataFrame([(1, text), (2, "tiny"), (3, None), (4, "x" * 1200)], "id int, text string"), ["id"], size=200, overlap=40).orderBy("id", "position").collect()
    mine = [r for r in rows if r["id"] == 1]
    assert mine[0]["char_start"] == 0 and mine[-1]["char_end"] == len(text) and [r["position"] for r in mine] == list(range(len(mine)))
    for a, b in zip(mine, mine[1:]):
        assert b["char_start"] == a["char_end"] - 40 and a["chunk"] == text[a["char_start"] : a["char_end"]].strip() and a["chunk"][-1] in ".!"
    assert [r["chunk"] for r in rows if r["id"] == 2] == ["tiny"] and not [r for r in rows if r["id"] == 3]
    assert [r["char_start"] for r in rows if r["id"] == 4][:3] == [0, 160, 320]


def test_neighbours_in_ranges(spark):
    from filingscope.operators import documents as D

    rows = [("a", i) for i in range(50)] + [("b", 7)] + [(None, 1), (None, 2)] + [("c", i) for i in range(0, 30, 3)]
    df = spark.createDataFrame(rows, "company string, at int").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as there are partitions
    got = {(r["company"], r["at"]): r["previous"] for r in D.sections_pair_join(df, "company", "at").collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for c, i in rows:
        before = [j for d, j in rows if d == c and j < i]
        want[c, i] = max(before) if before else None
    assert got == want


def test_new_filings_keep_all_their_themes(spark):
    from filingscope.streaming import alerts

    stored = spark.createDataFrame([("1", "x")], "accession string, theme string")
    batch = spark.createDataFrame([("1", "y"), ("2", "x"), ("2", "y"), ("2", "y")], "accession string, theme string")
    out = alerts.incremental_theme_append(batch, stored)
    assert sorted(map(tuple, out.collect())) == [("1", "x"), ("2", "x"), ("2", "y")]
    assert alerts.incremental_theme_append(batch, out).count() == 3


def test_a_batch_of_several_tables_is_joined_once(spark):
    """As many exchanges whatever the number of a batch's parts; nulls are as in an anti join."""
    from filingscope.streaming import alerts

    kind = "accession string, theme string, n int"
    stored = spark.createDataFrame([("1", "x", 1), ("1", "x", 1), (None, "q", 0)], kind)
    batch = spark.createDataFrame([("1", None, None), ("1", "y", 1), ("2", None, None), ("2", None, None), ("2", "y", 2), (None, "q", 0), (None, "q", 0)], kind)
    out = alerts.incremental_theme_append(batch, stored)
    assert sorted(map(tuple, out.collect()), key=str) == [("1", "x", 1), ("1", "x", 1), ("2", "y", 2), ("2", None, None), (None, "q", 0), (None, "q", 0)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    several = plan(alerts.incremental_theme_append(batch.unionByName(batch).unionByName(batch), stored))
    assert (several.count("Join"), several.count("Exchange"), several.count("Sort [")) == (0, 1, 1)


def test_alerts_look_back_and_order(spark, tmp_path):
    from datetime import datetime

    from filingscope.streaming import alerts

    rows = [("3", "8-K", datetime(2026, 1, 9)), ("1", "8-K", datetime(2026, 1, 7)), ("2", "8-K", datetime(2025, 12, 1)), ("1", "8-K", datetime(2026, 1, 7)), ("4", "10-Q", datetime(2026, 1, 8))]
    df = spark.createDataFrame(rows, "accession string, form string, filed_at timestamp")
    assert [r["accession"] for r in alerts.new_filing_alerts(df, "8-K", 7).collect()] == ["1", "3"]
    assert [r["accession"] for r in alerts.new_filing_alerts(df, "8-K", 7, since=datetime(2025, 11, 1)).collect()] == ["2", "1", "3"]
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    found = alerts.new_filing_alerts(stream, "8-K", 30, since=datetime(2026, 1, 1))
    alerts.start(found, alerts.oldest_first(lambda batch, _: seen.extend(r["accession"] for r in batch.collect())), f"file://{tmp_path}/checkpoint").awaitTermination()
    assert seen == ["1", "3"]


def test_jdbc(spark):
    from filingscope.sources.filings import table_load_jdbc

    url, driver = "jdbc:derby:memory:filings;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(100).withColumn("form", F.concat(F.lit("F"), F.col("id").cast("string")))
    try:
        rows.write.format("jdbc").option("url", url).option("dbtable", "filing").option("driver", driver).mode("overwrite").save()
    except Exception as e:
        if "ClassNotFound" in str(e):
            pytest.skip("no JDBC driver here")
        raise
    got = table_load_jdbc(spark, url, "filing", "id", (0, 100), 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100 and {r["form"] for r in got.collect()} == {f"F{i}" for i in range(100)}


def test_radar_reads_its_tables_once(spark, sf):
    from filingscope.plans.fixtures import radar

    r = radar(spark, sf).materialise()
    for out in (r.category_summary(), r.filer_moves(), r.audit_rows(), r.raw_matched_holdings(), r.radar_coverage(), r.current_holders_by_category()):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= 3 and "l_suppkey" not in plan
    folders = [t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://") for t in (r.pairs, r.matches, r.watched)]
    assert all(map(os.path.exists, folders))
    r.drop()
    assert not any(map(os.path.exists, folders))


def test_lazy_radar_prunes_by_quarter(spark, sf):
    from filingscope.plans.fixtures import radar

    plan = radar(spark, sf).security_positions()._jdf.queryExecution().executedPlan().toString()
    bounds = re.findall(r"l_shipdate#\d+ (>= 2001-04-01|< 2001-10-01)", plan)
    assert len(bounds) >= 6  # at each scan of line items


def test_each_keyword_has_its_snippet_even_if_they_are_equal(spark):
    from filingscope.operators import documents as D

    docs = spark.createDataFrame([(1, "The apache license holds."), (2, "none")], "doc long, text string")
    found = D.keyword_search(docs, ["the", "apache license"], ["doc"]).collect()
    assert [(r["doc"], r["hits"], r["snippets"]) for r in found] == [(1, 2, ["The apache license holds."] * 2)]
