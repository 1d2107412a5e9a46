import json
from datetime import date

from filingscope.operators import documents as D, exposure as X, offerings as O
from filingscope.sources import filings as S
from filingscope.streaming import alerts

TABLE = '<ns1:informationTable xmlns:ns1="u"><ns1:infoTable><ns1:nameOfIssuer>Apple Inc</ns1:nameOfIssuer><ns1:cusip>037833100</ns1:cusip><ns1:value>1,000</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>10</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType></ns1:shrsOrPrnAmt></ns1:infoTable><ns1:infoTable><ns1:value>5</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>1</ns1:sshPrnamt></ns1:shrsOrPrnAmt><ns1:putCall>Put</ns1:putCall></ns1:infoTable></ns1:informationTable>'


def test_tsv_without_quotes(spark, tmp_path):
    (tmp_path / "i.tsv").write_text('﻿ACCESSION NUMBER\tNAMEOFISSUER\tCUSIP\tVALUE\tSSHPRNAMT\tSSHPRNAMTTYPE\tPUTCALL\na\t"Quoted\tx\t1,5\t2\tSH\t\n')
    raw = S.scan_bulk_tsv(spark, f"file://{tmp_path}/i.tsv")
    assert raw.columns[0] == "ACCESSION_NUMBER" and raw.first()["PUTCALL"] == ""
    h = S.bulk_holdings(raw.withColumnRenamed("ACCESSION NUMBER", "ACCESSION_NUMBER")).first()
    assert (h["issuer"], h["value"], h["putcall"]) == ('"QUOTED', 15.0, None)


def test_13f_xml_and_wrapper(spark):
    rows = S.scan_13f_xml(spark.createDataFrame([("a", TABLE)], "k string, xml string"), ["k"]).collect()
    assert [(r["issuer"], r["value"], r["shares"], r["putcall"]) for r in rows] == [("APPLE INC", 1000.0, 10.0, None), ("UNKNOWN", 5.0, 1.0, "Put")]
    text = f"<XML><edgarSubmission><periodOfReport>03-31-2026</periodOfReport></edgarSubmission></XML> <XML>{TABLE}</XML>"
    rows = S.scan_13f_submission_text(spark.createDataFrame([("a", text)], "k string, text string"), ["k"]).collect()
    assert len(rows) == 2 and rows[0]["report_date"] == "2026-03-31"
    assert S.scan_13f_xml(spark.createDataFrame([("a", None), ("b", ""), ("c", "<x>broken")], "k string, xml string"), ["k"]).count() == 0


def test_json_sources(spark):
    sub = json.dumps({"cik": "0000320193", "name": "A", "filings": {"recent": {"accessionNumber": ["0000-1"], "form": ["10-K"], "filingDate": ["2026-01-02"], "reportDate": [""], "primaryDocument": ["d.htm"]}}})
    r = S.scan_submissions(spark.createDataFrame([("a", sub), ("b", "{broken")], "k string, json string"), ["k"]).collect()
    assert len(r) == 1 and r[0]["url"].endswith("/320193/00001/d.htm") and r[0]["report_date"] is None
    hits = json.dumps({"hits": {"hits": [{"_id": "0001-1:doc.htm", "_source": {"ciks": ["1"], "display_names": ["N"], "form": "8-K", "file_date": "2026-01-01", "adsh": ""}}, {"_id": "0001-1:x.htm", "_source": {"ciks": [], "adsh": "q"}}]}})
    r = S.scan_search_hits(spark.createDataFrame([("a", hits)], "k string, json string"), ["k"]).collect()
    assert [(x["accession"], x["document"]) for x in r] == [("0001-1", "doc.htm")]


def test_documents_and_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert S.scan_documents(spark, f"file://{tmp_path}/a.txt").first()["text"] == "one\ntwo"
    S.csv_sink(spark.createDataFrame([(["a", "b"], 1)], "x array<string>, n int"), f"file://{tmp_path}/out")
    assert '"a; b","1"' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))


def test_sections(spark):
    text = "Item 1A. Risk Factors we may fail " + "x" * 600 + " Item 1B. none Item 7. Management says Item 8. end"
    r = D.extract_sections(spark.createDataFrame([(text,), ("nothing",), (None,)], "text string")).collect()
    assert r[0]["risk_factors"].startswith("Item 1A") and "1B" not in r[0]["risk_factors"] and r[0]["mda"] == "Item 7. Management says "
    assert r[1]["mda"] is None and r[2]["risk_factors"] is None


def test_chunks_cover_the_text():
    text = " ".join(f"Sentence number {i} ends here." for i in range(200))
    chunks = D.cut_text(text)
    assert chunks[0][1] == 0 and chunks[-1][2] == len(text)
    assert all(a[2] >= b[1] for a, b in zip(chunks, chunks[1:])) and D.cut_text("") == D.cut_text(None) == []


def test_exposure(spark):
    html = "<table><tr><td>Acme Rocket Corp preferred shares</td><td>$1,234,567 fair value 037833100</td></tr></table>"
    docs = spark.createDataFrame([("a", "d", html), ("b", "d", "<p>A launch contract with Acme Rocket Corp.</p>"), ("c", "d", "<p>other</p>")], "accession string, document string, html string")
    got = {r["accession"]: r for r in X.exposure_parse_documents(docs, ["accession", "document"], ["Acme Rocket"]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["relation"], got["a"]["confidence"], got["a"]["amount"], got["a"]["cusip"]) == ("portfolio_schedule_holding", 0.74, 1234567.0, "037833100")
    assert (got["b"]["relation"], got["b"]["confidence"]) == ("commercial_context", 0.62)


def test_financials():
    html = "<table><tr><td>in thousands</td></tr><tr><td>Revenue</td><td>$</td><td>1,200</td></tr><tr><td>Net loss</td><td>(300)</td></tr></table>"
    assert O.table_financials(html) == {"revenue": 1.2e6, "net_income": -3e5, "total_assets": None}
    assert O.table_financials(None)["revenue"] is None


def test_stream_emits_each_filing_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "10-K", "T"), ("b", "8-K", "T"), ("a", "10-K", "T")], "accession string, form string, ticker string").selectExpr("*", "timestamp'2026-01-01' as filed_at")
    src = f"file://{tmp_path}/in"
    rows.write.parquet(src)
    seen = []
    stream = alerts.new_filing_alerts(spark.readStream.schema(rows.schema).parquet(src), "10-K")
    for _ in range(2):
        alerts.start(stream, lambda df, n: seen.extend(r["accession"] for r in df.collect()), f"file://{tmp_path}/ck").awaitTermination()
        rows.write.mode("append").parquet(src)
    assert seen == ["a"]


def test_any_number_of_queries_is_resolved(spark):
    from filingscope.operators import signals as G

    companies = spark.createDataFrame([("1", "AB-C", "Acme Rocket Corp"), ("2", "XY", "Acme Rocket"), ("3", "Q", "Zé Holdings International")], "cik string, ticker string, title string")
    few = spark.createDataFrame([(x,) for x in ("0012", "ab.c", "acme rocket", "rocket c", "cme", "é h", "e", "dings internationa", "nowhere", "", None)], "query string")
    many = spark.range(50_001).selectExpr("concat('no such company ', id) as query")
    got = {r["query"]: (r["cik"], r["by"]) for r in G.entity_resolve(few.union(many), companies).collect()}
    assert got == {"0012": ("12", "cik"), "ab.c": ("1", "ticker"), "acme rocket": ("2", "title"), "rocket c": ("1", "contains"), "cme": ("2", "contains"), "é h": ("3", "contains"), "e": ("2", "contains"), "dings internationa": ("3", "contains")}


def test_more_vector_queries_than_are_broadcast(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], "ab"[i % 2]) for i in range(12)], "vec_id long, embedding array<double>, company string")
    asked = rows.selectExpr("vec_id as query_id", "embedding as query", "if(vec_id = 3, null, company) as company")
    few, many = (sorted(map(tuple, D.vector_top_k(rows, asked, 4, company_col="company", most_queries=n).collect())) for n in (100, 5))
    assert few == many and len(few) == 48


def test_snapshots(spark, tmp_path):
    from filingscope.operators import maintenance as M

    rows = spark.createDataFrame([("a", "X", 1.0, 2.0), (None, "X", 1.0, 2.0)], "accession string, issuer string, value double, shares double")
    path = f"file://{tmp_path}/snap"
    for current in ("2025-Q4", "2026-Q1"):
        M.snapshot_write(rows, path, current, "2025-Q3", "h1", ["a"])
    found, manifest = M.snapshot_read(spark, path, "2026-Q1", "2025-Q3", "h2", ["a", "b"])
    assert found.count() == 1 and len(manifest.first()["warnings"]) == 2
    assert [r["current_quarter"] for r in M.snapshot_list(spark, path).collect()] == ["2026-Q1", "2025-Q4"]
    assert date.today()


def test_documents_are_listed_by_tasks(spark, tmp_path):
    from filingscope.plans.registry import ORACLES, QUERIES
    from filingscope.sources import whole

    for i in range(3):
        (tmp_path / "in" / f"f{i}" / "deep").mkdir(parents=True)
        (tmp_path / "in" / f"f{i}" / "deep" / "x.txt").write_text(f"text {i}\n")
    (tmp_path / "in" / "loose.txt").write_text("")
    (tmp_path / "in" / "_SUCCESS").write_text("no")
    rows = S.scan_documents(spark, f"file://{tmp_path}/in")
    assert sorted(r["text"] for r in rows.collect()) == ["", "text 0\n", "text 1\n", "text 2\n"]
    # the driver knows folders and loose files, not what the folders hold
    parts = whole.WholeReader(rows.schema, f"file://{tmp_path}/in").partitions()
    assert [len(p.files) for p in parts] == [0, 0, 0, 1]
    # by a glob, Spark's reader finds the same
    assert S.scan_documents(spark, f"file://{tmp_path}/in/f*/deep").count() == 3

    docs = spark.createDataFrame([(1, "a\r\nb"), (1, "a\r\nb"), (2, None), (None, " c "), (-3, "")], "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    import duckdb

    want = duckdb.sql(ORACLES["scan_documents"].replace("documents", f"'{tmp_path}/odd/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, QUERIES["scan_documents"](spark, f"file://{tmp_path}/odd").collect()))) == sorted(map(str, want))


def test_xml_is_parsed_once(spark):
    docs = spark.createDataFrame([("a", TABLE), ("b", None), ("c", "")], "k string, xml string")
    wrapped = docs.selectExpr("k", "concat('<XML>', xml, '</XML>') as text")
    fund = docs.selectExpr("k", "'<invstOrSecs><invstOrSec><name>Red</name><balance>1</balance></invstOrSec></invstOrSecs>' as xml")
    for rows, n in ((S.scan_13f_xml(docs, ["k"]), 2), (S.scan_13f_submission_text(wrapped, ["k"]), 2), (S.scan_nport_xml(fund, ["k"], ["red"]), 3), (S.scan_form4_xml(docs, ["k"]), 0)):
        assert rows.count() == n
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml(") + plan.count("XmlToStructs") <= 1 and plan.count("xmlns") <= 1, plan


def test_only_pieces_that_are_asked_for_are_grouped(spark):
    from filingscope.operators import signals as G

    companies = spark.createDataFrame([("1", "A", "Acme Rocket Corp"), ("2", "B", "Acme Rocket")], "cik string, ticker string, title string")
    found = G.entity_resolve(spark.createDataFrame([("cme",)], "query string"), companies)
    assert [tuple(r) for r in found.collect()] == [("cme", "2", "contains")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Repartition" in plan
