"""Records by byte ranges: whole whatever the ranges, and only the columns that are asked for."""

import io
import random

import pytest

from filingscope.sources import filings as SRC, marked as M


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 20])
def test_every_record_is_in_one_range(monkeypatch, piece):
    monkeypatch.setattr(M, "PIECE", piece)
    rng = random.Random(2)
    for _ in range(60):
        data = "".join(rng.choice(["<e>", "<e", "e>", "x", "é", "\n", "<e><e>"]) for _ in range(rng.randint(0, 40))).encode()
        places = [i for i in range(len(data)) if data.startswith(b"<e>", i)]
        want = [(a, data[a:b]) for a, b in zip(places, [*places[1:], len(data)])]
        for split in (1, 2, 5, 1000):
            got = [r for a in range(0, len(data), split) for r in M.records(io.BytesIO(data), b"<e>", a, min(a + split, len(data)))]
            assert got == want


def test_submissions_of_landed_files(spark, tmp_path):
    block = "<XML><informationTable><periodOfReport>06-30-2001</periodOfReport>{}</informationTable></XML>"
    row = "<infoTable><nameOfIssuer>i{}</nameOfIssuer><value>1,0{}</value><shrsOrPrnAmt><sshPrnamt>{}</sshPrnamt></shrsOrPrnAmt></infoTable>"
    texts = [f"<SEC-DOCUMENT>{i}.txt\nACCESSION NUMBER:\t\t000-{i}\n" + block.format("".join(row.format(j, i % 10, j) for j in range(i % 4 + 1))) + "\n" for i in range(200)]
    for n in range(2):
        (tmp_path / f"part{n}.txt").write_text("header\n" + "".join(texts[n::2]))
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "_SUCCESS").write_text("<SEC-DOCUMENT>")
    got = M.scan_submission_files(spark, f"file://{tmp_path}", split_bytes=3_000)
    assert got.rdd.getNumPartitions() > 20
    assert sorted(r["text"] for r in got.collect()) == sorted(texts)
    rows = SRC.scan_13f_submission_text(got.select("accession", "text"), ["accession"])
    assert rows.count() == sum(i % 4 + 1 for i in range(200)) and {r["report_date"] for r in rows.collect()} == {"2001-06-30"}
    pruned = M.scan_submission_files(spark, f"file://{tmp_path}", ["accession"])
    assert pruned.columns == ["accession"] and sorted(r[0] for r in pruned.collect()) == sorted(f"000-{i}" for i in range(200))


def test_feeds_of_landed_files(spark, tmp_path):
    entry = '<entry><title>{f} - Name {i} ({i}) (Filer)</title><link rel="alternate" href="https://x/{i}.htm"/><summary>&lt;b&gt;Filed:&lt;/b&gt; 2026-01-0{d}</summary></entry>\n'
    (tmp_path / "feed.xml").write_text("<feed>" + "".join(entry.format(f="8-K", i=i, d=i % 9 + 1) for i in range(50)) + "<entry><title>broken</title></entry></feed>")
    got = M.scan_feed_files(spark, f"file://{tmp_path}/feed.xml", split_bytes=500)
    assert sorted(tuple(r) for r in got.select("cik", "name", "form", "date", "link").collect()) == sorted((str(i), f"Name {i}", "8-K", f"2026-01-0{i % 9 + 1}", f"https://x/{i}.htm") for i in range(50))
    assert M.scan_feed_files(spark, f"file://{tmp_path}/feed.xml", ["form"]).columns == ["form"]


def test_no_files_and_unknown_columns(spark, tmp_path):
    assert M.scan_submission_files(spark, f"file://{tmp_path}").collect() == []
    with pytest.raises(Exception, match="no pattern"):
        spark.dataSource.register(M.MarkedFiles)
        spark.read.format("marked").schema("other string").option("path", f"file://{tmp_path}").option("marker", "x").load().collect()
