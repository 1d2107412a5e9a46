"""Searches of the index against the scan of all texts, for a thousand lists."""

import random

from pyspark.sql import functions as F

from filingscope.operators import documents as D, keyword_index as K


def test_a_thousand_lists_equal_the_scan(spark):
    rng = random.Random(7)
    words = ["ab", "a", "b", "abab", "bab", "Ab", "c", "abc", "é", "c.", "ba"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t "]) for _ in range(n))
    texts = [(i, rng.choice(["", " "]) + text(rng.randint(0, 14))) for i in range(120)] + [(500, None), (501, ""), (502, "ab ab ab abab ab")]
    lists = [(n, " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 2, 3, 4])))) for n in range(1000) for _ in range(rng.randint(1, 3))]
    lists += [(0, ""), (1, "  AB "), (2, "a  b"), (2, "nowhere"), (3, None)]
    docs = spark.createDataFrame([(*t, "clash", "clash") for t in texts], "doc int, text string, word string, keyword string").repartition(3)
    index = K.postings(docs, ["doc"])
    got = {(r["list"], r["doc"]): (r["matched"], r["hits"]) for r in K.keyword_lists_search(index, spark.createDataFrame(lists, "list int, keyword string"), ["doc"]).collect()}
    import re

    want = {}
    for n in {n for n, _ in lists}:
        own = sorted({k.strip(" ").lower() for m, k in lists if m == n and k and k.strip()})
        for doc, t in texts:
            low = re.sub(r"[ \t\n\r\f\x0b]+", " ", t).lower() if t else ""
            hits = {k: low.count(k) for k in own}
            if any(hits.values()):
                want[n, doc] = ([k for k in own if hits[k]], sum(hits.values()))
    assert got == want
    first = [k for n, k in lists if n == 7]
    scan = {r["doc"]: (sorted(r["matched"]), r["hits"]) for r in D.keyword_search(docs, first, ["doc"]).collect()}
    assert scan == {doc: x for (n, doc), x in got.items() if n == 7}


def test_common_words_lie_in_several_ranges(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("doc"), F.concat(F.lit("the same "), F.col("id").cast("string")).alias("text")).repartition(8)
    merges = "spark.sql.adaptive.coalescePartitions.enabled"  # so small a table would be one file
    spark.conf.set(merges, "false")
    K.postings(docs, ["doc"]).write.parquet(f"file://{tmp_path}/index")
    spark.conf.unset(merges)
    index = spark.read.parquet(f"file://{tmp_path}/index")
    assert index.filter("word = 'the'").select(F.input_file_name().alias("f")).distinct().count() > 1
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,the)]" in index.filter("word = 'the'")._jdf.queryExecution().executedPlan().toString()
    assert K.keyword_hits(index, spark.createDataFrame([("the same 1999",)], "keyword string"), ["doc"]).count() == 11


def test_hits_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    """Twice the postings take twice the tasks, and nothing is grouped before it is dealt out."""
    texts = [(i, " ".join(("ab c abab c", "c ab", "xab cx ab c")[(i + j) % 3] for j in range(i % 5))) for i in range(60)]
    asked = ["ab", "c", "ab c", "c ab", "c abab c"]
    monkeypatch.setattr(K, "POSTINGS", 20)
    for times in (1, 2):
        docs = spark.createDataFrame([(i + 60 * k, t) for k in range(times) for i, t in texts], "doc int, text string")
        index = K.postings(docs, ["doc"])
        hits = K.keyword_hits(index, spark.createDataFrame([(k,) for k in asked], "keyword string"), ["doc"])
        plan = hits._jdf.queryExecution().executedPlan().toString()
        dealt = sum(len(set(t.split())) for _, t in texts) * times // 20 + 1
        assert plan.count(f", {dealt}), REPARTITION_BY_NUM") == 2 and plan.count("Exchange hashpartitioning(keyword#") == 2
        want = {(k, i + 60 * m): t.count(k) for m in range(times) for i, t in texts for k in asked if k in t}
        assert {(r["keyword"], r["doc"]): r["hits"] for r in hits.collect()} == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc int, text string")
    assert K.keyword_lists_search(K.postings(docs, ["doc"]), spark.createDataFrame([(1, "a")], "list int, keyword string"), ["doc"]).collect() == []
