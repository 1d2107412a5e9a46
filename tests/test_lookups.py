"""Lookups of many names and terms at once against one by one."""

import random

from pyspark.sql import functions as F

from filingscope.operators import documents as D, signals as G

NAMES = "cik string, ticker string, title string, position int"


def companies(spark, rng, n=150):
    words = ["Acme", "Rocket", "Holdings", "International", "of", "Zé", "A", "AB", "Abc", "Holding"]
    rows = [(str(i), rng.choice(["T", "AB", "acme"]) + str(i % 90), " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, NAMES)


def test_contained_names_equal_a_search_of_all_titles(spark):
    rng = random.Random(3)
    rows, table = companies(spark, rng)
    queries = sorted({t[a : a + n] for _, _, t, _ in rows for a, n in [(rng.randint(0, 9), rng.randint(1, 25))]} | {"HOLDINGS", "oldings i", "no such thing", "HOLDINGS X"})
    got = {r["query"]: (r["cik"], r["by"]) for r in G.entity_resolve(spark.createDataFrame([(q,) for q in queries], "query string"), table).collect()}
    want = {}
    for q in queries:
        u = q.strip().upper()
        tickers = [c for c, k, _, _ in rows if k.upper() == u.replace(".", "-")]
        titles = [c for c, _, t, _ in rows if t.upper() == u]
        parts = [(len(t), c) for c, _, t, _ in rows if u and u in t.upper()]
        found = (min(tickers), "ticker") if tickers else (min(titles), "title") if titles else (min(parts)[1], "contains") if parts else None
        if found:
            want[q] = found
    assert got == want


def test_names_that_end_alike_meet_by_their_rarest_piece(spark):
    """A hundred thousand names with one ending: as many pairs as names, not their square."""
    table = spark.range(100_000).select(F.col("id").cast("string").alias("cik"), F.concat(F.lit("T"), "id").alias("ticker"), F.concat(F.lit("Company number "), F.lpad("id", 6, "0"), F.lit(" International Holdings")).alias("title"))
    queries = table.select(F.substring("title", 3, 60).alias("query"))
    assert G.entity_resolve(queries, table).filter("by = 'contains'").count() == 100_000


def test_terms_equal_one_by_one(spark):
    rng = random.Random(5)
    rows, table = companies(spark, rng)
    table = table.unionByName(spark.createDataFrame([("3", "new", "Later Title Acme", 999)], NAMES))  # the last title counts
    terms = ["a", "AB", "acme", "ab ro", "holdings acme", " ACME3 ", "holding holdings", "zé", "new", "later", "no", "", "  ", "t1", "T1", "int of hold"]
    got = {}
    for r in D.autocomplete_terms(table, spark.createDataFrame([(t,) for t in [*terms, None]], "term string")).orderBy("term", "rank").collect():
        got.setdefault(r["term"], []).append(r["cik"])
    for t in terms:
        want = [r["cik"] for r in D.ticker_autocomplete(table, t).collect()]
        assert got.get(t, []) == want, t


def test_thousands_of_terms_and_a_beginning_that_all_have(spark):
    table = spark.range(20_000).select(F.col("id").cast("string").alias("cik"), F.concat(F.lit("s"), "id").alias("ticker"), F.concat(F.lit("Supplier "), "id").alias("title"), F.col("id").alias("position"))
    terms = spark.range(5_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), "id")).otherwise(F.concat(F.lit("supp "), "id")).alias("term")).union(spark.sql("select 's'"))
    got = D.autocomplete_terms(table, terms)
    assert got.select("term").distinct().count() == 5_001 and got.filter("rank = 1 and term like 's%' and term <> 's' and ticker <> term and term not like 'supp%'").count() == 0
    assert [r["cik"] for r in got.filter("term = 's'").orderBy("rank").collect()] == [str(i) for i in range(10)]
