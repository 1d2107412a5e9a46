"""The automaton against containment of every pattern in every text."""

import random

from pyspark.sql import functions as F

from filingscope.operators import matching as M
from filingscope.operators.automaton import contained

WORDS = ["ALPHABET", "GOOGLE", "ACME", "ROCKET", "HOLDINGS", "INC", "CLASS A", "CL C", "NORTH", "STAR", "É", "X"]


def test_contained_equals_all_pairs_in_any_number_of_passes(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(900, None), (901, "")]
    patterns = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "id int, text string, pattern string").repartition(3)
    table = spark.createDataFrame([(p,) for p in [*patterns, "", None]], "pattern string")
    want = sorted({(i, p) for i, t in texts for p in patterns if t and p in t})
    for most in (10**6, 100):
        assert sorted(map(tuple, contained(df, table, ["id"], "text", most).collect())) == want
    assert contained(df, table.filter("false"), ["id"], "text").collect() == []


def watchlists(rng, n):
    make = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
    return {"a": [(rng.choice(["GOOG", "GOOGL", "googl", "T", "ABCD"]), make(), [make() for _ in range(2)]) for _ in range(n)]}


def test_watchlist_by_automaton_equals_nested_loop(spark):
    rng = random.Random(2)
    issuers = spark.createDataFrame([(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) if i else None,) for i in range(300)], "issuer string")
    table = M.alias_table(spark, watchlists(rng, 60))
    loop, machine = (sorted(map(tuple, M.issuer_watchlist_match(issuers, table, few=few).collect())) for few in (10**6, 0))
    assert loop == machine and len(loop) > 500


def test_fifty_thousand_aliases_without_a_nested_loop(spark):
    names = spark.range(5_000).select(F.concat(F.lit("Company "), "id", F.lit(" Holdings")).alias("issuer"))
    rows = [(f"c{i % 9}", f"T{i}", f"Company {i}", f"company {i} holdings") for i in range(60_000)]
    table = spark.createDataFrame(rows, M.ALIAS_SCHEMA)
    table = table.withColumns({"item_key": F.col("ticker"), "alias_norm": M.normalize_issuer("alias"), "alias_compact": M.compact_issuer("alias")})
    got = M.issuer_watchlist_match(names, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.filter("issuer = concat('Company ', substring(ticker, 2), ' Holdings')").count() == 5_000
