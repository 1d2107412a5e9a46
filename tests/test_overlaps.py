"""Overlaps of portfolios: the closest pair and blocks of holders against all pairs."""

import itertools
import random

from filingscope.operators import portfolio as P


def positions(spark, seed, filers=40):
    draw = random.Random(seed)
    held = {f"c{i}": draw.sample(range(30), draw.randint(1, 12)) for i in range(filers)}
    rows = [(c, f"s{x}", float(x), 1.0 + x) for c, xs in held.items() for x in xs] + [("lone", "own", 1.0, 1.0)]
    return held, spark.createDataFrame(rows, "cik string, security string, shares double, value double")


def test_closest_pair_is_that_of_all_pairs(spark):
    for seed in range(3):
        held, rows = positions(spark, seed)
        want = min(itertools.combinations(sorted(held), 2), key=lambda p: (-len(set(held[p[0]]) & set(held[p[1]])), p))
        assert P.closest_pair(rows) == want
    assert P.closest_pair(rows.filter("cik = 'lone'")) is None
    assert P.closest_pair(rows.filter("cik in ('lone', 'c1')")) is None


def test_no_task_has_all_pairs_of_a_security(spark):
    _, rows = positions(spark, 5)
    whole, cut = (sorted(map(tuple, P.portfolio_overlap_all_pairs(rows, block=n).collect())) for n in (1000, 3))
    assert whole == cut and len(whole) > 500
    assert {"i", "j"} <= {x for x in P.portfolio_overlap_all_pairs(rows)._jdf.queryExecution().optimizedPlan().toString().replace("#", " ").replace("(", " ").split()}


def test_blocks_lose_and_add_no_pair(spark):
    """Blocks in the order of ciks, also with equal ciks on both sides of a cut, nulls and numbers that are none."""
    rows = [(f"c{i // 2}", "s", 1.0, float(i % 3)) for i in range(24)] + [(None, "s", 1.0, 1.0), ("c1", None, 1.0, 1.0), ("c2", None, 1.0, 1.0), ("c3", "t", None, None), ("c4", "t", 1.0, float("nan")), ("c5", "u", 1.0, 1.0)]
    want = sorted(repr((s, a, n, x, b, m, y, None if x is None or y is None else x + y)) for a, s, n, x in rows for b, z, m, y in rows if a and b and s and s == z and a < b)
    table = spark.createDataFrame(rows, "cik string, security string, shares double, value double")
    for block in (1, 3, 1000):
        assert sorted(repr(tuple(r)) for r in P.portfolio_overlap_all_pairs(table, block=block).collect()) == want


def test_a_file_of_all_pairs_is_small(spark, tmp_path):
    """A filer's rows stand together, in the order of the others' values."""
    draw = random.Random(7)
    rows = spark.createDataFrame([(f"c{i:04}", "s", 1.0, draw.randrange(8) + 0.5) for i in range(1200)], "cik string, security string, shares double, value double")
    P.portfolio_overlap_all_pairs(rows, block=100).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 1200 * 1199 // 2
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 1200 * 1199 // 2
