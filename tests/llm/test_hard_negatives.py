"""Hard negatives against all pairs: lengths that differ widely, ties, repeated ids, odd rows, pruned and unpruned buckets."""

import math
import random

import numpy as np
import pytest

from filingscope.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<float>, label int, slot string, rank string"


def relabelled(rows):
    return [(i, v, (lab + 1) % 10 if i is not None and lab is not None and i % 7 == 0 else lab) for i, v, lab in rows]


def brute(rows):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in relabelled(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, v, lab) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(rows) if b != a]
        for s, j, _ in sorted((x for x in scored if x[2] == lab), key=order)[:5]:
            hard = sorted((x for x in scored if x[2] != lab and 50 * s <= 100 * x[0] <= 95 * s), key=order)[:3]
            out += [(i, j, r, n, s, t) for r, (t, n, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def vectors(seed, n, spread, dims=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = math.exp(rng.gauss(0, spread))
        rows.append((i, [size * rng.gauss(0, 1) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2, 9])))
    return rows


ODD = [(7000, None, 1), (7001, [1.0, None, 2.0], 1), (7002, [float("nan")] * 6, 1), (7050, [1.0] * 6, None), (7100, [float("inf")] * 6, 0), (7150, [], 0), (7200, [0.0] * 6, 0), (7250, [1.0, -1.0], 1), (None, [1.0] * 6, 0), (None, [0.4] * 6, 1)]
TIES = [(8000 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.25], i % 2) for i in range(40)] + [(8000, [0.5, 0.5, 0.0, 0.0, 0.0, 0.25], 0)]


def got(spark, rows, parts=3):
    from filingscope.llm.queries import _relabelled

    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS).repartition(parts)
    found = H.mine_negatives(_relabelled(df)).collect()
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found), key=str)


@pytest.mark.parametrize("seed, spread, few", [(1, 0.0, 0.25), (2, 1.5, 0.25), (3, 1.5, 1.0), (4, 0.7, 0.0)])
def test_negatives_equal_all_pairs(spark, monkeypatch, seed, spread, few):
    for name, value in (("BUCKET", 37), ("BLOCK", 5), ("KEPT", 2), ("FEW", few)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(seed, 600, spread) + ODD + TIES
    assert got(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [x * 3e5 for x in v], lab) for i, v, lab in vectors(5, 150, 0.5)] + [(50, [2.0**21, 1.0, 0.0, 0.0, 0.0, 0.0], 3), (151, [2.0**21, 3.0, 0.0, 0.0, 0.0, 0.0], 3), (152, [2.0**20, 5.0, 0.0, 0.0, 0.0, 1.0], 1)]
    assert got(spark, rows) == brute(rows)


def test_pruning_keeps_all_that_reach_and_drops_others():
    rng = np.random.default_rng(3)
    make = lambda n: {"label": 1, "most": 0, "ids": H.pack(np.arange(n)), "rows": H.pack(np.arange(n)), "needs": b""}
    v, a = (np.round(H.shares(rng.normal(size=(n, 4))) * 1000) for n in (500, 20))
    lists = np.argsort(H.shares(v), axis=0, kind="stable").astype(np.uint16).T.copy()
    bucket = H.Bucket(make(500) | {"vectors": H.store(v), "lists": H.pack(lists), "most": float(np.linalg.norm(v, axis=1).max())})
    block = H.Bucket(make(20) | {"vectors": H.store(a), "lists": b""})
    need = np.sort(a @ v.T, axis=1)[:, -3].astype(np.int64)
    whole, some = H.candidates(block, bucket, need)
    looked = 0
    for i, found in some:
        looked += len(found)
        assert set(np.flatnonzero((a @ v.T)[i] >= need[i])) <= set(found.tolist())
    assert some and looked < 0.25 * 500 * len(some) and len(whole) + len(some) <= 20


def test_no_rows_and_no_anchors(spark):
    assert got(spark, []) == [] == got(spark, vectors(1, 40, 1)[1:])
