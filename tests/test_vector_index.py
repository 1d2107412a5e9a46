"""The inverted file against the exact search."""

import numpy as np

from filingscope.operators import documents as D, vector_index as V
from filingscope.plans.registry import QUERIES


def recall(exact, found):
    want = {(r.query_id, r.id) for r in exact.collect()}
    return len(want & {(r.query_id, r.id) for r in found.collect()}) / len(want)


def test_recall_on_vectors_without_structure(spark, sf):
    assert recall(QUERIES["vector_top_k"](spark, sf), QUERIES["vector_top_k_ivf"](spark, sf)) >= 0.95


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    rows = [(i, (centers[i % 30] + 0.05 * rng.normal(size=16)).tolist(), "c") for i in range(3000)]
    rows += [(5000, [0.0] * 16, "c"), (5001, None, "c"), (5002, rows[0][1], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, company string").repartition(3)
    queries = table.filter("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding as query", "cast(null as string) as company")
    centroids = V.fit_centroids(table, 40)
    index = V.assign(table, centroids).cache()
    assert index.count() == 3002
    probes = V.probes_for(table, index, queries, centroids, 0.97)
    assert probes <= 8
    exact = D.vector_top_k(table, queries)
    assert recall(exact, V.search(index, queries, centroids, probes)) >= 0.95
    whole = V.search(index, queries, centroids, len(centroids))
    assert sorted(map(tuple, whole.select("query_id", "id", "similarity", "rank").collect())) == sorted(map(tuple, exact.filter("id <> 5001").select("query_id", "id", "similarity", "rank").collect()))


def test_no_rows(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<double>, company string")
    centroids = V.fit_centroids(table, 4)
    assert len(centroids) == 0
