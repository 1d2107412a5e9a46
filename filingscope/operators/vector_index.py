"""An inverted file of vectors: every row belongs to the centroid it is most like; a query looks into the nearest lists only.

Centroids are fitted on a sample of at most `sample` rows (those of least hash, the same in every run); every row is
assigned. What is found is ranked by its exact similarity. How many lists a query must look into for a recall is
measured on sample queries, which are searched exactly: vectors without structure need many, clustered ones few.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.operators.documents import vector_top_k

#: Rows on which centroids are fitted at most, and queries by which recall is measured.
SAMPLE, MEASURED = 20_000, 200
#: Vectors and queries of a block; by how much a similarity may be less than another that it equals when rounded.
BLOCK, ROUNDED = 1024, 0.0011


def _unit(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


def fit_centroids(vectors: DataFrame, lists: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Centroids of at most `lists` clusters by spherical k-means on a sample of bounded size."""
    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("v")).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
    data = _unit(np.array([r.v for r in rows], np.float64)) if rows else np.zeros((0, 1))
    centroids = data[: min(lists, len(data))].copy()
    for _ in range(rounds if len(centroids) else 0):
        own = (data @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, data)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centroids)
    return centroids


def _nearest(rows: DataFrame, vector_col: str, centroids: np.ndarray, n: int, keep: list[str]) -> DataFrame:
    """Each row with the n lists most like its vector, nearest first (column lists)."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "lists array<int>"])

    def find(batches):
        for b in batches:
            at = len(keep)
            m = np.array(b.column(at).to_pylist(), np.float64).reshape(b.num_rows, -1)
            likes = _unit(m) @ sent.value.T if b.num_rows else np.zeros((0, 1))
            order = np.argsort(-likes, axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), pa.array(order.tolist(), pa.list_(pa.int32()))], names=[*keep, "lists"])

    return rows.select(*keep, F.col(vector_col).alias("_v")).filter("_v is not null").mapInArrow(find, schema)


def assign(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", company_col: str | None = None) -> DataFrame:
    """(list, id, v, own): every row with a vector in its list, sorted by list and company in ranges, so a long list is several files."""
    own = F.lower(company_col) if company_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), own.alias("own"))
    found = _nearest(rows, "v", centroids, 1, ["id", "v", "own"]).select(F.get("lists", F.lit(0)).alias("list"), "id", "v", "own")
    return found.repartitionByRange("list", "own", "id").sortWithinPartitions("list", "own", "id")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(list, company, id, v) in the order of list and company -> rows of at most size vectors of one list and company."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches):
        held, key = [], None

        def flush():
            m = np.array([x[1] for x in held], np.float64)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.string()), pa.array([[x[0] for x in held]], pa.list_(ids)), pa.array([m.tobytes()], pa.binary())], names=["list", "company", "ids", "vectors"])

        for b in batches:
            ids = b.column(2).type
            for number, company, own, v in zip(*(c.to_pylist() for c in b.columns)):
                if held and ((number, company) != key or len(held) >= size):
                    yield flush()
                    held = []
                key = (number, company)
                held.append((own, v))
        if held:
            yield flush()

    return rows.select("list", "company", "id", "v").mapInArrow(pack, f"list int, company string, ids array<{kind}>, vectors binary")


def search(index: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int, k: int = 10) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar rows of the `probes` lists nearest to each query.

    queries: query_id, query and company (null: any). Blocks of queries and of rows meet by their list; no row is
    compared with a query outside its lists, and of a block only what can be among a query's first k leaves it.
    Ties as in vector_top_k().
    """
    asked = _nearest(queries, "query", centroids, probes, ["query_id", "query", "company"])
    asked = asked.select(F.explode("lists").alias("list"), F.lower("company").alias("company"), F.col("query_id").alias("id"), F.col("query").alias("v"))
    asked = _blocks(asked.repartitionByRange("list", "company", "id").sortWithinPartitions("list", "company", "id"), BLOCK).alias("q")
    rows = _blocks(index.withColumnRenamed("own", "company"), BLOCK).alias("r")
    met = rows.join(asked, (F.col("r.list") == F.col("q.list")) & (F.col("q.company").isNull() | (F.col("q.company") == F.col("r.company"))))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (index, "id"))]

    def score(batches):
        for b in batches:
            asks, own, at, likes = [], [], [], []
            for i in range(b.num_rows):
                ids, names = b.column(0)[i].values, b.column(2)[i].values
                v, q = (np.frombuffer(b.column(j)[i].as_py(), np.float64).reshape(len(n), -1) for j, n in ((1, ids), (3, names)))
                lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
                found = np.divide(q @ v.T, lengths, out=np.zeros(lengths.shape), where=lengths > 0)
                # what rounds to the k-th similarity may be among the first k, by its id
                least = np.partition(found, -k, axis=1)[:, -k, None] - ROUNDED if found.shape[1] > k else -2.0
                x, y = np.nonzero(found >= least)
                asks.append(names.take(pa.array(x)))
                own.append(ids.take(pa.array(y)))
                likes.append(found[x, y])
            if asks:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(asks), pa.concat_arrays(own), pa.array(np.concatenate(likes))], names=["query_id", "id", "score"])

    scored = met.select("r.ids", "r.vectors", F.col("q.ids").alias("names"), F.col("q.vectors").alias("asked")).mapInArrow(score, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return scored.select("query_id", "id", F.round("score", 3).alias("similarity")).withColumn("rank", rank).filter(F.col("rank") <= k)


def probes_for(vectors: DataFrame, index: DataFrame, queries: DataFrame, centroids: np.ndarray, recall: float, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", company_col: str | None = None) -> int:
    """The least number of lists that holds a share `recall` of the exact answers to sample queries (MEASURED at most)."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED)
    exact = vector_top_k(vectors, some, k, id_col, vector_col, company_col)
    order = _nearest(some, "query", centroids, len(centroids), ["query_id"])
    where = exact.join(index.select("id", "list"), "id").join(order, "query_id").select(F.array_position("lists", F.col("list")).alias("place"))
    found = where.groupBy("place").count().orderBy("place").collect()  # a row per list at most
    total, have = sum(r["count"] for r in found), 0
    for r in found:
        have += r["count"]
        if have >= math.ceil(recall * total):
            return int(r["place"])
    return max(1, len(centroids))
