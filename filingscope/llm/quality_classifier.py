"""A quality score: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingscope.llm.common import WordHashes, scramble, texts_of

#: Buckets of the hashed n-grams, and labelled rows that a fit takes at most.
BITS, MOST_ROWS, EPOCHS = 20, 20_000, 4
ALPHA, BETA, L1, L2 = 8.0, 1.0, 0.02, 0.0
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_SHOUT, _SAME, _PAIR = np.uint64(0x5A5A), np.uint64(0xA5A5), np.uint64(0x9E3779B97F4A7C15)


class Tokens(WordHashes):
    """A token's hash: words in lower case (all capitals marked), digits as one class, signs as they are."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        shape = "#" if token.isdigit() else ("^" + token.lower() if len(token) > 1 and token.isupper() else token.lower())
        self[token] = h = xxhash.xxh3_64_intdigest(shape.encode())
        return h


def features(text: str, hashes: Tokens, bits: int = BITS) -> np.ndarray:
    """Distinct buckets of a whole text's words and word pairs; a token like the one before it counts as a repeat."""
    h = hashes.of(_TOKEN.findall(text))
    if not len(h):
        return np.zeros(0, np.int64)
    h = np.concatenate([h[:1], np.where(h[1:] == h[:-1], _SAME, h[1:])])
    both = np.concatenate([scramble(h), scramble(h[1:] + scramble(h[:-1] + _PAIR))])
    return np.unique(both >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for logistic loss; features have the value 1/sqrt(their number)."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> float:
        """at: a row's buckets. The last coordinate is the bias."""
        at = np.append(at, len(self.z) - 1)
        x = np.full(len(at), 1 / np.sqrt(max(1, len(at) - 1)))
        x[-1] = 1.0
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return float(p)


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, epochs: int = EPOCHS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights (2**bits and the bias) learnt from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    The fit takes at most most_rows labelled ids, those with the smallest hashes, and reads their whole
    texts. The same rows always give the same model. Null ids, labels or texts are left out; several
    labels of an id count as the largest, of several texts of an id the first in order is read. Without labelled rows all weights are 0 (every score is 0.5).
    """
    spark = docs.sparkSession
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    ids = ids.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    rows = texts.join(F.broadcast(chosen), "doc_id")  # most_rows ids and labels at most
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def extract(batches):
        hashes = Tokens()
        for batch in batches:
            doc, text, label = batch.columns
            at = [features(x.decode("utf-8", "replace"), hashes, bits).astype("<i4").tobytes() for x in texts_of(text)]
            yield pa.RecordBatch.from_arrays([doc, label, pa.array(at, pa.binary())], names=["doc_id", "label", "at"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(bits)
        rows = rows.sort_values(["at", "doc_id"])
        rng = np.random.default_rng(1)
        at = [np.frombuffer(x, "<i4") for x in rows["at"]]
        labels = rows["label"].to_numpy()
        for _ in range(epochs):
            for i in rng.permutation(len(at)):
                model.learn(at[i], labels[i])
        return pd.DataFrame({"weights": [model.weights(slice(None)).astype("<f4").tobytes()]})

    bags = rows.mapInArrow(extract, "doc_id long, label int, at binary")
    # the bounded sample is one group; each row is a bag of bucket numbers
    found = bags.withColumn("fit", F.lit("all")).groupBy("fit").applyInPandas(fit, "weights binary").collect()
    return np.frombuffer(found[0][0], "<f4").copy() if found else np.zeros((1 << bits) + 1, "<f4")


def _scores(weights: np.ndarray, hashes: Tokens, texts: list[bytes | None]) -> np.ndarray:
    bits, out = int(np.log2(len(weights) - 1)), np.empty(len(texts))
    for i, x in enumerate(texts):
        at = features((x or b"").decode("utf-8", "replace"), hashes, bits)
        out[i] = float(weights[-1]) + float(weights[at].sum()) / np.sqrt(max(1, len(at)))
    return np.round(1 / (1 + np.exp(-np.clip(out, -35, 35))), 6)


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose whole texts score the threshold at least, with all their columns, whatever their names."""
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text_col)

    def keep(batches):
        hashes = Tokens()
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, hashes, texts_of(batch.column(at))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def score_quality(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds score (0 to 1, six decimals) and predicted to every row: a sparse dot product over its whole text.

    A null or empty text has the bias alone as its score. keep: columns to carry along (but for such as
    have the names of what is made here).
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers, whatever the input
    names = ["doc_id", *[c for c in keep if c not in ("doc_id", "score", "predicted", "_text")]]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *names[1:], F.col(text_col).cast("string").alias("_text"))

    def score(batches):
        w, hashes = shared.value, Tokens()
        for batch in batches:
            p = _scores(w, hashes, texts_of(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*names, "score"])

    schema = rows.drop("_text").schema.add("score", T.DoubleType())
    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """doc_id, held_out (no label of such a row is learnt), score, predicted of every row."""
    scored = score_quality(docs, fit_quality(docs, labels, **fit), threshold)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
