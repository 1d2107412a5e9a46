"""Token counts of whole texts; huge ones are encoded as overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import texts_of, write_table
from filingscope.llm.tokens import Pieces, opened

VOCABULARY = "piece_bpe_32k.model"
BATCH = 256


def _whole(vocabulary: str):
    def count(batches):
        encoder = opened(Pieces, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [(x or b"").decode("utf-8", "replace") for x in texts_of(part.column(0))]
                n = [len(x) // 4 for x in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def cut_chunks(chunk: int, overlap: int):
    """text -> chunks of `chunk` characters, each with the `overlap` characters before and after its cuts."""

    def cut(batches):
        for batch in batches:
            for text, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                n = max(1, -(-len(text) // chunk))
                for k in range(n):
                    begin = max(0, k * chunk - overlap * (k > 0))
                    end = min(len(text), (k + 1) * chunk + overlap) if k < n - 1 else len(text)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([begin], pa.int64()), pa.array([text[begin:end]])], names=["row", "k", "n", "begin", "text"])

    return cut


def _encode_chunks(vocabulary: str, chunk: int, overlap: int):
    """Chunk -> its tokens, and near either cut the stable boundaries with the tokens before each."""

    def near(places, before, cut):
        keep = np.abs(places - cut) <= overlap
        return dict(zip(places[keep].tolist(), before[keep].tolist()))

    def encode(batches):
        encoder = opened(Pieces, vocabulary)
        for batch in batches:
            out = []
            for row, k, n, begin, text in zip(*[c.to_pylist() for c in batch.columns]):
                tokens = len(encoder.encode([text])[0]) // 4
                places, before = encoder.boundaries(text)
                places = places + begin
                out.append((row, k, n, tokens, near(places, before, k * chunk) if k else {}, near(places, before, (k + 1) * chunk) if k < n - 1 else {}))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.map_(pa.int64(), pa.int64()), pa.map_(pa.int64(), pa.int64())]
            cols = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], t) for c, t in zip(cols, kinds)], names=["row", "k", "n", "tokens", "head", "tail"])

    return encode


def spliced_counts(long_texts: DataFrame, vocabulary: str = VOCABULARY, chunk: int = 16_384, overlap: int = 128) -> DataFrame:
    """(row, text) -> (row, n_tokens) by chunks.

    Each chunk is encoded with its overlaps. At each cut the two neighbours' encodings are spliced at
    their first common stable boundary: a place before a space and after another character, which no
    merge crosses (see Pieces), so what stands on either side is what the whole text would give. Where
    an overlap has none, the document is cut again with overlaps four times as wide, at last as one.
    """
    pending, done = long_texts, None
    while True:
        chunks = pending.mapInArrow(cut_chunks(chunk, overlap), "row long, k int, n int, begin long, text string")
        spread = chunks.repartition(F.col("row"), F.col("k"))
        encoded = write_table(spread.mapInArrow(_encode_chunks(vocabulary, chunk, overlap), "row long, k int, n int, tokens long, head map<long,long>, tail map<long,long>"), "chunks")
        left = encoded.filter("k < n - 1").select("row", F.col("k").alias("edge"), F.col("tail").alias("l"), F.lit(None).cast("map<long,long>").alias("r"), F.col("tokens").alias("lt"))
        right = encoded.filter("k > 0").select("row", (F.col("k") - 1).alias("edge"), F.lit(None).cast("map<long,long>").alias("l"), F.col("head").alias("r"), F.lit(None).cast("long").alias("lt"))
        edges = left.unionByName(right).groupBy("row", "edge").agg(F.first("l", True).alias("l"), F.first("r", True).alias("r"), F.first("lt", True).alias("lt"))
        at = F.array_min(F.array_intersect(F.map_keys("l"), F.map_keys("r")))
        twice = edges.withColumn("at", at).select("row", F.when(F.col("at").isNotNull(), F.col("l")[F.col("at")] - F.col("lt") - F.col("r")[F.col("at")]).alias("tokens"), F.col("at").isNull().cast("int").alias("failed"))
        parts = encoded.select("row", "tokens", F.lit(0).alias("failed")).unionByName(twice)
        counts = write_table(parts.groupBy("row").agg(F.sum("tokens").alias("n_tokens"), F.max("failed").alias("failed")), "spliced")
        good = counts.filter("failed = 0").select("row", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = counts.filter("failed = 1").select("row")
        if failed.isEmpty():
            return done
        pending = pending.join(failed, "row", "left_semi").select("text", "row")
        overlap, chunk = overlap * 4, max(chunk, overlap * 8)


def count_tokens(docs: DataFrame, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, chunk: int = 16_384, overlap: int = 128) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens of the whole text, over_limit.

    A null or empty text has no tokens. Repeated rows and ids each give a row. Texts over `chunk`
    characters go through spliced_counts(), with the chunks of a text spread over the tasks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"))
    short = rows.filter(F.length("text") <= chunk).mapInArrow(_whole(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    long_rows = write_table(rows.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long")
    counted = spliced_counts(long_rows.select("text", "row"), vocabulary, chunk, overlap)
    spliced = long_rows.drop("text").join(counted, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
