"""Packs documents into windows of tokens, best fit decreasing, with a plan made from the counts per length."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import number_rows, texts_of
from filingscope.llm.tokens import ByteBpe, opened

VOCABULARY = "byte_bpe_50k.json"
END = b"\0\0\0\0"
BATCH = 256


class Tightest:
    """A segment tree over remaining capacities 0..window: the least open one of at least a length."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += windows
            at //= 2

    def at_least(self, length: int) -> int | None:
        at = length + self.leaves
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.open[2 * at])
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over pieces of which counts has the number per length.

    Pieces of one length are interchangeable, so whole runs of them are placed at a time: the plan has
    (length, first rank, end rank, first window, pieces per window, offset). Its size and the work
    depend on the window's length only, not on the number of pieces.
    """
    tree, ranges, plan, windows = Tightest(window), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            ranges.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            capacity = tree.at_least(length)
            if capacity is None:
                n = -(-(end - rank) // (window // length))
                put(window, windows, n)
                windows += n
                continue
            first, n = ranges[capacity].pop()
            tree.add(capacity, -n)
            each = capacity // length
            full = min(n, (end - rank) // each)
            if full:
                took = full * each
                plan.append((length, rank, rank + took, first, each, window - capacity))
                put(capacity - each * length, first, full)
                put(capacity, first + full, n - full)
            else:
                took = end - rank
                plan.append((length, rank, end, first, took, window - capacity))
                put(capacity - took * length, first, 1)
                put(capacity, first + 1, n - 1)
            rank += took
    return plan


def cut_pieces(docs: DataFrame, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Per document its full windows and its rest: doc_id, start, length, ids_crc32, doc_tokens (and the ids)."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]

    def cut(batches):
        encoder = opened(ByteBpe, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out = []
                texts = [(x or b"").decode("utf-8", "replace") for x in texts_of(part.column(1))]
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    ids += END
                    for start in range(0, len(ids), 4 * window):
                        piece = ids[start : start + 4 * window]
                        out.append((doc, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece)[: 5 + with_ids])
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with the sequence that holds it and its offset there.

    A null or empty text is the end token alone. Documents over a window are first cut into full
    windows. The driver sees only the counts per length, of which there are at most `window`. Equal
    rows are packed each by itself; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranked, counts = number_rows(cut_pieces(docs, window, id_col, text_col, vocabulary, with_ids), ["length"], "pieces")
    plan = best_fit_plan({r["length"]: r["_n"] for r in counts.collect()}, window)
    places = F.broadcast(spark.createDataFrame(plan, "length int, _first long, _end long, _window long, _each int, _offset int"))
    inside = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    place = F.col("_rank") - F.col("_first")
    # the plan is a few thousand ranges for a window of 1024, whatever the input's size
    placed = ranked.alias("p").join(places.alias("q"), (F.col("p.length") == F.col("q.length")) & inside)
    return placed.select(
        "doc_id", "start", F.col("p.length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("_window") + F.floor(place / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (place % F.col("_each")) * F.col("p.length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def padding(packed: DataFrame, window: int = 1024) -> DataFrame:
    """One row: sequences, tokens, and the share of padding if each sequence is padded to the window."""
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_tokens"))
    return whole.withColumn("padding_share", 1 - F.col("n_tokens") / (F.col("n_sequences") * window))
