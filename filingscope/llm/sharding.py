"""Shards by jump consistent hashing: no ring table, and one more shard takes only the fraction it needs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import number_rows


def jump_buckets(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of 64-bit keys to 0..shards-1, all keys at a time."""
    state = keys.astype(np.uint64).copy()
    bucket = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    ahead = np.zeros(len(state), np.int64)
    while len(going):
        bucket[going] = ahead
        state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead = ((ahead + 1) * (2.0**31 / ((state[going] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        stay = ahead < shards
        going, ahead = going[stay], ahead[stay]
    return bucket


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key; its bits are mixed before, as neighbouring ids are not random keys."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(keys.to_numpy(np.int64), shards).astype(np.int32))

    return shard(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard, its place (slot) there, and its shard if one more is appended.

    The id and the number of shards alone decide. A null id counts as one key; equal ids share a
    shard; a null text has no bytes; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumns({"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1)})
    ranked, _ = number_rows(rows, ["shard"], "shards")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("_rank").cast("long").alias("slot"), "grown_shard")


def moved_fraction(assigned: DataFrame) -> DataFrame:
    """One row: rows, rows that one more shard moves, and their share."""
    moved = F.sum((F.col("shard") != F.col("grown_shard")).cast("long"))
    return assigned.agg(F.count(F.lit(1)).alias("n_rows"), moved.alias("n_moved"), (moved / F.count(F.lit(1))).alias("share"))
