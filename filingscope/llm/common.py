"""What the operators of this subpackage share: packed arrays, words of a text, gapless numbering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.tables import drop_table, new_path, write_table

__all__ = ["MIX", "WordHashes", "bucket_of", "drop_table", "new_path", "number_rows", "pack", "pack_planes", "pack_sorted", "scramble", "shingles", "slices_of", "texts_of", "unpack", "unpack_planes", "unpack_sorted", "write_table"]


def pack(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(a.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_planes(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: where the upper bytes are alike, they cost nothing."""
    return pack(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T))


def unpack_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as their differences, byte plane by byte plane: the upper planes are all 0 and left out."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    parts = [pack(x) if x.any() else b"" for x in planes]
    return np.array([len(keys), *(len(x) for x in parts)], np.uint32).tobytes() + b"".join(parts)


def unpack_sorted(data: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(data[:36], np.uint32).tolist()
    out, at = np.zeros((n, 8), np.uint8), 36
    for i, size in enumerate(sizes):
        if size:
            out[:, i] = unpack(data[at : at + size], np.uint8)
        at += size
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def slices_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(keys)) if len(keys) else starts


def bucket_of(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Buckets as ranges of the upper 32 of a key's bits: sorted keys are in the order of their buckets."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; kept between batches up to a bound."""

    bound = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers of the positions in a shingle's hash.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def scramble(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows, in order; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(k, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h += words[i : len(words) - n + 1 + i] * MIX[i]
    return scramble(h)


def number_rows(df: DataFrame, keys: list[str], name: str, rows_per_block: int = 20_000, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Adds _rank, gapless from 0 within each group of keys, whatever the groups' sizes.

    A group is cut into blocks of a random salt that is written with the rows, so no task sorts a
    whole group; the blocks' counts are summed up first and give each block its offset. Returns the
    rows and the counts (keys, _n).
    """
    t = write_table(df.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 24))), name)
    blocks = max(16, min(1 << 24, t.count() // rows_per_block))
    t = t.withColumn("_block", F.pmod("_salt", F.lit(blocks)))
    per_block = t.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    within = Window.partitionBy(*keys, "_block").orderBy("_salt")
    ranked = t.join(offsets, [*keys, "_block"]).withColumn("_rank", F.col("_from") + F.row_number().over(within) - 1)
    return ranked.drop("_block", "_salt", "_from"), per_block.groupBy(*keys).agg(F.sum("_n").alias("_n"))
