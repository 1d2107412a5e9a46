"""Exact substring dedup by fixed-block anchors: later copies of any 20 words are found and deleted.

Texts are kept once as messages of some megabytes. Every text's blocks of ten words that begin at words
0, 10, 20 ... are the anchors; a window of twenty words holds one at least, wherever it begins. Anchors
are indexed in buckets of their hash, and every rolling ten-word window probes them: an anchor that more
than one place has is a hit. Around a hit an exact repeat of twenty words can lie in eleven ways; a
message sends these extensions (of each kind its earliest), and their bucket answers which place in all
texts is the first. Copies therefore meet their first place and never each other, so a passage that a
third of all texts share costs a row per message and not a pair per copy. Answers that follow each other
in both texts make the maximal exact repeats.

Rolling windows travel as shortened keys, sorted, as differences, a few bytes each; only extensions of
hits travel with whole keys. A message has a row per bucket at most, and never more rows than keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import WordHashes, bucket_of, drop_table, pack, pack_planes, pack_sorted, scramble, slices_of, texts_of, unpack, unpack_planes, unpack_sorted, write_table

BLOCK, WINDOW = 10, 20
#: Bytes of texts in one message, keys that one bucket handles on average.
MESSAGE_BYTES, BUCKET = 4_000_000, 1_000_000
#: Odd bases of the windows' hashes: of the key, and of its check.
BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Windows up to which 64 bits tell them apart: about 0.002 pairs are equal by chance. More get 32 bits more.
PLAIN = 1 << 28
#: Where a null id stands in the order of ids.
LAST = np.iinfo(np.int64).max
MANY, ANCHOR = 1, 2

MESSAGES = "batch string, size long, ids binary, sizes binary, texts binary"
KEYS = "batch string, bucket int, keys binary, flags binary"
HITS = "batch string, bucket int, bits binary"
WAYS = "batch string, bucket int, keys binary, checks binary, ids binary, starts binary"
FIRSTS = "batch string, bucket int, bits binary, ids binary, starts binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


def rolling(words: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Hashes of all k-word windows of a sequence of word hashes, by doubling."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    out, done, power, size = None, 0, words, 1
    while size <= k:
        times = np.uint64(pow(base, size, 1 << 64))
        if k & size:
            piece = power[done : done + n]
            out = piece if out is None else out * times + piece
            done += size
        if 2 * size <= k:
            power = power[:-size] * times + power[size:]
        size *= 2
    return scramble(out)


def send_texts(docs: DataFrame, most: int = MESSAGE_BYTES) -> DataFrame:
    """(id, text) -> messages of whole texts in the order of their ids."""

    def send(batches):
        part, number, about, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            about.sort(key=lambda x: x[0])
            ids, texts = np.array([x[0] for x in about], np.int64), [x[1] for x in about]
            whole = np.frombuffer(b"".join(texts), np.uint8)
            return _batch([(f"{part:08d}-{number:08d}", size, pack(ids), pack(np.array([len(x) for x in texts], np.int64)), pack(whole))], MESSAGES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                about.append((LAST if doc is None else doc, text or b""))
                size += len(about[-1][1])
                if size >= most or len(about) >= 50_000:
                    yield flush()
                    number, about, size = number + 1, [], 0
        if about:
            yield flush()

    return docs.mapInArrow(send, MESSAGES)


class Message:
    """A message's texts as one sequence of word hashes, and the places in it."""

    def __init__(self, row: dict, hashes: WordHashes, words: bool = False):
        self.ids = unpack(row["ids"], np.int64)
        data, at, parts, self.words = unpack(row["texts"], np.uint8).tobytes(), 0, [], []
        for size in unpack(row["sizes"], np.int64).tolist():
            split = data[at : at + size].split()
            parts.append(hashes.of(split))
            if words:
                self.words.append(split)
            at += size
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(parts)), self.lengths)
        self.within = np.arange(len(self.hashes)) - self.begins[self.doc]
        self.left = self.lengths[self.doc] - self.within

    def blocks(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rolling blocks and their shortened keys."""
        at = np.flatnonzero(self.left >= BLOCK)
        return at, (rolling(self.hashes, BLOCK)[at] >> np.uint64(64 - bits) if len(at) else self.hashes[:0])

    def extensions(self, bits: int, hit: np.ndarray) -> np.ndarray:
        """Places of the windows whose own anchors are hits; hit has an entry per distinct key of blocks(), in order."""
        at, keys = self.blocks(bits)
        by = np.argsort(keys, kind="stable")
        starts, ends = slices_of(keys[by])
        found = np.zeros(len(self.hashes) + 2 * BLOCK, bool)
        found[at[by]] = np.repeat(hit, ends - starts)
        s = np.flatnonzero(self.left >= WINDOW)
        first = s + -self.within[s] % BLOCK
        return s[found[first] & ((first > s) | found[first + BLOCK])]

    def ways(self, places: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order, starts, keys, checks): places by key and then by text and place; starts of the distinct ones in it."""
        keys = rolling(self.hashes, WINDOW)[places] if len(places) else self.hashes[:0]
        checks = (rolling(self.hashes, WINDOW, BASES[1])[places] >> np.uint64(32)).astype(np.uint32) if wide and len(places) else np.zeros(len(places), np.uint32)
        by = np.lexsort((checks, keys)) if wide else np.argsort(keys, kind="stable")
        new = np.append(True, (np.diff(keys[by]) != 0) | (np.diff(checks[by]) != 0)) if len(by) else np.zeros(0, bool)
        return by, np.flatnonzero(new), keys, checks


def _rows_of(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def send_blocks(texts: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Each message's distinct rolling blocks by bucket: whether it has several of one, and whether one is an anchor."""

    def send(batches):
        hashes = WordHashes()
        for row in _rows_of(batches):
            message = Message(row, hashes)
            at, keys = message.blocks(bits)
            by = np.argsort(keys, kind="stable")
            starts, ends = slices_of(keys[by])
            if not len(starts):
                continue
            anchored = np.logical_or.reduceat(message.within[at[by]] % BLOCK == 0, starts)
            flags = ((ends - starts > 1) * MANY + anchored * ANCHOR).astype(np.uint8)
            keys = keys[by][starts]
            to = bucket_of(keys, buckets, bits)
            yield _batch([(row["batch"], int(to[a]), pack_sorted(keys[a:b]), pack(flags[a:b])) for a, b in zip(*slices_of(to))], KEYS)

    return texts.mapInArrow(send, KEYS)


def _probe(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket: its anchors are the index, all its blocks the probes; a bit per probe, set if another place hits the anchor."""
    parts = [unpack_sorted(x) for x in rows["keys"]]
    keys, flags = np.concatenate(parts), np.concatenate([unpack(x, np.uint8) for x in rows["flags"]])
    index = np.unique(keys[flags & ANCHOR > 0])
    hit = np.zeros(len(keys), bool)
    if len(index):
        at = np.minimum(np.searchsorted(index, keys), len(index) - 1)
        found = index[at] == keys
        times = np.bincount(at[found], 1 + (flags[found] & MANY), len(index))
        hit = found & (times[at] > 1)
    ends = np.cumsum([len(x) for x in parts])
    return pd.DataFrame({"batch": rows["batch"], "bucket": rows["bucket"], "bits": [pack(np.packbits(hit[b - len(x) : b])) for x, b in zip(parts, ends)]})


def _hits(message: Message, answers: list[dict], buckets: int, bits: int) -> np.ndarray:
    """The answers' bits, one for each distinct block of the message in order."""
    keys = np.unique(message.blocks(bits)[1])
    sizes = np.diff(np.append(slices_of(bucket_of(keys, buckets, bits))[0], len(keys)))
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(unpack(x["bits"], np.uint8), count=n).astype(bool) for x, n in zip(answers, sizes.tolist()))])


def send_extensions(asked: DataFrame, buckets: int, bits: int, wide: bool) -> DataFrame:
    """Messages with their hits -> their distinct windows around hits by bucket, with the earliest text and place of each."""

    def send(batches):
        hashes = WordHashes()
        for row in _rows_of(batches):
            message = Message(row, hashes)
            places = message.extensions(bits, _hits(message, row["hits"], buckets, bits))
            by, starts, keys, checks = message.ways(places, wide)
            if not len(starts):
                continue
            at = places[by[starts]]
            keys, checks, ids, begin = keys[by[starts]], checks[by[starts]], message.ids[message.doc[at]], message.within[at].astype(np.int32)
            to = bucket_of(keys, buckets)
            yield _batch([(row["batch"], int(to[a]), pack_sorted(keys[a:b]), pack(checks[a:b]), pack_planes(ids[a:b]), pack_planes(begin[a:b])) for a, b in zip(*slices_of(to))], WAYS)

    return asked.mapInArrow(send, WAYS)


def _first_places(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket: of equal windows the first place, by id, then message. A bit per window, set if it is first, and the others' first places."""
    rows = rows.sort_values("batch")
    parts = [unpack_sorted(x) for x in rows["keys"]]
    keys, checks = np.concatenate(parts), np.concatenate([unpack(x, np.uint32) for x in rows["checks"]])
    ids, starts = np.concatenate([unpack_planes(x, np.int64) for x in rows["ids"]]), np.concatenate([unpack_planes(x, np.int32) for x in rows["starts"]])
    by = np.lexsort((ids, checks, keys))  # stable: equal ids by message
    new = np.append(True, (np.diff(keys[by]) != 0) | (np.diff(checks[by]) != 0))
    winner = np.empty(len(keys), np.int64)
    winner[by] = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    first = winner == np.arange(len(keys))
    out, b = [], 0
    for batch, bucket, part in zip(rows["batch"], rows["bucket"], parts):
        a, b = b, b + len(part)
        later = winner[a:b][~first[a:b]]
        out.append((batch, bucket, pack(np.packbits(first[a:b])), pack_planes(ids[later]), pack_planes(starts[later])))
    return pd.DataFrame(out, columns=["batch", "bucket", "bits", "ids", "starts"])


REPEATS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))
RESULT = "id long, n_words long, n_removed long, left_text string, repeats array<struct<start: bigint, words: bigint, source: bigint, source_start: bigint>>"


def _result(message: Message, places: np.ndarray, row: dict, wide: bool) -> pa.RecordBatch:
    by, starts, keys, _ = message.ways(places, wide)
    ends = np.append(starts[1:], len(by))
    sizes = np.diff(np.append(slices_of(bucket_of(keys[by[starts]], row["buckets"]))[0], len(starts)))
    first = np.concatenate([np.zeros(0, bool), *(np.unpackbits(unpack(x["bits"], np.uint8), count=n).astype(bool) for x, n in zip(row["firsts"] or [], sizes.tolist()))])
    leads = places[by[starts]]
    source, begin = message.ids[message.doc[leads]], message.within[leads].astype(np.int64)
    for given, kind, out in (("ids", np.int64, source), ("starts", np.int32, begin)):
        out[~first] = np.concatenate([np.zeros(0, kind), *(unpack_planes(x[given], kind) for x in row["firsts"] or [])])
    which = np.repeat(np.arange(len(starts)), ends - starts)
    keep = np.zeros(len(by), bool)
    keep[starts[first]] = True  # the first place of all
    at, which = places[by][~keep], which[~keep]
    order = np.argsort(at)
    at, source, begin = at[order], source[which[order]], begin[which[order]]
    new = np.append(True, (np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(begin) != 1) | (np.diff(message.doc[at]) != 0)) if len(at) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    count = np.diff(np.append(a, len(at))) + WINDOW - 1
    cover = np.zeros(len(message.hashes) + 1, np.int64)
    np.add.at(cover, at[a], 1)
    np.add.at(cover, at[a] + count, -1)
    gone = np.cumsum(cover[:-1]) > 0
    of = message.doc[at[a]]
    bounds = np.searchsorted(of, np.arange(len(message.ids) + 1))
    texts = []
    for words, b, n in zip(message.words, message.begins.tolist(), message.lengths.tolist()):
        lost = gone[b : b + n]
        texts.append(b" ".join(np.array(words, object)[~lost].tolist() if lost.any() else words))
    none = source[a] == LAST
    repeats = pa.StructArray.from_arrays([pa.array(message.within[at[a]]), pa.array(count), pa.array(source[a], mask=none), pa.array(begin[a])], names=["start", "words", "source", "source_start"])
    removed = np.bincount(message.doc, gone, len(message.ids)).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), repeats).cast(REPEATS)
    columns = [pa.array(message.ids, mask=message.ids == LAST), pa.array(message.lengths), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string()), lists]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "left_text", "repeats"])


def _answers(table: DataFrame, name: str) -> DataFrame:
    """(batch, name): a message's answers in the order of their buckets."""
    return table.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(*[c for c in table.columns if c != "batch"]))).alias(name))


def dedupe_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", message: int = MESSAGE_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, left_text (the words kept, joined by a space) and the repeats deleted.

    A word goes if a window of 20 words over it also starts earlier: in a text of a smaller id, or earlier
    in its own. repeats has the maximal exact repeats (start, words; source, source_start: their first
    place). Null texts have no words, texts of under 20 words lose none. Rows with one id count as several
    texts in the order in which they were read; null ids come last (as 2**63 - 1). An empty table gives an
    empty result; other columns, whatever their names, are not read.
    """
    texts = write_table(send_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), message), "messages")
    size = texts.agg(F.sum("size")).first()[0] or 0
    # a word takes two bytes at least, with what parts it from the next; blocks by chance equal to an anchor cost one window
    bits = min(64, max(32, (size // 2).bit_length() + 10))
    buckets, wide = max(64, size // 6 // BUCKET + 1), size // 2 > PLAIN
    hits = write_table(send_blocks(texts, buckets, bits).groupBy("bucket").applyInPandas(_probe, HITS), "hits")
    asked = texts.join(_answers(hits, "hits"), "batch")
    firsts = write_table(send_extensions(asked, buckets, bits, wide).groupBy("bucket").applyInPandas(_first_places, FIRSTS), "firsts")

    def finish(batches):
        hashes = WordHashes()
        for row in _rows_of(batches):
            m = Message(row, hashes, words=True)
            places = m.extensions(bits, _hits(m, row["hits"], buckets, bits)) if row["hits"] else np.zeros(0, np.int64)
            yield _result(m, places, row | {"buckets": buckets}, wide)

    whole = texts.join(_answers(hits, "hits"), "batch", "left").join(_answers(firsts, "firsts"), "batch", "left")
    return whole.mapInArrow(finish, RESULT).withColumnRenamed("id", id_col)
