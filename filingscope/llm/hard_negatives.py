"""Hard negatives by coordinate pruning: exact inner products, searched in buckets of like lengths.

Vectors are sorted by label and length into buckets of some thousands; a bucket keeps, for each
coordinate, its vectors in the order of that coordinate's share of their length. An anchor that needs a
score needs a cosine with a bucket's vectors, the larger the shorter these are: above 1 the bucket is
skipped. For the anchor's largest coordinates (its focus) the cosine leaves a range of feasible shares;
the candidates are those in the ranges of all focus coordinates, found in the sorted lists, and only
they are verified. Where the ranges leave most of a bucket, the whole bucket is verified as one product.

Anchors are the query set. They go in blocks of some hundreds against all buckets; a task keeps the best
of each anchor of the blocks it sees, which raises what later buckets must reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.llm.common import drop_table, pack, unpack, write_table

#: Vectors in a bucket (65,536 at most), anchors in a block, blocks whose best a task keeps at once.
BUCKET, BLOCK, KEPT = 1024, 512, 32
#: Coordinates of an anchor whose ranges are intersected; the share of a bucket up to which candidates are verified one by one.
FOCUS, FEW = 3, 0.25
LAST = np.iinfo(np.int64).max
#: Products of lengths up to which floating-point sums of whole numbers are exact; above, Python's whole numbers are used.
EXACT = 2.0**53

VECTORS = "part string, label int, most double, ids binary, rows binary, vectors binary, lists binary, needs binary"


def store(m: np.ndarray) -> bytes:
    """A matrix of whole numbers, as small as they allow."""
    kind = next((k for k in (np.int16, np.int32) if not m.size or np.abs(m).max() <= np.iinfo(k).max), np.float64)
    return np.dtype(kind).char.encode() + np.int64(m.shape[0]).tobytes() + pack(np.ascontiguousarray(m.T.astype(kind)))


def load(data: bytes) -> np.ndarray:
    rows = int(np.frombuffer(data[1:9], np.int64)[0])
    return unpack(data[9:], data[:1].decode()).reshape(-1, rows).T.astype(np.float64) if rows else np.zeros((0, 0))


def shares(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(lengths > 0, lengths, 1)[:, None]


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(row, id, label, v, length) of the rows that take part; v holds the whole numbers floor(scale * x)."""
    v = F.transform(vector_col, lambda x: x.cast("double") * scale)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), v.alias("v")).filter("label is not null and v is not null")
    own = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    own = own.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)))
    return write_table(own.select(F.monotonically_increasing_id().alias("row"), "*", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("length")), "vectors")


def blocks(vectors: DataFrame, size: int, lists: bool, needs: str | None = None) -> DataFrame:
    """Rows of at most size vectors of one label, longest first; with their sorted coordinate lists, or with an array per vector."""

    def cut(batches):
        held, label, number, part = [], None, 0, None

        def flush():
            dims = max(len(x[2]) for x in held)
            m = np.zeros((len(held), dims))
            for i, x in enumerate(held):
                m[i, : len(x[2])] = x[2]
            order = pack(np.argsort(shares(m), axis=0, kind="stable").astype(np.uint16).T.copy()) if lists else b""
            ids = np.array([LAST if x[0] is None else x[0] for x in held], np.int64)
            row = [f"{label}-{part}-{number}", label, max(x[3] for x in held), pack(ids), pack(np.array([x[1] for x in held], np.int64)), store(m), order, pack(np.array([x[4] for x in held], np.int64)) if needs else b""]
            kinds = [pa.string(), pa.int32(), pa.float64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in VECTORS.split(", ")])

        for b in batches:
            for *x, own, at in zip(*(c.to_pylist() for c in b.columns)):
                part = at if part is None else part
                if held and (own != label or len(held) >= size):
                    yield flush()
                    number, held = number + 1, []
                label = own
                held.append(x)
        if held:
            yield flush()

    order = [F.asc("label"), F.desc("length"), F.asc("row")]
    ranged = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("id", "row", "v", "length", *([needs] if needs else [F.lit(None).cast("array<bigint>").alias("needs")]), "label", F.spark_partition_id().alias("at")).mapInArrow(cut, VECTORS)


class Bucket:
    def __init__(self, row: dict):
        self.label, self.most = row["label"], row["most"]
        self.ids, self.rows, self.vectors = unpack(row["ids"], np.int64), unpack(row["rows"], np.int64), load(row["vectors"])
        self.shares = shares(self.vectors)
        self.lists = unpack(row["lists"], np.uint16).reshape(self.vectors.shape[1], -1) if len(row["lists"]) else None
        self.by_share = np.take_along_axis(self.shares.T, self.lists.astype(np.int64), 1) if self.lists is not None else None


def feasible(share: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of another vector's share in a coordinate, if its cosine with one of this share is to be reached."""
    here, apart = np.arccos(np.clip(share, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(np.pi, here + apart)) - 1e-9, np.cos(np.maximum(0, here - apart)) + 1e-9


def candidates(block: Bucket, bucket: Bucket, need: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Anchors for which the whole bucket is to be verified, and (anchor, candidates) for the others. need: the least score of each."""
    lengths = np.linalg.norm(block.vectors, axis=1)
    reach = lengths * bucket.most
    cosine = np.where(reach > 0, need / np.where(reach > 0, reach, 1), np.where(need > 0, np.inf, -1))
    asked = np.flatnonzero(cosine <= 1 + 1e-9)
    dims = min(block.shares.shape[1], bucket.shares.shape[1])
    pruned = asked[cosine[asked] > 0] if dims else asked[:0]
    whole, some = [asked[~np.isin(asked, pruned)]], []
    if len(pruned):
        focus = np.argsort(-np.abs(block.shares[pruned][:, :dims]), axis=1)[:, :FOCUS]
        low, high = feasible(np.take_along_axis(block.shares[pruned], focus, 1), cosine[pruned][:, None])
        a, b = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            a[at], b[at] = np.searchsorted(bucket.by_share[f], low[at]), np.searchsorted(bucket.by_share[f], high[at], "right")
        count = b - a
        least = count.argmin(1)
        many = count.min(1) > FEW * len(bucket.ids)
        whole.append(pruned[many])
        for i in np.flatnonzero(~many).tolist():
            f = focus[i, least[i]]
            found = bucket.lists[f][a[i, least[i]] : b[i, least[i]]]
            x = bucket.shares[found][:, focus[i]]
            some.append((int(pruned[i]), found[((x >= low[i]) & (x <= high[i])).all(1)]))
    return np.concatenate(whole), some


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; shorter vectors have zeros at their ends. Those beyond 64 bits are the nearest number within."""
    dims = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (a, b))
    if not a.size or not b.size or np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max() < EXACT:
        return (a @ b.T).astype(np.int64)
    ints = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(ints(a) @ ints(b).T, -(2**63) + 1, 2**63 - 2).astype(np.int64)


class Best:
    """The first k of each anchor's asked ranges [low, high]: higher scores first, then smaller ids."""

    def __init__(self, block: Bucket, low: np.ndarray, high: np.ndarray, k: int):
        self.block, self.low, self.high, self.k = block, low, high, k
        n, slots = low.shape
        self.scores, self.ids = np.full((n, slots, k), -LAST), np.full((n, slots, k), LAST)
        self.rows = np.full((n, slots, k), -1)

    def need(self) -> np.ndarray:
        return np.maximum(self.low, self.scores[:, :, -1]).min(1)

    def take(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, fits: np.ndarray) -> None:
        """scores, fits: a row per anchor, a column per vector."""
        for j in range(self.low.shape[1]):
            floor = np.maximum(self.low[anchors, j], self.scores[anchors, j, -1])[:, None]
            inside = fits & (scores >= floor) & (scores <= self.high[anchors, j][:, None])
            if inside.shape[1] > self.k:  # of more than k, those below the k-th score can't count
                kth = np.partition(np.where(inside, scores, -LAST), -self.k, axis=1)[:, -self.k, None]
                inside &= scores >= kth
            at, of = np.nonzero(inside)
            if not len(at):
                continue
            who = anchors[at]
            own = np.unique(who)
            who = np.concatenate([who, np.repeat(own, self.k)])
            s = np.concatenate([scores[at, of], self.scores[own, j].ravel()])
            i = np.concatenate([ids[of], self.ids[own, j].ravel()])
            r = np.concatenate([rows[of], self.rows[own, j].ravel()])
            by = np.lexsort((r, i, -s, who))
            who, s, i, r = who[by], s[by], i[by], r[by]
            place = np.arange(len(who)) - np.repeat(np.flatnonzero(np.append(True, np.diff(who) != 0)), np.unique(who, return_counts=True)[1])
            top = place < self.k
            self.scores[who[top], j, place[top]], self.ids[who[top], j, place[top]], self.rows[who[top], j, place[top]] = s[top], i[top], r[top]

    def visit(self, bucket: Bucket) -> None:
        whole, some = candidates(self.block, bucket, self.need())
        if len(whole):
            scores = products(self.block.vectors[whole], bucket.vectors)
            self.take(whole, scores, bucket.ids, bucket.rows, self.block.rows[whole][:, None] != bucket.rows[None])
        for i, found in some:
            if len(found):
                scores = products(self.block.vectors[[i]], bucket.vectors[found])
                self.take(np.array([i]), scores, bucket.ids[found], bucket.rows[found], (self.block.rows[i] != bucket.rows[found])[None])

    def found(self) -> pa.RecordBatch:
        at, slot, place = np.nonzero(self.rows >= 0)
        ids = self.ids[at, slot, place]
        columns = [self.block.rows[at], slot.astype(np.int32), pa.array(ids, mask=ids == LAST), self.scores[at, slot, place]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["anchor", "slot", "id", "score"])


def search(buckets: DataFrame, anchors: DataFrame, on, k: int) -> DataFrame:
    """(anchor, slot, id, score, rank): the first k vectors in each range of the anchors' needs; on says which buckets a block meets.

    An anchor's needs are pairs of a least and a greatest score; a block without needs asks for the best k.
    """
    meets = buckets.alias("b").join(anchors.alias("a"), on).select(*[F.col(f"a.{c}").alias(f"a_{c}") for c in ("part", "label", "most", "ids", "rows", "vectors", "lists", "needs")], *[f"b.{c}" for c in ("part", "label", "most", "ids", "rows", "vectors", "lists")])

    def run(batches):
        held, last, bucket = {}, None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                name = row["a_part"]
                if name not in held:
                    if len(held) >= KEPT:
                        yield held.pop(next(iter(held))).found()
                    block = Bucket({x[2:]: y for x, y in row.items() if x.startswith("a_")})
                    needs = unpack(row["a_needs"], np.int64).reshape(len(block.ids), -1, 2) if len(row["a_needs"]) else np.tile(np.array([-LAST, LAST]), (len(block.ids), 1, 1))
                    held[name] = Best(block, needs[:, :, 0], needs[:, :, 1], k)
                if row["part"] != last:
                    last, bucket = row["part"], Bucket(row)
                held[name].visit(bucket)
        for x in held.values():
            yield x.found()

    rows = meets.mapInArrow(run, "anchor long, slot int, id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_negatives(rows: DataFrame, anchors: str = "id % 50 = 0", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per anchor and positive the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of its label; a positive's negatives are the best rows of
    other labels whose score is low to high percent of its score (so there are none below a score of 0).
    Higher scores come first, then smaller ids, null ids last. Rows with a null label, vector or component,
    or one that is not finite, take no part; vectors of other lengths end in zeros; an id may repeat, each
    row counts. Scores are exact; beyond 64 bits they are the nearest number within. An empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    vectors = whole_vectors(rows, id_col, vector_col, label_col, scale)
    buckets = write_table(blocks(vectors, BUCKET, True), "buckets")
    asked = vectors.filter(anchors)
    own = write_table(blocks(asked, BLOCK, False), "anchors")
    best = write_table(search(buckets, own, F.col("a.label") == F.col("b.label"), positives), "positives")
    drop_table(own)
    # an anchor's needs: its positives' ranges in order, then empty ones
    none = F.array(F.lit(LAST).cast("long"), F.lit(-LAST).cast("long"))
    spans = best.select("anchor", "rank", F.when(F.col("score") >= 0, F.array(ceil_percent("score", low), floor_percent("score", high))).otherwise(none).alias("span"))
    spans = spans.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "span"))).alias("spans"))
    needs = F.flatten(F.concat(F.transform("spans", lambda x: x["span"]), F.array_repeat(none, positives - F.size("spans"))))
    targets = asked.join(spans.withColumnRenamed("anchor", "row"), "row").withColumn("needs", needs)
    wanted = write_table(blocks(targets, BLOCK, False, "needs"), "targets")
    hard = search(buckets, wanted, F.col("a.label") != F.col("b.label"), negatives)
    pairs = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")).join(best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "anchor")
    return pairs.join(hard, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def ceil_percent(score: str, percent: int):
    """The least whole number of at least that percentage of a score of 0 or more, without overflow."""
    return F.expr(f"({score} div 100) * {percent} + (({score} % 100) * {percent} + 99) div 100")


def floor_percent(score: str, percent: int):
    return F.expr(f"({score} div 100) * {percent} + (({score} % 100) * {percent}) div 100")
