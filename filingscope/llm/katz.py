"""Katz backoff over words: Good-Turing discounted trigrams, bigrams and unigrams with exactly normalised backoff weights.

Texts are read once and become messages of about a million tokens, a table of words and their order.
Each n-gram of a message goes to a bucket of the partitioned tables once; the buckets sum up the
training counts and answer each message. Every n-gram that the training texts have belongs to one message,
which adds its discounted count and its probability at the next lower order to its context; those
contexts that held-out texts have (a text that the model trains on never backs off) are summed up in
the same buckets, and a message gets the sums of those from which its texts back off. Then each token is evaluated recursively: trigram, else bigram, else word, else the
share that is left for unknown words. Nothing is held for the whole vocabulary outside the tables.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.llm.common import MIX, WordHashes, bucket_of, pack, pack_sorted, scramble, slices_of, texts_of, unpack, unpack_sorted, write_table

#: Counts up to which Good-Turing discounts.
DISCOUNTED = 5
#: Tokens of a message (a longer text is one by itself), texts of a message, and keys of a bucket, on average.
MESSAGE_TOKENS, MESSAGE_TEXTS, BUCKET = 1_000_000, 20_000, 1_000_000
#: Bits of a key, two of them the order. Of n keys about n * n / 2**55 pairs are equal by chance: 700 of 5 billion.
KEY_BITS = 56
END_KEY, START_KEY = np.uint64(0), np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of a whole text's words (A-Z in lower case), then the end's key."""
    return np.append(hashes.of((text or b"").lower().split()), END_KEY)


def trains(doc: int | None) -> bool:
    return doc is None or zlib.crc32(str(doc).encode()) % 7 != 2


def discounts(counts: dict[int, int]) -> np.ndarray:
    """Factor of each count 0..DISCOUNTED: Good-Turing's, or (r - 1/2) / r where the counts of counts give none."""
    out = np.ones(DISCOUNTED + 1)
    n1 = counts.get(1, 0)
    cut = (DISCOUNTED + 1) * counts.get(DISCOUNTED + 1, 0) / n1 if n1 else 1.0
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * counts.get(r + 1, 0) / (r * counts[r]) - cut) / (1 - cut) if counts.get(r) and cut < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    """What every task knows: the discounts of the three orders, tokens, words, texts and the share of unknown words."""

    def __init__(self, stats: np.ndarray):
        """stats: per order the keys with counts 1 to DISCOUNTED + 1, the distinct keys and the sum of counts."""
        self.d = [discounts({r + 1: int(n) for r, n in enumerate(x[: DISCOUNTED + 1])}) for x in stats]
        self.n, self.v = int(stats[0][-1]), int(stats[0][-2])
        lost = sum((1 - self.d[0][r]) * r * int(stats[0][r - 1]) for r in range(1, DISCOUNTED + 1))
        self.unknown = 1 - (self.n - lost) / (self.n + 1)

    def discounted(self, order: int, counts: np.ndarray) -> np.ndarray:
        return self.d[order - 1][np.where(counts <= DISCOUNTED, counts, 0)] * counts

    def words(self, counts: np.ndarray) -> np.ndarray:
        """P(word)."""
        return np.where(counts > 0, self.discounted(1, counts) / (self.n + 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))


def _keys(hashes: np.ndarray, order: int) -> np.ndarray:
    return hashes >> np.uint64(66 - KEY_BITS) << np.uint64(2) | np.uint64(order)


class Message:
    """Texts as sequences of local word numbers, and each of their n-grams once.

    words are hashes; before a text stand two starts. one, two and three are the places of each
    token's word, bigram and trigram; a context is a word or the start, or a bigram or two starts.
    """

    def __init__(self, words: np.ndarray, seq: np.ndarray, sizes: np.ndarray):
        v, first = len(words), np.cumsum(sizes) - sizes
        small = np.int32  # places within a message; a message of one huge text has fewer than 2**31 tokens too
        self.words, self.sizes, self.one = words, sizes, seq.astype(small)
        before = np.append(v, seq[:-1])
        before[first] = v
        pairs, two = np.unique(before * (v + 1) + seq, return_inverse=True)
        del before
        self.two = two.astype(small)
        context = np.append(len(pairs), two[:-1])
        context[first] = len(pairs)
        del two
        triples, three = np.unique(context * (v + 1) + seq, return_inverse=True)
        del context
        self.three = three.astype(small)
        del three
        #: context and word of each bigram, context and word of each trigram, and the bigram that a trigram ends with
        self.context2, self.word2 = (pairs // (v + 1)).astype(small), (pairs % (v + 1)).astype(small)
        self.context3, self.word3 = (triples // (v + 1)).astype(small), (triples % (v + 1)).astype(small)
        self.bigram3 = np.empty(len(triples), small)
        self.bigram3[self.three] = self.two
        del pairs, triples
        h1 = np.append(words, START_KEY)
        h2 = scramble(h1[self.context2] * MIX[0] + h1[self.word2] * MIX[1])
        h2 = np.append(h2, scramble(np.array([START_KEY]) * MIX[2]))
        h3 = scramble(h2[self.context3] * MIX[3] + h1[self.word3] * MIX[4])
        #: keys of contexts: words and the start, then bigrams and two starts
        self.context_keys = np.concatenate([_keys(h1, 1), _keys(h2, 2)])
        self.keys = np.concatenate([self.context_keys[:v], self.context_keys[v + 1 : -1], _keys(h3, 3)])
        self.by = np.argsort(self.keys).astype(small)

    def held_contexts(self, train: np.ndarray) -> np.ndarray:
        """Of each key, in the order of keys, whether a token of a held-out text has it as its context."""
        at = np.repeat(~train, self.sizes)
        out = [np.zeros(n, bool) for n in (len(self.words) + 1, len(self.context2) + 1, len(self.context3) + 1)]
        out[0][self.context2[self.two[at]]] = True
        out[1][self.context3[self.three[at]]] = True
        return np.concatenate([x[:-1] for x in out])

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Of each key, in the order of keys: tokens of training texts."""
        at = np.repeat(train, self.sizes)
        numbers = (len(self.words), len(self.context2), len(self.context3))
        return np.concatenate([np.bincount(x[at], minlength=n) for x, n in zip((self.one, self.two, self.three), numbers)])

    @classmethod
    def unpacked(cls, a: bytes, b: bytes, c: bytes) -> tuple["Message", np.ndarray]:
        docs = unpack(c, np.int64).reshape(-1, 4)
        seq = np.ascontiguousarray(unpack(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
        return cls(unpack(a, np.uint64), seq, docs[:, 3]), docs


FIELDS = "kind string, batch string, bucket int, a binary, b binary, c binary"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]
KINDS = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def read_texts(docs: DataFrame) -> DataFrame:
    """(id, text) -> messages (kind home)."""

    def send(batches):
        part, hashes, number, about, texts, total = TaskContext.get().partitionId(), WordHashes(), 0, [], [], 0

        def flush():
            sizes = [len(x) for x in texts]
            words, seq = np.unique(np.concatenate(texts), return_inverse=True)
            # frequent words get small numbers, so that the sequence packs well
            by = np.argsort(-np.bincount(seq), kind="stable")
            place = np.empty(len(by), np.uint32)
            place[by] = np.arange(len(by))
            docs_ = np.array([(d or 0, d is None, trains(d), n) for d, n in zip(about, sizes)], np.int64)
            return _batch([("home", f"{part}-{number}", None, pack(words[by]), pack(place[seq].view(np.uint8).reshape(-1, 4).T), pack(docs_))])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                about.append(doc)
                texts.append(tokens(text, hashes))
                total += len(texts[-1])
                if total >= MESSAGE_TOKENS or len(texts) >= MESSAGE_TEXTS:
                    yield flush()
                    number, about, texts, total = number + 1, [], [], 0
        if about:
            yield flush()

    return docs.mapInArrow(send, FIELDS)


def ask_counts(homes: DataFrame, buckets: int) -> DataFrame:
    """Messages -> by bucket, their n-grams (kind asks) with twice their training counts, and one more for contexts of held-out texts."""

    def ask(batches):
        for batch in batches:
            for name, a, b, c in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                message, docs_ = Message.unpacked(a.as_py(), b.as_py(), c.as_py())
                train = docs_[:, 2] == 1
                keys, counts = message.keys[message.by], (2 * message.counts(train) + message.held_contexts(train))[message.by]
                yield _batch([("asks", name, int(to), pack_sorted(keys[x:y]), pack(counts[x:y]), None) for to, x, y in _buckets(keys, buckets)])

    return homes.select("batch", "a", "b", "c").mapInArrow(ask, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)


def _buckets(keys: np.ndarray, buckets: int):
    to = bucket_of(keys, buckets, KEY_BITS)
    for a, b in zip(*slices_of(to)):
        yield to[a], a, b


def _count(keep: bool):
    """A bucket's messages -> the answers, its counts of counts and, if they are kept, its table of counts.

    An answer is four times a key's count, two more in the message that the key belongs to, the first that
    trains on it, and one more if it is a context of any held-out text.
    """

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("batch")
        keys, own = np.concatenate([unpack_sorted(x) for x in rows["a"]]), np.concatenate([unpack(x, np.int64) for x in rows["b"]])
        sizes = [int(np.frombuffer(x[:4], np.uint32)[0]) for x in rows["a"]]
        by = np.argsort(keys, kind="stable")
        keys, held, own = keys[by], own[by] & 1, own[by] >> 1
        starts, ends = slices_of(keys)
        keys, totals = keys[starts], np.add.reduceat(own, starts)
        value = np.repeat(4 * totals + np.maximum.reduceat(held, starts), ends - starts)
        value[np.minimum.reduceat(np.where(own > 0, np.arange(len(own)), len(own) - 1), starts)[totals > 0]] += 2
        answer = np.empty(len(value), np.int64)
        answer[by] = value
        cuts = np.cumsum([0, *sizes])
        bucket = int(rows["bucket"].iloc[0])
        out = [("answer", name, bucket, None, pack(answer[a:b]), None) for name, a, b in zip(rows["batch"], cuts, cuts[1:])]
        keys, totals = keys[totals > 0], totals[totals > 0]
        stats = np.zeros((3, DISCOUNTED + 3), np.int64)
        for order in (1, 2, 3):
            c = totals[keys & np.uint64(3) == order]
            stats[order - 1] = [*(np.sum(c == r) for r in range(1, DISCOUNTED + 2)), len(c), c.sum()]
        out += [("stats", None, bucket, stats.tobytes(), None, None)]
        out += [("counts", None, bucket, pack_sorted(keys), pack(totals), None)] if keep else []
        return pd.DataFrame(out, columns=NAMES)

    return count


def _opened(rows: pd.DataFrame) -> tuple[Message, np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """A message, its texts (id, null, trains, size), and by order its n-grams' counts, which belong to it, and which are held-out contexts."""
    own = rows[rows["kind"] == "home"].iloc[0]
    message, docs = Message.unpacked(own["a"], own["b"], own["c"])
    answers = rows[rows["kind"] == "answer"].sort_values("bucket")
    value = np.empty(len(message.keys), np.int64)
    value[message.by] = np.concatenate([unpack(x, np.int64) for x in answers["b"]])
    cuts = np.cumsum([len(message.words), len(message.context2)])
    return message, docs, np.split(value >> 2, cuts), np.split(value >> 1 & 1, cuts), np.split(value & 1, cuts)


def _needed(m: Message, docs: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """Of each context key, whether a text backs off from it: a known context that the token was never seen after."""
    one, two = np.zeros(len(m.words) + 1, bool), np.zeros(len(m.context2) + 1, bool)
    lost = counts[2] == 0
    two[m.context3[lost]] = True
    lost &= counts[1][m.bigram3] == 0
    one[m.context2[m.bigram3[lost]]] = True
    one[:-1] &= counts[0] > 0
    two[:-1] &= counts[1] > 0
    return np.concatenate([one, two])


def _contexts(model: Model, buckets: int, whole: bool):
    """A message -> by bucket, its contexts with what its own n-grams add, and which of them it needs (kind adds).

    Unless the whole table is asked for, contexts that no held-out text has are left out.
    """

    def contexts(rows: pd.DataFrame) -> pd.DataFrame:
        m, docs, counts, own, held = _opened(rows)
        g2, g3 = model.discounted(2, counts[1]), model.discounted(3, counts[2])
        seen = [np.bincount(c, w * o, n + 1) for c, w, o, n in ((m.context2, g2, own[1], len(m.words)), (m.context3, g3, own[2], len(m.context2)))]
        lower = [np.bincount(m.context2, model.words(counts[0])[m.word2] * own[1], len(m.words) + 1), np.bincount(m.context3, g2[m.bigram3] * own[2], len(m.context2) + 1)]
        seen, lower, needed = np.concatenate(seen), np.concatenate(lower), _needed(m, docs, counts)
        asked = np.concatenate([held[0], [1], held[1], [1]]) > 0
        at = np.flatnonzero((seen > 0) & (asked | whole) | needed)
        at = at[np.argsort(m.context_keys[at])]
        keys = m.context_keys[at]
        out = [("adds", rows["batch"].iloc[0], int(to), pack_sorted(keys[a:b]), pack(np.stack([seen[at[a:b]], lower[at[a:b]]])), np.packbits(needed[at[a:b]]).tobytes()) for to, a, b in _buckets(keys, buckets)]
        return pd.DataFrame(out, columns=NAMES)

    return contexts


def _weigh(keep: bool):
    """A bucket's contexts -> the sums of those that messages need (kind sums) and, if they are kept, all as a table (kind weights)."""

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("batch")
        parts = [unpack_sorted(x) for x in rows["a"]]
        keys, own = np.concatenate(parts), np.concatenate([unpack(x, np.float64).reshape(2, -1) for x in rows["b"]], axis=1)
        needed = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(rows["c"], parts)])
        by = np.argsort(keys, kind="stable")
        starts, ends = slices_of(keys[by])
        totals = np.add.reduceat(own[:, by], starts, axis=1)
        sums = np.empty(own.shape)
        sums[:, by] = np.repeat(totals, ends - starts, axis=1)
        cuts = np.cumsum([0, *(len(x) for x in parts)])
        bucket = int(rows["bucket"].iloc[0])
        out = [("sums", name, bucket, None, pack(sums[:, a:b][:, needed[a:b]]), None) for name, a, b in zip(rows["batch"], cuts, cuts[1:]) if needed[a:b].any()]
        out += [("weights", None, bucket, pack_sorted(keys[by][starts]), pack(totals), None)] if keep else []
        return pd.DataFrame(out, columns=NAMES)

    return weigh


def _left(seen: np.ndarray, lower: np.ndarray, history: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Backoff weight: what the tokens seen after a context leave, over what their lower orders leave. 1 if none is seen."""
    return np.where(history > 0, (1 - seen / (history + 1)) / (1 - lower / below), 1.0)


def token_probabilities(model: Model, m: Message, counts: list[np.ndarray], sums: np.ndarray) -> np.ndarray:
    """P(token | two before) of each trigram of a message; sums: of each context key, discounted counts and lower orders."""
    v, texts = len(m.words), counts[0][m.words == END_KEY]
    history1, history2 = np.append(counts[0], texts), np.append(counts[1], texts)  # of the start, and of two starts: the training texts
    one, two = sums[:, : v + 1], sums[:, v + 1 :]
    left1 = _left(one[0], one[1], history1, np.ones(v + 1))
    p2 = np.where(counts[1] > 0, model.discounted(2, counts[1]) / (history1[m.context2] + 1), left1[m.context2] * model.words(counts[0])[m.word2])
    last = np.append(m.word2, v)  # of a context of two tokens, the last
    left2 = _left(two[0], two[1], history2, history1[last] + 1)
    return np.where(counts[2] > 0, model.discounted(3, counts[2]) / (history2[m.context3] + 1), left2[m.context3] * p2[m.bigram3])


def _score(model: Model):
    """A message with its answers and sums -> its texts' rows."""

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        m, docs, counts, _, _ = _opened(rows)
        sums = np.zeros((2, len(m.context_keys)))
        at = np.flatnonzero(_needed(m, docs, counts))
        if len(at):
            at = at[np.argsort(m.context_keys[at])]
            found = rows[rows["kind"] == "sums"].sort_values("bucket")
            sums[:, at] = np.concatenate([unpack(x, np.float64).reshape(2, -1) for x in found["b"]], axis=1)
        of, n = np.repeat(np.arange(len(docs)), m.sizes), len(docs)
        score = np.bincount(of, np.log10(token_probabilities(model, m, counts, sums))[m.three], n)
        base = np.bincount(of, model.base(counts[0])[m.one], n)
        known = np.bincount(of, counts[0][m.one] > 0, n).astype(np.int64)
        ids = pd.Series([None if none else i for i, none in docs[:, :2].tolist()], dtype=object)
        return pd.DataFrame({"doc_id": ids, "held_out": docs[:, 2] == 0, "n_tokens": m.sizes, "n_known": known, "train_tokens": model.n, "base_score": np.round(base, 6), "score": np.round(score, 6)})

    return score


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def read_stats(counted: DataFrame) -> np.ndarray:
    """Per order the counts of counts, distinct keys and sum of counts over all buckets."""

    def spread(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(range(len(x) // 8), pa.int32()), pa.array(np.frombuffer(x, np.int64))], names=["at", "n"])

    out = np.zeros(3 * (DISCOUNTED + 3), np.int64)
    for r in counted.filter("kind = 'stats'").select("a").mapInArrow(spread, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(3, -1)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, tables: str | None = None) -> DataFrame:
    """Scores all whole texts; learns from those whose crc32(id as text) mod 7 is not 2 (null ids too).

    A null or empty text is its end alone. Equal rows are scored each; an empty table gives an empty
    result; other columns, whatever their names, are not read. Scores are rounded to six decimals.
    Good-Turing discounts counts up to DISCOUNTED; the discounted count is then divided by the context's count
    + 1, a second discount, so that something is left for words that no context of the training texts had.
    The weights are normalised exactly: the probabilities after any context add up to 1.
    Keys have KEY_BITS bits at every size, so among very many n-grams (1e13) some counts would be shared by chance.
    Where tables names a folder, the counts of all n-grams and the sums of all contexts are kept there,
    by bucket (read_counts, read_weights); else only what messages ask for leaves the buckets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, size * 5 // (16 * bucket) + 1)  # a token has about 5 bytes or more, and 1.6 keys
    homes = write_table(read_texts(rows), "katz-texts")
    counted = write_table(ask_counts(homes, buckets).groupBy("bucket").applyInPandas(_count(bool(tables)), FIELDS), "katz-counts", by="kind")
    model = Model(read_stats(counted))
    texts = homes.unionByName(counted.filter("kind = 'answer'"))
    added = texts.groupBy("batch").applyInPandas(_contexts(model, buckets, bool(tables)), FIELDS)
    weighed = write_table(added.groupBy("bucket").applyInPandas(_weigh(bool(tables)), FIELDS), "katz-weights", by="kind")
    if tables:
        counted.filter("kind = 'counts'").select("bucket", "a", "b").write.mode("overwrite").parquet(f"{tables}/counts")
        weighed.filter("kind = 'weights'").select("bucket", "a", "b").write.mode("overwrite").parquet(f"{tables}/weights")
    return texts.unionByName(weighed.filter("kind = 'sums'")).groupBy("batch").applyInPandas(_score(model), RESULT)


def read_counts(spark: SparkSession, tables: str) -> DataFrame:
    """(bucket, key, order, n): each n-gram of the training texts by its key."""

    def spread(batches):
        for batch in batches:
            for bucket, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                keys = unpack_sorted(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), bucket, np.int32)), pa.array(keys.view(np.int64)), pa.array((keys & np.uint64(3)).astype(np.int32)), pa.array(unpack(b, np.int64))], names=["bucket", "key", "order", "n"])

    return spark.read.parquet(f"{tables}/counts").select("bucket", "a", "b").mapInArrow(spread, "bucket int, key long, order int, n long")


def read_weights(spark: SparkSession, tables: str) -> DataFrame:
    """(bucket, key, order, seen, lower): each context by its key, with the discounted counts after it and their lower orders.

    Its backoff weight is (1 - seen / (n + 1)) / (1 - lower / below), n being its count; below is 1 for a word
    and, for a bigram, its last word's count and 1.
    """

    def spread(batches):
        for batch in batches:
            for bucket, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                keys, sums = unpack_sorted(a), unpack(b, np.float64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), bucket, np.int32)), pa.array(keys.view(np.int64)), pa.array((keys & np.uint64(3)).astype(np.int32)), pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "key", "order", "seen", "lower"])

    return spark.read.parquet(f"{tables}/weights").select("bucket", "a", "b").mapInArrow(spread, "bucket int, key long, order int, seen double, lower double")
