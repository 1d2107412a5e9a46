"""Benchmark decontamination: training passages query a BM25 index of test items by block-max WAND; overlaps are verified."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import texts_of

K1, B = 1.2, 0.75
#: A passage is retrieved if its score is this share of the item's score against itself.
THRESHOLD = 0.6
#: Items per block; items and words in one index, which is broadcast: what is more is searched in another pass.
BLOCK, SLICE, SLICE_WORDS = 4, 20_000, 2_000_000
#: Words of a passage beyond the longest item; words in a row that count as an overlap; shares that verify.
STRIDE, RUN, QUESTION, ANSWER = 64, 3, 0.6, 0.6
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: bytes) -> str:
    """A word without case and outer punctuation."""
    return _EDGE.sub("", word.decode("utf-8", "replace").casefold())


def answer_start(text: str) -> int:
    """Words before an item's answer: the last sentence, or the last quarter of a single sentence."""
    words = text.encode().split()
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1:] in b".?!:"]
    return ends[-1] if ends else len(words) - max(1, len(words) // 4)


def item_terms(text: str) -> list[str]:
    return [n for n in map(normal, text.encode().split()) if n]


class TermIds(dict):
    """word (bytes) -> term of the index, -1 for others, -2 for what has no letter or digit; kept up to a bound."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        name = normal(word)
        self[word] = i = self.terms.get(name, -1) if name else -2
        return i


class BlockMaxIndex:
    """An inverted index of items with BM25 impacts as shares of each item's own score, and each block's largest.

    Postings and block maxima are sparse, in arrays by term (postings at, blocks at). stats are the
    number of items, their mean and greatest length and the document frequencies of the terms, if this
    index holds but a part of the items; scores don't depend on how items are dealt out.
    """

    def __init__(self, items: list[tuple[int, str]], block: int = BLOCK, stats: tuple[int, float, int, dict[str, int]] | None = None):
        items = sorted((i, t) for i, t in items if t and item_terms(t))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.block, self.terms = block, {}
        self.words, self.split, counts = [], [], []
        for _, text in items:
            names = [normal(w) for w in text.encode().split()]
            cut = answer_start(text)
            ids = np.array([self.terms.setdefault(n, len(self.terms)) if n else -1 for n in names])
            self.words.append(ids[ids >= 0])
            self.split.append(int((ids[:cut] >= 0).sum()))
            counts.append(np.unique(ids[ids >= 0], return_counts=True))
        v = len(self.terms)
        lengths = np.array([len(w) for w in self.words])
        df = np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in counts)]), minlength=v).astype(float)
        n, mean, longest = len(items), float(lengths.mean()) if len(items) else 1.0, int(lengths.max()) if len(items) else 0
        if stats is not None:
            n, mean, longest, known = stats
            df = np.array([float(known[t]) for t in self.terms])
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weights = []
        for item, (terms, tf) in enumerate(counts):
            weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
            weights.append(weight / weight.sum())
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in counts)])
        item = np.repeat(np.arange(len(items)), [len(t) for t, _ in counts])
        weight = np.concatenate([np.zeros(0), *weights])
        by = np.lexsort((item, term))
        self.at = np.searchsorted(term[by], np.arange(v + 1))
        self.item, self.weight = item[by], weight[by]
        key = term[by] * (len(items) // block + 1) + self.item // block
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block_at = np.searchsorted(new, self.at)
        self.block_of = (self.item // block)[new]
        self.block_max = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.most = np.maximum.reduceat(self.weight, self.at[:-1]) if v else np.zeros(0)
        self.blocks = -(-len(items) // block)
        self.longest = longest
        self.grams = [self.runs(w) for w in self.words]

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        return self.item[self.at[term] : self.at[term + 1]], self.weight[self.at[term] : self.at[term + 1]]

    def bound(self, term: int, block: int) -> float:
        a, b = self.block_at[term], self.block_at[term + 1]
        at = a + int(np.searchsorted(self.block_of[a:b], block))
        return float(self.block_max[at]) if at < b and self.block_of[at] == block else 0.0

    def _spread(self, of: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage * blocks + block, that block's largest impact) for each block of each term."""
        n = self.block_at[term + 1] - self.block_at[term]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.block_at[term], n)
        return np.repeat(of, n) * self.blocks + self.block_of[at], self.block_max[at]

    def reachable(self, of: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """passage * blocks + block, sorted, of all blocks whose bound reaches the threshold, from passages' distinct terms.

        A block needs one of the terms without which the passage's other, lower maxima stay below the
        threshold; only such terms' blocks are looked up, then their bounds are summed up.
        """
        least = threshold - 1e-6
        by = np.lexsort((self.most[term], of))
        of, term = of[by], term[by]
        total = np.cumsum(self.most[term])
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        before = np.repeat(np.append(0.0, total)[first], np.diff(np.append(first, len(of))))
        needed = total - before >= least
        asked = np.unique(self._spread(of[needed], term[needed])[0])
        if not len(asked):
            return asked
        mine = np.isin(of, asked // self.blocks)
        key, weight = self._spread(of[mine], term[mine])
        at = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
        hit = asked[at] == key
        return asked[np.bincount(at[hit], weight[hit], len(asked)) >= least]

    def runs(self, words: np.ndarray, run: int = RUN) -> np.ndarray:
        """Keys of all `run` words in a row."""
        if len(words) < run:
            return np.zeros(0, np.int64)
        key = words[: len(words) - run + 1].astype(np.int64)
        for i in range(1, run):
            key = key * (len(self.terms) + 2) + words[i : len(words) - run + 1 + i] + 1
        return key

    def search(self, query: list[int], threshold: float, blocks: np.ndarray | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score against the query's distinct terms is at least the threshold.

        blocks are those whose bound is known to reach the threshold (None: all). Cursors are ordered
        by item; the pivot is the first item where the terms' maxima could reach the threshold; a pivot
        whose block can't is skipped to the end of that block.
        """
        lists = [self.postings(t) for t in query]
        cursors = [[0, k] for k in range(len(query)) if len(lists[k][0])]
        found = []
        item = lambda c: int(lists[c[1]][0][c[0]])

        def move(c, to):
            c[0] += int(np.searchsorted(lists[c[1]][0][c[0] :], to))

        least = threshold - 1e-6
        allowed = None if blocks is None else set(np.asarray(blocks).tolist())
        while True:
            cursors = sorted((c for c in cursors if c[0] < len(lists[c[1]][0])), key=item)
            total, pivot = 0.0, None
            for c in cursors:
                total += self.most[query[c[1]]]
                if total >= least:
                    pivot = item(c)
                    break
            if pivot is None:
                return found
            block = pivot // self.block
            ahead = [c for c in cursors if item(c) <= pivot]
            if allowed is not None and block not in allowed:
                following = [b for b in allowed if b > block]
                if not following:
                    return found
                for c in cursors:
                    if item(c) < min(following) * self.block:
                        move(c, min(following) * self.block)
                continue
            if sum(self.bound(query[c[1]], block) for c in ahead) < least:
                # no item up to the block's end or the next cursor's item can reach it
                to = min([(block + 1) * self.block, *(item(c) for c in cursors if item(c) > pivot)])
                for c in ahead:
                    if item(c) < to:
                        move(c, to)
                continue
            score = 0.0
            for c in ahead:
                if item(c) < pivot:
                    move(c, pivot)
                if c[0] < len(lists[c[1]][0]) and item(c) == pivot:
                    score += float(lists[c[1]][1][c[0]])
                    c[0] += 1
            if score >= least:
                found.append((pivot, score))

    def overlap(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of an item's question and answer words that stand in runs which the passage has too."""
        own, split = self.words[item], self.split[item]
        hit = np.zeros(len(own), bool)
        at = np.flatnonzero(np.isin(self.grams[item], self.runs(words))) if len(own) >= RUN else []
        if len(own) < RUN:
            hit[:] = any((words[i : i + len(own)] == own).all() for i in range(len(words) - len(own) + 1))
        for i in range(RUN if len(own) >= RUN else 0):
            hit[np.asarray(at, np.int64) + i] = True
        question, answer = hit[:split], hit[split:]
        return (float(question.mean()) if len(question) else 1.0), (float(answer.mean()) if len(answer) else 1.0)


def passages(n: int, size: int, stride: int) -> np.ndarray:
    """Starts of a text's passages; the last reaches its end."""
    return np.arange(0, max(1, n - size + stride), stride)


def search_text(index: BlockMaxIndex, ids: np.ndarray, threshold: float, question: float, answer: float) -> list[tuple[int, float, float, float, int]]:
    """Verified items of one text: (item, score, question and answer overlap, first word of the best passage).

    Passages are cut among the words that have a letter or digit; first words count all words.
    """
    raw = np.flatnonzero(ids > -2)
    ids = ids[raw]
    stride = max(STRIDE, index.longest)
    size = 2 * stride
    starts = passages(len(ids), size, stride)
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return []
    # distinct terms of each passage, then the blocks that all passages can reach together
    chunk = known // stride
    v = len(index.terms)
    pair = np.concatenate([chunk, chunk - 1]) * v + np.concatenate([ids[known], ids[known]])
    pair = np.unique(pair[(pair >= 0) & (pair < len(starts) * v)])
    if not len(pair):
        return []
    of, term = pair // v, pair % v
    reached = index.reachable(of, term, threshold)
    best: dict[int, tuple] = {}
    for i in np.unique(reached // index.blocks).tolist():
        words = ids[starts[i] : starts[i] + size]
        blocks = reached[reached // index.blocks == i] % index.blocks
        for item, score in index.search(term[of == i].tolist(), threshold, blocks):
            q, a = index.overlap(item, words[words >= 0])
            if q >= question and a >= answer and score > best.get(item, (0, 0.0))[1]:
                best[item] = (item, score, q, a, int(raw[starts[i]]))
    return list(best.values())


def build_indexes(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", slice_items: int = SLICE) -> list:
    """Broadcast indexes of all items, each of bounded size; frequencies and lengths are those of all items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).dropna()

    def cut(batches):
        for batch in batches:
            words = [w for t in batch.column(1).to_pylist() for w in set(item_terms(t))]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["w"])

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(item_terms(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=["n"])

    n, letters = items.agg(F.count(F.lit(1)), F.sum(F.length("t"))).first()
    slices = max(1, -(-n // slice_items), -(-(letters or 0) // (2 * SLICE_WORDS)))
    if slices == 1:
        return [spark.sparkContext.broadcast(BlockMaxIndex([tuple(r) for r in items.collect()]))]
    lengths = items.mapInArrow(measure, "n long").filter("n > 0")
    about = lengths.agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    frequency = items.mapInArrow(cut, "w string").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    out = []
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("i"), F.lit(slices)) == k)
        own = part.mapInArrow(cut, "w string").distinct()
        known = {r["w"]: r["df"] for r in frequency.join(own, "w").collect()}
        out.append(spark.sparkContext.broadcast(BlockMaxIndex([tuple(r) for r in part.collect()], stats=(*about, known))))
    return out


def _found(index: BlockMaxIndex, terms: TermIds, text: bytes | None, limits: tuple[float, float, float]) -> list[tuple]:
    if not text or not len(index.ids):
        return []
    words = text.split()
    return search_text(index, np.fromiter(map(terms.__getitem__, words), np.int64, len(words)), *limits)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_items: int = SLICE) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): test items that whole texts contain.

    Passages overlap by at least the longest item, so an item lies whole in one of them. Items are
    indexed in slices of bounded size, one pass over the documents for each; only a slice reaches the
    driver and is broadcast, and scores are those of one index. Null or empty texts and items match
    nothing; repeated documents each give their rows; an empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = None
    for index in build_indexes(benchmark, item_col, item_text_col, slice_items):

        def search(batches, index=index):
            own = index.value
            terms = TermIds(own.terms)
            for batch in batches:
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                    found += [(doc, int(own.ids[i]), round(s, 6), round(q, 6), round(a, 6), at) for i, s, q, a, at in _found(own, terms, text, (threshold, question, answer))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

        leaks = rows.mapInArrow(search, schema)
        out = leaks if out is None else out.unionByName(leaks)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_items: int = SLICE) -> DataFrame:
    """The rows whose text holds no test item, whatever their ids; rows without a text stay."""
    at = docs.columns.index(text_col)
    for index in build_indexes(benchmark, item_col, item_text_col, slice_items):

        def clean(batches, index=index):
            own = index.value
            terms = TermIds(own.terms)
            for batch in batches:
                yield batch.filter(pa.array([not _found(own, terms, x, (threshold, question, answer)) for x in texts_of(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
