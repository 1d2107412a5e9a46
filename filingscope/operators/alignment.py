"""How a document's sentences stand to those of the one before: kept in order, moved, added, removed, by exact alignment."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.functions.columns import normalize_text, split_sentences
from filingscope.operators.documents import neighbours

#: Bits of rows that an alignment keeps at once; longer pairs are cut in two first.
MOST_BITS = 1 << 28

RUN = "array<struct<kind: string, old_start: int, new_start: int, n: int>>"
RUNS = pa.list_(pa.struct([("kind", pa.string()), ("old_start", pa.int32()), ("new_start", pa.int32()), ("n", pa.int32())]))


def _masks(a: list) -> dict:
    masks: dict = defaultdict(int)
    for i, x in enumerate(a):
        masks[x] |= 1 << i
    return masks


def _rows(a: list, b: list):
    """Bit rows of the table of longest common subsequences: bit i of a row is 0 where a[: i + 1] has one more than a[:i]."""
    masks, full = _masks(a), (1 << len(a)) - 1
    row = full
    for x in b:
        both = row & masks.get(x, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """Of all a[:i]: the length of its longest common subsequence with b."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), count=len(a), bitorder="little")
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _common(a: list, b: list, at: int, to: int) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > MOST_BITS and len(b) > 1:  # only the middle's lengths are kept
        half = len(b) // 2
        ahead, back = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])[::-1]
        cut = int((ahead + back).argmax())
        return _common(a[:cut], b[:half], at, to) + _common(a[cut:], b[half:], at + cut, to + half)
    rows, out, i, j = list(_rows(a, b)), [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if j and not rows[j - 1] >> (i - 1) & 1:
            continue
        i -= 1
        out.append((at + i, to + j))
    return out[::-1]


def align(old: list, new: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in order. Ends that are equal, and what only one side has, cost nothing."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    shared = set(a) & set(b)
    left, right = ([i for i, x in enumerate(y) if x in shared] for y in (a, b))
    inner = _common([a[i] for i in left], [b[i] for i in right], 0, 0)
    ends = [(len(old) - k, len(new) - k) for k in range(tail, 0, -1)]
    return [(i, i) for i in range(head)] + [(head + left[i], head + right[j]) for i, j in inner] + ends


def runs(old: list, new: list) -> list[tuple[str, int | None, int | None, int]]:
    """(kind, first place in old, first place in new, sentences): kept and moved ones have both places, added and removed one.

    A sentence is moved if it is not in the common order but stands elsewhere on both sides; the first such
    place in the old text goes with the first in the new one, and so on.
    """
    kept = align(old, new)
    gone, come = sorted(set(range(len(old))) - {i for i, _ in kept}), sorted(set(range(len(new))) - {j for _, j in kept})
    waiting = defaultdict(list)
    for i in reversed(gone):
        waiting[old[i]].append(i)
    moved = [(waiting[new[j]].pop(), j) for j in come if waiting.get(new[j])]
    away, here = {i for i, _ in moved}, {j for _, j in moved}
    steps = [("kept", i, j) for i, j in kept] + [("moved", i, j) for i, j in moved] + [("removed", i, None) for i in gone if i not in away] + [("added", None, j) for j in come if j not in here]
    out: list = []
    for kind, i, j in steps:
        last = out[-1] if out else None
        if last and last[0] == kind and all(x is None or x == y + last[3] for x, y in ((i, last[1]), (j, last[2]))):
            last[3] += 1
        else:
            out.append([kind, i, j, 1])
    return [tuple(x) for x in out]


def section_alignment(docs: DataFrame, company: str, order: str, text_col: str = "text") -> DataFrame:
    """(company, order, previous, kind, old_start, new_start, n): runs of sentences of each document against its company's one before.

    Sentences are the normalised ones of split_sentences(), repeats included, told apart by 64-bit hashes; only
    these are exchanged, and a task has two documents' at a time. The alignment is exact (a longest common
    subsequence). A company's first document has no rows; of documents with one order any comes first.
    """
    ids = F.transform(split_sentences(normalize_text(text_col)), lambda x: F.xxhash64(x))
    rows = docs.select(F.col(company).alias("c"), F.col(order).alias("o"), F.coalesce(ids, F.array().cast("array<bigint>")).alias("ids"))
    pairs = neighbours(docs, company, order).filter("previous is not null").dropDuplicates(["c", "o"]).select("c", "o", "previous")
    new = rows.dropDuplicates(["c", "o"]).join(pairs.withColumnRenamed("c", "pc").withColumnRenamed("o", "po"), F.col("c").eqNullSafe(F.col("pc")) & (F.col("o") == F.col("po")))
    old = rows.dropDuplicates(["c", "o"]).select(F.col("c").alias("oc"), F.col("o").alias("oo"), F.col("ids").alias("old"))
    both = new.join(old, F.col("c").eqNullSafe(F.col("oc")) & (F.col("previous") == F.col("oo"))).select("c", "o", "previous", "old", "ids")
    schema = f"c {both.schema['c'].dataType.simpleString()}, o {both.schema['o'].dataType.simpleString()}, previous {both.schema['previous'].dataType.simpleString()}, runs {RUN}"

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "old_start", "new_start", "n"), r)) for r in runs(x, y)] for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, RUNS)], names=["c", "o", "previous", "runs"])

    return both.mapInArrow(run, schema).select(F.col("c").alias(company), F.col("o").alias(order), "previous", F.inline("runs"))


def text_diff(pairs: DataFrame, keys: list[str], old_col: str, new_col: str) -> DataFrame:
    """(keys, part, kind, text): two texts as runs of words kept, removed and added, in reading order (removed before added).

    The kept words are a longest common subsequence; words are parted by white space and joined by one space. Null
    texts are empty; equal texts are one kept run. A task has one pair at a time.
    """
    schema = ", ".join([*(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys), "parts array<struct<kind: string, text: string>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))

    def diff(batches):
        for b in batches:
            at = len(keys)
            out = [_parts((x or "").split(), (y or "").split()) for x, y in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), pa.array(out, kind)], names=[*keys, "parts"])

    rows = pairs.select(*keys, F.col(old_col).cast("string").alias("_old"), F.col(new_col).cast("string").alias("_new")).mapInArrow(diff, schema)
    return rows.select(*keys, F.posexplode("parts").alias("part", "p")).select(*keys, "part", "p.kind", "p.text")


def _parts(old: list[str], new: list[str]) -> list[dict]:
    out: list[dict] = []

    def add(kind: str, words: list[str]) -> None:
        if words and out and out[-1]["kind"] == kind:
            out[-1]["text"] += " " + " ".join(words)
        elif words:
            out.append({"kind": kind, "text": " ".join(words)})

    i = j = 0
    for a, b in [*align(old, new), (len(old), len(new))]:
        add("removed", old[i:a])
        add("added", new[j:b])
        add("kept", old[a : a + 1])
        i, j = a + 1, b + 1
    return out
