"""Alignment of sentences against the table of longest common subsequences."""

import random

import pytest

from filingscope.operators import alignment as A


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(row[j - 1], last[j])
    return row[-1]


@pytest.mark.parametrize("most", [1 << 28, 40])
def test_alignment_is_longest_and_in_order(monkeypatch, most):
    monkeypatch.setattr(A, "MOST_BITS", most)
    rng = random.Random(4)
    for n in range(300):
        a = [rng.randint(0, rng.choice([2, 6, 40])) for _ in range(rng.randint(0, 40))]
        b = a[:] if n % 3 else [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 6)):
            if b:
                b.insert(rng.randrange(len(b)), b.pop(rng.randrange(len(b))) if rng.random() < 0.5 else rng.randint(0, 50))
        pairs = A.align(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        found = A.runs(a, b)
        assert sorted(i + k for kind, i, _, m in found if i is not None for k in range(m)) == list(range(len(a)))
        assert sorted(j + k for kind, _, j, m in found if j is not None for k in range(m)) == list(range(len(b)))
        left = [sorted(y[i + k] for kind, *at, m in found if kind == x for i in [at[s]] for k in range(m)) for s, (x, y) in enumerate((("removed", a), ("added", b)))]
        assert not set(left[0]) & set(left[1])


def test_moves_and_long_texts():
    assert A.runs(list("abcdef"), list("defabc")) in ([("kept", 0, 3, 3), ("moved", 3, 0, 3)], [("kept", 3, 0, 3), ("moved", 0, 3, 3)])
    assert A.runs([], []) == [] and A.runs([1, 1], []) == [("removed", 0, None, 2)] and A.runs([], [1]) == [("added", None, 0, 1)]
    a = list(range(30_001))
    b = a[:10_000] + [-1] + a[20_000:] + a[10_000:20_000]
    assert A.runs(a, b) == [("kept", 0, 0, 10_000), ("kept", 20_000, 10_001, 10_001), ("moved", 10_000, 20_002, 10_000), ("added", None, 10_000, 1)]


def test_documents_are_aligned_with_the_one_before(spark):
    s = ["The first sentence is about the year.", "The second sentence is about the risks.", "The third sentence is about the rest."]
    texts = [("a", 1, " ".join(s)), ("a", 2, " ".join([s[2], s[0], s[1]])), ("a", 3, " ".join([s[2], s[0], s[0]])), ("a", 4, None), ("b", 1, s[0]), (None, 1, s[0]), (None, 2, s[0])]
    df = spark.createDataFrame([(*x, "clash") for x in texts], "company string, at int, text string, ids string")
    got = sorted((tuple(r) for r in A.section_alignment(df, "company", "at").collect()), key=str)
    want = [("a", 2, 1, "kept", 0, 1, 2), ("a", 2, 1, "moved", 2, 0, 1), ("a", 3, 2, "kept", 0, 0, 2), ("a", 3, 2, "removed", 2, None, 1), ("a", 3, 2, "added", None, 2, 1), ("a", 4, 3, "removed", 0, None, 3), (None, 2, 1, "kept", 0, 0, 1)]
    assert got == sorted(want, key=str)
    assert A.section_alignment(df.filter("false"), "company", "at").collect() == []


def test_query_equals_brute_force_on_all_pairs(spark, sf):
    from collections import defaultdict

    from pyspark.sql import functions as F

    from filingscope.functions.columns import normalize_text, split_sentences
    from filingscope.plans.registry import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", split_sentences(normalize_text("text")).alias("s"))
    texts = {(r.source, r.doc_id): r.s for r in docs.collect()}
    found = defaultdict(list)
    for r in QUERIES["section_alignment"](spark, sf).collect():
        found[r.source, r.doc_id].append(r)
    for (source, doc), new in texts.items():
        older = [d for s, d in texts if s == source and d < doc]
        if not older:
            assert (source, doc) not in found
            continue
        old, rows = texts[source, max(older)], found[source, doc]
        assert sum(r.n for r in rows if r.kind == "kept") == longest(old, new)
        assert all(old[r.old_start : r.old_start + r.n] == new[r.new_start : r.new_start + r.n] for r in rows if r.kind in ("kept", "moved"))
        assert sum(r.n for r in rows if r.kind != "added") == len(old) and sum(r.n for r in rows if r.kind != "removed") == len(new)


def test_words_of_two_texts(spark):
    rows = [(1, "We may fail to grow", "We will never fail to  grow now"), (2, None, "new"), (3, "same\ntext", "same text"), (4, "gone", ""), (5, None, None)]
    got = {}
    for r in A.text_diff(spark.createDataFrame([(*x, "clash") for x in rows], "id int, a string, b string, parts string"), ["id"], "a", "b").orderBy("id", "part").collect():
        got.setdefault(r.id, []).append((r.kind, r.text))
    assert got == {1: [("kept", "We"), ("removed", "may"), ("added", "will never"), ("kept", "fail to grow"), ("added", "now")], 2: [("added", "new")], 3: [("kept", "same text")], 4: [("removed", "gone")]}
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 20))] for _ in range(2))
        parts = A._parts(a, b)
        side = lambda other: [w for p in parts if p["kind"] != other for w in p["text"].split()]
        assert side("added") == a and side("removed") == b and sum(len(p["text"].split()) for p in parts if p["kind"] == "kept") == longest(a, b)
