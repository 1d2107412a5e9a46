"""Substring dedup against brute force: passages shared by texts and within one, every phase of the anchors, odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from filingscope.llm import substring_dedup as S

DOCS = "doc_id long, text string, batch string, bits string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """doc -> (n_words, n_removed, kept) of rows in order of their ids."""
    first, out = {}, []
    for at, (_, text) in enumerate(rows):
        w = words_of(text)
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (at, s))
    for at, (doc, text) in enumerate(rows):
        w = words_of(text)
        gone = {i for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (at, s) for i in range(s, s + 20)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    fresh = iter(range(10**9))
    new = lambda k: [f"n{next(fresh)}" for _ in range(k)]
    shared = [new(rng.choice([19, 20, 21, 29, 30, 45, 80])) for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += new(rng.randint(0, 13))
            passage = rng.choice(shared)
            a = rng.randint(0, 5)
            w += passage[a : len(passage) - rng.randint(0, 5)] if rng.random() < 0.6 else passage
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(n + i, rows[7][1]) for i in range(40)]  # exact copies
    rows += [(n + 100 + i, " ".join(shared[6] + [f"v{i % 3}"] + shared[7])) for i in range(60)]  # near copies
    rows += [(990, "again " * 70), (991, "a b c " * 30), (992, None), (993, ""), (994, " \n"), (995, "one two"), (995, "one two")]
    return rows + [(996, "é " * 25 + "x" * 5000), (None, " ".join(shared[7])), (None, " ".join(shared[7]))]


def answer(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.left_text.encode()).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("message", [300, 20_000, 10**9])
def test_substrings_equal_brute_force(spark, message):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], DOCS).repartition(5)
    got = S.dedupe_substrings(docs, message=message)
    assert answer(got) == brute(rows)


def test_wide_keys_give_the_same(spark, monkeypatch):
    rows = corpus(4, 50)
    monkeypatch.setattr(S, "PLAIN", 1)
    assert answer(S.dedupe_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), message=2_000)) == brute(rows)


def test_repeats_are_maximal_and_equal_their_source(spark):
    rows = [(i, t) for i, t in corpus(5, 60) if i is not None and i < 900]
    texts = {i: words_of(t) for i, t in rows}
    got = S.dedupe_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), message=3_000)
    found = [(r.doc_id, x.start, x.words, x.source, x.source_start) for r in got.collect() for x in r.repeats]
    assert found
    for doc, a, n, source, b in found:
        assert n >= 20 and (source, b) < (doc, a) and texts[doc][a : a + n] == texts[source][b : b + n]


def test_a_text_of_a_million_words(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{i}" for i in range(500_000)) + " " + passage + " " + " ".join(f"x{i}" for i in range(500_000)) + " " + passage
    got = {r.doc_id: (r.n_words, r.n_removed) for r in S.dedupe_substrings(spark.createDataFrame([(1, long), (2, passage)], "doc_id long, text string")).collect()}
    assert got == {1: (1_000_120, 60), 2: (60, 60)}


def test_no_rows_and_no_hits(spark):
    assert S.dedupe_substrings(spark.createDataFrame([], DOCS)).collect() == []
    got = S.dedupe_substrings(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.left_text, r.repeats) for r in got) == [(1, 3, 0, "a b c", []), (2, 0, 0, "", [])]


def test_hot_passage_sends_rows_per_message_not_per_copy(spark):
    """A passage of half of all rows: the rows that travel grow with the messages, as do those of the answers."""
    rows = [(i, " ".join([f"u{i}"] + [f"p{j}" for j in range(50)])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("id"), "text")
    sent = S.send_blocks(S.send_texts(docs, 1 << 30), 64, 32)
    assert sent.count() <= 64 * docs.rdd.getNumPartitions()
