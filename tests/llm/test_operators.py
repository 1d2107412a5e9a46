"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TROUBLE = [(900, None), (901, ""), (902, "   \n \t"), (903, "one"), (None, "an id is missing here and that is fine"), (904, "same text twice " * 3), (904, "same text twice " * 3), (905, "same text twice " * 3), (906, "é" * 50 + " ä " + "x" * 3000)]


def words(rng, n, size=400):
    return [f"w{int(rng.paretovariate(0.6)) % size}" for _ in range(n)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    out = [(i, "\n".join(" ".join(words(rng, rng.randint(3, 14))) + "." for _ in range(rng.randint(1, 12)))) for i in range(n)]
    for i in range(n, n + 20):  # near copies
        w = out[rng.randrange(n)][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append((i, " ".join(w)))
    out += [(i, out[5][1]) for i in range(n + 20, n + 26)]
    return out + TROUBLE


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    for name in ("score", "row", "set", "bucket", "length", "shard", "_rank", "n_lines"):  # names that operators use inside
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def text_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- sharding


def test_jump_hash_moves_only_into_the_new_shard():
    from filingscope.llm.sharding import jump_buckets

    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20_000)
    for n in (1, 2, 16, 100):
        a, b = jump_buckets(keys, n), jump_buckets(keys, n + 1)
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02 and a.max() < n


def test_shards(docs, rows, empty):
    from filingscope.llm.sharding import assign_shards

    got = assign_shards(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    assert assign_shards(empty).count() == 0


# --- packing


def brute_best_fit(lengths, window):
    left = []
    for x in sorted(lengths, reverse=True):
        fit = [(c, i) for i, c in enumerate(left) if c >= x]
        if fit:
            left[min(fit)[1]] -= x
        else:
            left.append(window - x)
    return sorted(left)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    from filingscope.llm.packing import best_fit_plan

    rng = random.Random(seed)
    lengths = [min(64, int(rng.paretovariate(0.7))) for _ in range(400)]
    left = defaultdict(lambda: 64)
    counts = Counter(lengths)
    seen = Counter()
    for length, a, b, first, each, offset in best_fit_plan(counts, 64):
        for r in range(a, b):
            w = first + (r - a) // each
            assert 64 - left[w] == offset + (r - a) % each * length
            left[w] -= length
            seen[length] += 1
    assert seen == counts and sorted(left.values()) == brute_best_fit(lengths, 64)


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from filingscope.llm.packing import pack, padding

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for at in range(0, len(ids), 64):
            want[i, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes()), len(ids)] += 1
    packed = pack(docs, window=64)
    got = packed.collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert padding(packed, 64).first()["n_tokens"] == sum(r["length"] for r in got)
    assert pack(empty).count() == 0


ODD = ["", " ", "  ", "a  b", " a b ", "a \n b\n\nc", "<|endoftext|> x <|endoftext|>", "don't  stop", "a　b ﬁ \t\t x", "1 23  456", "é" * 20 + " ß" * 5, "a b   c", "\x1c a \x1d\x1e b", "ab" * 300, "▁ under ▁▁ score", "<s> a </s> <0x41>", "😀 😀😀 x"]


def test_segments_give_the_libraries_ids():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from filingscope.llm.tokens import ByteBpe, Pieces

    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab é.\n\t 1'▁<|>") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()] + ["\u200b", "\u2060", "\ufeff", "\u180e"]
    texts += ["".join(rng.choice([*spaces, " ", " ", "a", "B", "é", "1", "'s", "-", "漢"]) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    texts += [" ".join("".join(rng.choice("0123456789") for _ in range(rng.choice([1, 3, 9, 40, 300]))) for _ in range(rng.randint(1, 6))) + rng.choice(["", " ", ".", "\n"]) for _ in range(200)]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in ByteBpe("byte_bpe_50k.json").encode(texts)] == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [np.frombuffer(x, "<u4").tolist() for x in Pieces("piece_bpe_32k.model").encode(texts)] == model.encode(texts)


# --- token counts


def test_token_counts_and_widened_overlaps(spark, docs, rows, empty):
    import public_tokenizers
    import sentencepiece

    from filingscope.llm.token_counts import count_tokens

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows), key=str)
    got = count_tokens(docs, chunk=100, overlap=4)  # 3000 letters without a space force wider overlaps
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()), key=str) == want
    odd = spark.createDataFrame(list(enumerate(ODD * 3)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(odd, chunk=16, overlap=2).collect()} == {i: len(model.encode(t)) for i, t in enumerate(ODD * 3)}
    assert count_tokens(empty).count() == 0


# --- WARC


def test_warc(spark):
    from filingscope.llm.warc import parse_record, read_archives, seek_table, write_archives

    big, small = "x" * 150, "y" * 50
    pages = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "http://b/", big), (1, "u", small), (2, "u", small), (4, "u", None), (None, "u", big), (6, "u", "é" * 80)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "payload": F.lit("clash")})
    index = write_archives(df, frame_bytes=500)
    got = {r["page_id"]: r for r in read_archives(index, with_payload=True).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), None: ("response", None), 6: ("response", None)}
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert got[i]["record_type"] == "revisit" or bytes(got[i]["payload"]) == data
    for bundle in {r["bundle"] for r in index.collect()}:
        frames = seek_table(bundle)
        mine = index.filter(F.col("bundle") == bundle).collect()
        assert {(r["frame_at"], r["frame_size"], r["frame_bytes"]) for r in mine} == set(frames)
    with pytest.raises(Exception, match="name different frames"):
        read_archives(index.withColumn("frame_size", F.col("frame_size") + 1)).count()
    with pytest.raises(ValueError):
        parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
    assert read_archives(write_archives(df.limit(0))).count() == 0


# --- quality rules


def test_fertility(docs, rows, empty):
    from filingscope.llm.fertility import fertility_rules

    got = {r["doc_id"]: r for r in fertility_rules(docs).collect()}
    for i, t in rows:
        w = text_words(t)
        n = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        twice = {j + m for j in range(len(w) - 7) if n[tuple(w[j : j + 8])] > 1 for m in range(8)}
        lines = [x for x in (t or "").split("\n") if text_words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(twice) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert fertility_rules(empty).count() == 0


def test_entropy_sees_every_token():
    from filingscope.llm.fertility import token_metrics

    def entropy(ids):
        return token_metrics(np.array(ids, "<u4"), 1, np.zeros(1000, bool))[3]

    def share(window):
        return sum(-c / 256 * math.log2(c / 256) for c in Counter(window).values()) / 8

    rng = random.Random(4)
    for n in (256, 257, 400, 511, 512, 700):
        ids = [rng.randrange(1000) for _ in range(n)]
        windows = [ids[a : a + 256] for a in range(0, n - 255, 256)] + ([ids[-256:]] if n % 256 else [])
        assert abs(entropy(ids) - sum(map(share, windows)) / len(windows)) < 1e-9
    assert entropy([*range(256), *[7] * 255]) < 0.6 < 0.999 < entropy(range(256))
    assert entropy([1, 2, 3, 4]) == 1


def test_bands_reject_what_stands_out(spark):
    from filingscope.llm.fertility import fertility_rules

    rng = random.Random(2)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    good = [(i, " ".join(rng.choice(vocab) for _ in range(300)), "en") for i in range(200)]
    bad = [(500, " ".join(rng.choice(vocab[:3]) + str(i % 7) for i in range(300)), "en"), (501, " ".join("".join(chr(rng.randint(0x1F300, 0x1F5FF)) for _ in range(4)) for _ in range(100)), "en")]
    got = {r["doc_id"]: r["kept"] for r in fertility_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert not got[500] and not got[501] and sum(got[i] for i, _, _ in good) >= 198


def test_bands_by_brute_force(spark):
    """All of kept from the libraries' ids: quartiles by bins, reach, wider bands for short texts."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from filingscope.llm.fertility import LEAST_TOKENS, METRICS, REACH, STEADY, fertility_rules, script_of

    rng = random.Random(6)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    greek = ["".join(rng.choice("αβγδεζηθικλμ") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([40, 800])]) for _ in range(rng.randint(10, 500))), rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(i, " ".join(rng.choice(greek) for _ in range(rng.randint(30, 200))), None) for i in range(200, 240)]
    rows += [(300 + i, " ".join(rng.choice(vocab) + rng.choice(["", "☃☂", "7" * i]) for _ in range(200)), "en") for i in range(12)] + [(400, None, "en"), (401, "", None), (402, "only one text of its language " * 4, "xx")]
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def entropy(ids):
        size = min(len(ids), 256)
        parts = [ids[a : a + size] for a in range(0, len(ids) - size + 1, size)] + ([ids[-size:]] if len(ids) % size else [])
        return sum(-c / size * math.log2(c / size) for p in parts for c in Counter(p).values()) / len(parts) / max(math.log2(size), 1)

    known = {}
    for i, t, lang in rows:
        a, b = pieces.encode(t or ""), whole.encode(t or "", add_special_tokens=False).ids
        if a:
            values = (len(t) / len(a), sum(map(pieces.is_byte, a)) / len(a), entropy(a), len(t) / len(b), entropy(b))
        else:
            values = (0.0,) * 5
        known[i] = (lang or script_of(t or ""), len(a), dict(zip(METRICS, values)))
    want = {}
    for i, t, _ in rows:
        band, n, values = known[i]
        w = text_words(t)
        grams = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        twice = {j + m for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for m in range(8)}
        good = not (len(w) < 20 or 100 * len(twice) > 30 * len(w))
        for m, (width, least, side) in METRICS.items():
            bins = sorted(math.floor(v[m] / width) for b, k, v in known.values() if b == band and k >= LEAST_TOKENS)
            if not bins or n < LEAST_TOKENS:
                continue
            q1, q3 = ((next(x for j, x in enumerate(bins) if bins.count(x) + sum(y < x for y in bins) >= q * len(bins)) + 0.5) * width for q in (0.25, 0.75))
            margin = REACH * max(q3 - q1, least) * max(1.0, math.sqrt(STEADY / n))
            good &= not (side != "high" and values[m] < q1 - margin or side != "low" and values[m] > q3 + margin)
        want[i] = good
    got = {r["doc_id"]: r["kept"] for r in fertility_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == want and 0 < sum(want.values()) < len(want) - 3
    assert {script_of("abc"), script_of("αβγ a"), script_of("12"), script_of("漢字")} == {"Latin", "Greek", "none", "Cjk"}


# --- line dedup


def brute_lines(docs, least):
    lines = [[(k, x.strip(" \t\n\r\x0b\x0c"), len(text_words(x))) for k, x in enumerate((t or "").split("\n")) if text_words(x)] for _, t in docs]
    out = []
    for a, mine in enumerate(lines):
        dead = set()
        for i in range(len(mine)):
            best = 0
            for b in range(a + 1):
                for j in range(len(lines[b]) if b < a else i):
                    n = 0
                    while i + n < len(mine) and j + n < len(lines[b]) and mine[i + n][1] == lines[b][j + n][1]:
                        n += 1
                    best = max(best, n)
            if best and sum(x[2] for x in mine[i : i + best]) >= least:
                dead |= set(range(i, i + best))
        gone = {mine[k][0] for k in dead}
        t = docs[a][1]
        out.append((docs[a][0], len(mine), len(dead), t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return out


@pytest.mark.parametrize("least", [1, 6, 20])
def test_line_dedup(spark, empty, least):
    from filingscope.llm.line_dedup import MADE, dedupe_lines

    rng = random.Random(least)
    pool = [" ".join(f"v{rng.randrange(9)}" for _ in range(rng.randint(1, 7))) for _ in range(14)]
    docs = [(i, "\n".join(rng.choice([*pool, " " + pool[0], "", "  "]) for _ in range(rng.randint(0, 12)))) for i in range(25)]
    docs += [(30, None), (31, ""), (32, docs[3][1]), (33, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("clash"), "n": F.lit(1), "n_chars": F.lit(0)}).repartition(3)
    got = dedupe_lines(df, least)
    assert got.columns == ["doc_id", "text", "row", "n", "n_chars", *MADE]
    assert sorted((r["doc_id"], r["n_lines"], r["n_deleted"], r["text"]) for r in got.filter("doc_id <> 30").collect()) == [x for x in brute_lines(docs, least) if x[0] != 30]
    assert got.filter("doc_id = 30 and text is null and n_deleted = 0").count() == 1
    assert dedupe_lines(empty).count() == 0


def brute_runs(texts, least):
    """(text, first, n, text and line of the first copy) of all maximal runs with an earlier copy."""
    lines = [[(x.strip(), len(text_words(x))) for x in t.split("\n") if text_words(x)] for t in texts]
    out = []
    for a, mine in enumerate(lines):
        last = 0
        for i in range(len(mine)):
            best, where = 0, None
            for b in range(a + 1):
                for j in range(len(lines[b]) if b < a else i):
                    n = 0
                    while i + n < len(mine) and j + n < len(lines[b]) and mine[i + n][0] == lines[b][j + n][0]:
                        n += 1
                    if n > best:
                        best, where = n, (b, j)
            if best and best != last - 1 and sum(x[1] for x in mine[i : i + best]) >= least:
                out.append((a, i, best, *where))
            last = best
    return sorted(out)


@pytest.mark.parametrize("least", [1, 12])
def test_maximal_runs(spark, least):
    from filingscope.llm.line_dedup import line_table, repeated_runs

    rng = random.Random(40 + least)
    pool = [f"v{i} " * rng.randint(1, 5) for i in range(6)]
    long = [f"line {i} of a long run" for i in range(45)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(20)]
    texts += ["\n".join(["start", *long, "end"]), "\n".join(long[3:24]), "\n".join(long[2:30] + ["other"] + long[5:26]), "\n".join(["same"] * 21), "\n".join(["same"] * 33), "\n".join(long)]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc long, row long, text string").repartition(3)
    got = sorted((r["row"], r["first"], r["n"], r["origin"]["row"], r["origin"]["at"]) for r in repeated_runs(line_table(rows, least)).collect())
    assert got == brute_runs(texts, least) and any(n > 20 for _, _, n, _, _ in got)


# --- Jaccard join


def brute_groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    ids = defaultdict(list)
    for a in range(len(rows)):
        ids[find(a)].append(rows[a][0])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in ids.items()}
    return sorted(((rows[a][0], len(sets[a]), least[find(a)] if sets[a] else rows[a][0]) for a in range(len(rows))), key=str)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(docs, rows, empty, k, percent):
    from filingscope.llm.jaccard_join import join_sets

    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join_sets(docs, k, percent).collect()), key=str)
    assert got == brute_groups(rows, k, percent)
    assert join_sets(empty).count() == 0


def test_chains_and_large_groups(spark):
    from filingscope.llm.jaccard_join import join_sets

    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows, last = [], list(base)
    for i in range(40):  # a chain: neighbours link, ends don't
        last = list(last)
        last[3 * i % 120] = f"c{i}"
        rows.append((i, " ".join(last)))
    for i in range(100, 160):  # copies of one text that link to it and often not to each other
        w = [f"d{j}" for j in range(200)]
        for _ in range(3):
            w[rng.randrange(200)] = f"e{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    for i in range(200, 260):  # near copies of a text that is not there: some link to each other
        w = [f"g{j}" for j in range(150)]
        for _ in range(rng.randint(1, 4)):
            w[rng.choice([5, 40, 80, 120, rng.randrange(150)])] = f"h{rng.randrange(6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for short in (1, 3, 1000):  # all lists by their pivots, some, none
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join_sets(df, short=short).collect()), key=str)
        assert got == brute_groups(rows, 4, 85)


def test_one_of_each_group_stays_by_row(spark, empty):
    from filingscope.llm.jaccard_join import keep_one

    rng = random.Random(3)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    near = b.split()
    near[30] = "changed"
    near = " ".join(near)
    rows = [(3, b), (7, a), (7, near), (8, c), (8, c), (None, a), (None, "only here without an id"), (9, None), (9, None), (10, ""), (11, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("clash") for x in ("set", "key", "n", "root", "_id")})
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, b), (7, a), (8, c), (None, "only here without an id"), (9, None), (9, None), (10, "")], key=str)
    assert keep_one(empty).count() == 0


# --- decontamination


def test_block_max_wand_finds_all():
    from filingscope.llm.decontamination import BlockMaxIndex

    rng = random.Random(5)
    items = [(i, " ".join(words(rng, rng.randint(5, 30), 150)) + ".") for i in range(60)]
    index = BlockMaxIndex(items)
    dense = np.zeros((len(index.terms), len(index.ids)))
    for t in range(len(index.terms)):
        at, w = index.postings(t)
        dense[t, at] = w
    for _ in range(60):
        q = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 50)))
        for threshold in (0.2, 0.5, 0.9):
            want = np.flatnonzero(dense[q].sum(axis=0) >= threshold - 1e-6).tolist()
            assert [i for i, _ in index.search(q, threshold)] == want
            of, term = np.repeat([0, 1, 2], len(q)), np.array(q * 3)
            bounds = np.array([sum(index.bound(t, b) for t in q) for b in range(index.blocks)])
            reached = index.reachable(of, term, threshold)
            assert reached.tolist() == [i * index.blocks + b for i in range(3) for b in np.flatnonzero(bounds >= threshold - 1e-6)]
            assert [i for i, _ in index.search(q, threshold, reached[: len(reached) // 3])] == want


def test_leaks(spark, docs, empty):
    from filingscope.llm.decontamination import find_leaks

    rng = random.Random(11)
    items = [(i, " ".join(f"q{rng.randrange(80)}" for _ in range(rng.randint(12, 40))) + ". " + " ".join(f"a{rng.randrange(80)}" for _ in range(5)) + ".") for i in range(20)] + [(90, None), (91, ""), (92, "...")]
    own, want = [], set()
    for d in range(80):
        w = words(rng, rng.randint(0, 400))
        if d % 3 == 0:
            item = items[rng.randrange(20)]
            at = rng.randrange(len(w) + 1)
            text = item[1].upper() + " !!" if d % 2 else item[1]
            w[at:at] = text.split()
            want.add((d, item[0]))
        if d % 3 == 1:  # the question without its answer
            w += items[rng.randrange(20)][1].split(". ")[0].split()
        own.append((d, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(own, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench, slice_items=6).collect()} == want
    assert find_leaks(docs, bench.limit(0)).count() == 0 == find_leaks(empty, bench).count()


def test_scores_do_not_depend_on_slices(spark):
    from filingscope.llm.decontamination import find_leaks

    rng = random.Random(12)
    items = [(i, " ".join(f"q{rng.randrange(60)}" for _ in range(rng.randint(12, 40))) + ". " + " ".join(f"a{rng.randrange(60)}" for _ in range(5)) + ".") for i in range(90)]
    texts = []
    for d in range(120):  # parts of items, around the threshold
        w = items[rng.randrange(90)][1].split()
        texts.append((d, " ".join(words(rng, 30) + [x if rng.random() < 0.85 else "other" for x in w] + words(rng, 30))))
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    got = [sorted(tuple(r) for r in find_leaks(df, bench, question=0.2, answer=0.2, slice_items=n).collect()) for n in (5, 40, 512)]
    assert got[0] == got[1] == got[2] and len(got[2]) > 30


def test_short_items_and_marks(spark):
    from filingscope.llm.decontamination import BlockMaxIndex, find_leaks, search_text, without_leaks

    bench = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), *[(i, f"x{i} y{i} z{i}") for i in range(3, 15)]], "item_id long, text string")
    df = spark.createDataFrame([(1, "z10 alpha, beta x10"), (2, "z10 delta x11 gamma"), (None, "so: Alpha Beta!"), (None, "beta alpha"), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench).collect()] == [(1, 1), (None, 1)]
    assert sorted(((r["doc_id"], r["text"]) for r in without_leaks(df, bench).collect()), key=str) == sorted([(2, "z10 delta x11 gamma"), (None, "beta alpha"), (3, None)], key=str)
    item = " ".join(f"t{i} -" for i in range(62))  # every second word is a mark
    index = BlockMaxIndex([(1, item)])
    terms = {w: i for w, i in index.terms.items()}
    for before in range(0, 130):
        text = ["other"] * before + item.split() + ["other"] * 40
        ids = np.array([terms.get(w, -2 if w == "-" else -1) for w in text])
        assert [(r[0], round(r[1], 6)) for r in search_text(index, ids, 0.99, 0.9, 0.9)] == [(0, 1.0)]


# --- Katz backoff


def brute_katz(train):
    """P(w | u, v) of a word trigram model with Katz backoff, and its words; start and unknown words are None."""
    from filingscope.llm.katz import discounts

    grams = [Counter(), Counter(), Counter()]
    for x in train:
        y = [None, None, *x]
        for i in range(2, len(y)):
            for k in range(3):
                grams[k][tuple(y[i - k : i + 1])] += 1
    d = [discounts(Counter(g.values())) for g in grams]
    n = sum(grams[0].values())
    after = [defaultdict(Counter) for _ in range(3)]
    for k in range(3):
        for g, c in grams[k].items():
            after[k][g[:-1]][g[-1]] = c
    star = lambda k, c: d[k][c if c <= 5 else 0] * c
    left = {}

    def p(context, w):
        k = len(context)
        seen = after[k].get(context)
        if k == 0:
            return star(0, seen[w]) / (n + 1) if seen and w in seen else 1 - sum(star(0, c) for c in (seen or {}).values()) / (n + 1)
        if not seen:
            return p(context[1:], w)
        total = sum(seen.values())
        if w in seen:
            return star(k, seen[w]) / (total + 1)
        if context not in left:
            left[context] = (1 - sum(star(k, c) for c in seen.values()) / (total + 1)) / (1 - sum(p(context[1:], x) for x in seen))
        return left[context] * p(context[1:], w)

    return p, after, grams[0]


def test_katz(spark, docs, rows, empty):
    from filingscope.llm.katz import katz_scores

    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    train = [x for (i, _), x in zip(rows, tokens) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    p, after, count = brute_katz(train)
    for k in (1, 2):  # every context's probabilities sum to 1
        for context in [*list(after[k])[::40], (b"never", b"seen")[:k], (b"never", b"w1")[2 - k :]]:
            assert abs(sum(p(context, w[0]) for w in count) + p(context, None) - 1) < 1e-9
    n, v = sum(count.values()), len(count)
    want = []
    for (i, _), x in zip(rows, tokens):
        base = sum(math.log10((count[w,] + 1) / (n + v + 1)) for w in x)
        score = sum(math.log10(p((a, b), w)) for a, b, w in zip([None, None, *x], [None, *x], x))
        want.append((str(i), len(x), sum((w,) in count for w in x), n, base, score))
    for made in (docs, docs.repartition(11)):  # how texts are dealt to messages changes nothing
        got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in katz_scores(made, bucket=500).collect()]
        assert [x[:4] for x in sorted(got)] == [x[:4] for x in sorted(want)]
        assert all(abs(a - b) < 1e-4 for x, y in zip(sorted(got), sorted(want)) for a, b in zip(x[4:], y[4:]))
    assert sum(r["held_out"] for r in katz_scores(docs).collect()) == len(rows) - len(train)
    assert katz_scores(empty).count() == 0
    only = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "no text to learn from")], "doc_id long, text string")
    assert [(r["n_known"], r["train_tokens"], r["score"]) for r in katz_scores(only).collect()] == [(0, 0, 0.0)]


def test_katz_tables(spark, docs, rows, tmp_path):
    from filingscope.llm.katz import katz_scores, read_counts, read_weights

    katz_scores(docs, bucket=500, tables=f"file://{tmp_path}").count()
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    _, after, count = brute_katz([x for (i, _), x in zip(rows, tokens) if i is None or zlib.crc32(str(i).encode()) % 7 != 2])
    got = Counter((r["order"], r["n"]) for r in read_counts(spark, f"file://{tmp_path}").collect())
    assert got == Counter((k + 1, c) for k in range(3) for x in after[k].values() for c in x.values())
    weights = read_weights(spark, f"file://{tmp_path}")
    assert weights.filter("seen > 0").groupBy("order").count().orderBy("order").collect() == [(1, len(after[1])), (2, len(after[2]))]
    assert weights.select("bucket").distinct().count() > 20


def test_katz_message_size_changes_nothing(spark, sf):
    from filingscope.llm import katz

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = {r["doc_id"]: r["score"] for r in katz.katz_scores(docs).collect()}
    parts = {r["doc_id"]: r["score"] for r in katz.katz_scores(docs.repartition(9), bucket=10_000).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[i] - parts[i]) < 1e-4 for i in whole)


def test_katz_beats_its_base_on_held_out_texts(spark, sf):
    from filingscope.llm.katz import katz_scores

    held = katz_scores(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]


# --- quality classifier


def test_ftrl_update_is_the_published_one():
    from filingscope.llm.quality_classifier import Ftrl

    m = Ftrl(4, alpha=0.5, beta=1.0, l1=0.0, l2=0.0)
    p = m.learn(np.array([3]), 1)
    assert p == 0.5 and abs(m.z[3] - (-0.5)) < 1e-12 and abs(m.n[3] - 0.25) < 1e-12
    assert abs(m.weights(np.array([3]))[0] - 0.5 / ((1 + 0.5) / 0.5)) < 1e-12


def test_quality_scores_by_brute_force(spark):
    """A plain FTRL over dictionaries, fed the same rows in the same order, gives the same scores."""
    import xxhash

    from filingscope.llm.quality_classifier import ALPHA, BETA, BITS, EPOCHS, L1, L2, classify_quality

    full = (1 << 64) - 1

    def mix(h):
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & full
        return h ^ (h >> 33)

    def bag(text):
        h, out = [], set()
        for token in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or ""):
            h.append(xxhash.xxh3_64_intdigest(("#" if token.isdigit() else "^" + token.lower() if len(token) > 1 and token.isupper() else token.lower()).encode()))
        h = [0xA5A5 if i and h[i] == h[i - 1] else x for i, x in enumerate(h)]
        out = {mix(x) >> 64 - BITS for x in h} | {mix((b + mix((a + 0x9E3779B97F4A7C15) & full)) & full) >> 64 - BITS for a, b in zip(h, h[1:])}
        return sorted(out)

    rng = random.Random(19)
    rows = [(i, " ".join(rng.choice([w, w.upper(), w, "7" * (i % 4)]) for w in words(rng, rng.randint(0, 40), 60)) + rng.choice(["", " !!", " ##"])) for i in range(80)] + [(90, None)]
    labels = {i: int(rng.random() < 0.6) for i in range(80)}
    train = sorted((np.array(bag(t), "<i4").tobytes(), i) for i, t in rows if i in labels and t is not None and zlib.crc32(str(i).encode()) % 5 != 0)
    texts, z, n = dict(rows), defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= L1 else (math.copysign(L1, z[k]) - z[k]) / ((BETA + math.sqrt(n[k])) / ALPHA + L2)
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for j in order.permutation(len(train)):
            i = train[j][1]
            at = bag(texts[i])
            x = {k: 1 / math.sqrt(max(1, len(at))) for k in at} | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - labels[i]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / ALPHA * w[k]
                n[k] += g * g
    want = {}
    for i, t in rows:
        at = bag(t)
        want[i] = 1 / (1 + math.exp(-(weight("bias") + sum(weight(k) for k in at) / math.sqrt(max(1, len(at))))))
    got = {r["doc_id"]: r for r in classify_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    assert all(abs(got[i]["score"] - want[i]) < 1e-4 and got[i]["predicted"] == (got[i]["score"] >= 0.3) for i in want) and len({round(x, 2) for x in want.values()}) > 10


def test_quality_on_held_out_rows(spark, docs, empty):
    from filingscope.llm.quality_classifier import classify_quality

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = words(rng, rng.randint(30, 80))
        rows.append((i, " ".join(w if good else [x + rng.choice(["$$$", "###", "%%%"]) for x in w])))
        labels.append((i, int(good)))
    lab = spark.createDataFrame([*labels, (None, 1), (7000, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classify_quality(spark.createDataFrame(rows, "doc_id long, text string"), lab).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in got if got[i]["held_out"]] and {i for i in got if got[i]["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.95 * len(held)
    odd = classify_quality(docs, lab).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert classify_quality(empty, lab).count() == 0
    assert {r["score"] for r in classify_quality(docs, lab.limit(0)).collect()} == {0.5}


def test_quality_reads_one_text_of_an_id_however_often_it_repeats(spark):
    from filingscope.llm.quality_classifier import fit_quality

    once = [(i, f"{'good words stand here' if i % 2 else 'bad### words'} {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    fits = [fit_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels) for rows in (once, once + [once[7]] * 500 + [(8, "z last in order")])]
    assert fits[0].any() and (fits[0] == fits[1]).all()
