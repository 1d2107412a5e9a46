"""Exact Jaccard join of word-shingle sets, up to connected groups, with set relations that skip work.

Texts are read once. An exchange of their tokens tells which tokens more than one set has and how many
do; only those return. A set's order of tokens is: those that no other has, then by frequency. A set
whose prefix has no shared token has no links. The others are indexed by the shared tokens of their
prefixes, with positions. In a short list, pairs whose positions leave room for the overlap that a link
needs are compared. In a long list all sets are compared with one pivot, the most typical set, and its
answers give theirs: the overlap of two sets is known from their overlaps with the pivot but for the
tokens in which both differ from it. Pairs without room in these differences are skipped, again by
position, so a group of near copies costs about its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.llm.common import WordHashes, bucket_of, drop_table, pack, pack_sorted, shingles, slices_of, texts_of, unpack, unpack_sorted, write_table

WORDS, PERCENT = 4, 85
#: Tokens that one task of the exchange handles, on average; sets and tokens of one message at most.
BUCKET, MESSAGE_SETS, MESSAGE_TOKENS = 1_000_000, 4_000, 1_000_000
#: A token that more sets of a message have is sent once.
OFTEN = 16
#: Names of sets that a task remembers, to send copies once.
SEEN = 200_000
#: Sets in a list up to which its pairs are looked at.
SHORT = 32
HOT = 0xFFFF
#: Turns a token that a set lacks into another than one that it has beyond the pivot.
LACKS = np.uint64(0x5851F42D4C957F2D)


def token_set(text: bytes | None, hashes: WordHashes, k: int) -> np.ndarray:
    """A whole text's distinct k-word shingles as sorted 64-bit hashes; A-Z in lower case."""
    return np.unique(shingles(hashes.of((text or b"").lower().split()), k))


def digest(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).astype(np.int64))


def prefix_length(n, percent: int):
    return n + percent * -n // 100 + 1


def least_overlap(a, b, percent: int):
    """Common tokens that sets of a and b tokens need (numbers, arrays or columns)."""
    if isinstance(a, str):
        return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")
    return -(-percent * (a + b) // (100 + percent))


FIELDS = "batch string, bucket int, home binary, tokens binary, sets binary, counts binary"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]
KINDS = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)


def send_tokens(docs: DataFrame, buckets: int, k: int) -> DataFrame:
    """(id, text, key) -> messages of a few thousand sets: their tokens by bucket, and what stays with the message."""

    def send(batches):
        part, hashes, seen = TaskContext.get().partitionId(), WordHashes(), set()
        number, about, sets, total = 0, [], [], 0

        def flush():
            name = f"{part}-{number}"
            tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            own = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])
            by = np.argsort(tokens, kind="stable")
            tokens, own = tokens[by], own[by]
            starts, ends = slices_of(tokens)
            counts = ends - starts
            often = counts > OFTEN
            few = np.repeat(~often, counts)
            hot, hot_counts = tokens[starts[often]], counts[often]
            home = np.array([(d or 0, d is None, n, s, key, at) for d, n, s, key, at in about], np.int64)
            rows = [(name, number % buckets, pack(home), pack_sorted(hot), pack(own[~few]), pack(hot_counts.astype(np.int64)))]
            keys = np.concatenate([tokens[few], hot])
            of = np.concatenate([own[few], np.full(len(hot), HOT, np.uint16)])
            weight = np.concatenate([np.ones(int(few.sum()), np.int64), hot_counts])
            by = np.argsort(keys, kind="stable")
            keys, of, weight = keys[by], of[by], weight[by]
            to = bucket_of(keys, buckets)
            for a, b in zip(*slices_of(to)):
                rows.append((name, int(to[a]), None, pack_sorted(keys[a:b]), pack(of[a:b]), pack(weight[a:b])))
            return _rows(rows)

        for batch in batches:
            for doc, text, key in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
                tokens = token_set(text, hashes, k)
                name, at = digest(tokens), -1
                if len(tokens) and name not in seen:
                    if len(seen) < SEEN:
                        seen.add(name)
                    at = len(sets)
                    sets.append(tokens)
                    total += len(tokens)
                about.append((doc, len(tokens), name, key, at))
                if len(about) >= MESSAGE_SETS or total >= MESSAGE_TOKENS:
                    yield flush()
                    number, about, sets, total = number + 1, [], [], 0
        if about:
            yield flush()

    return docs.mapInArrow(send, FIELDS)


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's messages -> the same without the tokens that one set alone has; counts are now those of all sets."""
    home, asked = rows[rows["home"].notna()], rows[rows["home"].isna()]
    if not len(asked):
        return home
    parts = [unpack_sorted(x) for x in asked["tokens"]]
    tokens, sets, weight = np.concatenate(parts), np.concatenate([unpack(x, np.uint16) for x in asked["sets"]]), np.concatenate([unpack(x, np.int64) for x in asked["counts"]])
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    by = np.argsort(tokens, kind="stable")
    starts, ends = slices_of(tokens[by])
    counts = np.empty(len(tokens), np.int64)
    counts[by] = np.repeat(np.add.reduceat(weight[by], starts), ends - starts)
    shared = counts > 1
    tokens, sets, counts, row = tokens[shared], sets[shared], counts[shared], row[shared]
    out = [(asked["batch"].iloc[row[a]], asked["bucket"].iloc[0], None, pack_sorted(tokens[a:b]), pack(sets[a:b]), pack(counts[a:b])) for a, b in zip(*slices_of(row))]
    return pd.concat([home, pd.DataFrame(out, columns=NAMES)]) if out else home


SETS = "doc long, key long, set long, n int, tokens binary"


def _assemble(percent: int):
    """A message's answers -> its rows (doc, key, set, n); with the shared tokens in order, where the prefix has one."""

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        own, answers = rows[rows["home"].notna()].iloc[0], rows[rows["home"].isna()]
        home = unpack(own["home"], np.int64).reshape(-1, 6)
        tokens = np.concatenate([np.zeros(0, np.uint64), *map(unpack_sorted, answers["tokens"])])
        sets = np.concatenate([np.zeros(0, np.uint16), *(unpack(x, np.uint16) for x in answers["sets"])])
        counts = np.concatenate([np.zeros(0, np.int64), *(unpack(x, np.int64) for x in answers["counts"])])
        hot, here = unpack_sorted(own["tokens"]), unpack(own["counts"], np.int64)
        many = sets == HOT
        by = np.argsort(tokens[many])
        tokens, counts = np.concatenate([tokens[~many], np.repeat(hot, here)]), np.concatenate([counts[~many], np.repeat(counts[many][by], here)])
        sets = np.concatenate([sets[~many], unpack(own["sets"], np.uint16)])
        by = np.lexsort((tokens, counts, sets))
        tokens, sets = tokens[by], sets[by]
        ordered = {int(sets[a]): tokens[a:b] for a, b in zip(*slices_of(sets))}
        out = [ordered[at].tobytes() if at in ordered and n - len(ordered[at]) < prefix_length(n, percent) else None for n, at in home[:, [2, 5]].tolist()]
        docs = pd.Series([None if none else d for d, none in home[:, :2].tolist()], dtype=object)
        return pd.DataFrame({"doc": docs, "key": home[:, 4], "set": home[:, 3], "n": home[:, 2].astype(np.int32), "tokens": out})

    return assemble


def describe_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, text, key) -> a row per text: doc, key, set (its name), n (tokens) and, if it may have links, its shared tokens."""
    size = docs.agg(F.sum(F.octet_length(docs.columns[1]))).first()[0] or 0
    buckets = max(64, size // 6 // BUCKET + 1)
    answered = write_table(send_tokens(docs, buckets, k).groupBy("bucket").applyInPandas(_answer, FIELDS), "answered")
    sets = write_table(answered.groupBy("batch").applyInPandas(_assemble(percent), SETS), "sets")
    drop_table(answered)
    return sets


def prefixes(live: DataFrame, percent: int) -> DataFrame:
    """(token, set, n, pos) of the shared tokens in the sets' prefixes; pos counts the tokens before it."""

    def cut(batches):
        for batch in batches:
            out = []
            for name, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(data, np.int64)
                alone = n - len(tokens)
                tokens = tokens[: prefix_length(n, percent) - alone]
                out.append((tokens, np.full(len(tokens), name), np.full(len(tokens), n, np.int32), np.arange(alone, alone + len(tokens), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["token", "set", "n", "pos"])

    return live.select("set", "n", "tokens").mapInArrow(cut, "token long, set long, n int, pos int")


def room(percent: int, a: str = "l", b: str = "r"):
    """Whether two entries of a list leave room for a link: by the sets' sizes and by what stands from the positions on."""
    need = least_overlap(f"{a}.n", f"{b}.n", percent)
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return sizes & (F.col(f"{a}.n") - F.col(f"{a}.pos") >= need) & (F.col(f"{b}.n") - F.col(f"{b}.pos") >= need)


def compare(pairs: DataFrame, live: DataFrame, differ: bool = False) -> DataFrame:
    """(a, b) -> (a, b, na, nb, common), and with differ alone and both tokens in which b differs from a."""
    one, two = (live.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}")) for x in "ab")
    fields = "a long, b long, na int, nb int, common int" + ", sa int, differ array<long>" * differ
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches):
        for batch in batches:
            a, b, na, nb, ta, tb = batch.columns
            common, shared, other, last, old = [], [], [], None, None
            for x, t, u in zip(a.to_pylist(), ta, tb):
                if x != last:
                    last, old = x, np.sort(np.frombuffer(t.as_py(), np.uint64))
                new = np.sort(np.frombuffer(u.as_py(), np.uint64))
                both = np.intersect1d(old, new, assume_unique=True)
                common.append(len(both))
                if differ:
                    shared.append(len(old))
                    lacks, more = (np.setdiff1d(y, both, assume_unique=True) for y in (old, new))
                    other.append(np.concatenate([lacks ^ LACKS, more]).view(np.int64))
            made = [pa.array(common, pa.int32())]
            if differ:
                made += [pa.array(shared, pa.int32()), pa.array(other, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([a, b, na, nb, *made], names=names)

    # a pivot of very many sets is one large join key, which AQE splits
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, fields)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the least node that links reach. Rounds double the reach."""
    both = write_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    table = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        roots = table.select("node", "root")
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        better = roots.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = better.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = write_table(better.join(jump, "root", "left").select("node", "old", F.coalesce("next", "root").alias("root")), "roots")
        drop_table(table)
        if found.filter("old != root").isEmpty():
            drop_table(both)
            return found.select("node", "root")
        table = found


def links_by_differences(near: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among sets near the same pivot, from (a: pivot, b: set, na, nb, common, sa, differ).

    Of sets x and y near a pivot with sa shared tokens, the overlap is common(x) + common(y) - sa + the
    differences that both have. Where the first part is enough, the set with the highest score of the
    group links to both. All other links need differences in common: those of few sets come first,
    and positions tell which pairs have room. Pairs that are linked through the pivot are skipped.
    """
    whole = 100 + percent
    score = F.col("common") * whole - F.col("nb") * percent
    near = near.select(F.col("a").alias("p"), F.col("b").alias("x"), "na", F.col("nb").alias("n"), F.col("common").alias("c"), "sa", "differ", score.alias("score"))
    top = near.groupBy("p").agg(F.max(F.struct("score", "x")).alias("top"))
    near = near.join(top, "p").withColumn("sure", F.col("score") + F.col("top.score") >= F.col("sa") * whole)
    near = near.withColumn("tag", F.when(F.col("score") >= F.col("na") * percent, 1).when(F.col("sure"), 2).otherwise(0))
    near = write_table(near.withColumn("size", F.col("sa") + F.col("n") - 2 * F.col("c")), "near")
    stars = near.filter("sure and top.x != x").select(F.col("top.x").alias("a"), F.col("x").alias("b"))
    spread = near.select("p", "x", "n", "c", "sa", "tag", "size", F.explode("differ").alias("token"))
    often = spread.groupBy("p", "token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    of = Window.partitionBy("p", "x")
    spread = spread.join(often, ["p", "token"])
    placed = spread.withColumn("pos", F.col("size") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("many", "token")) - 1)
    least = F.greatest(F.lit(1), least_overlap("n", "sa", percent) - F.col("c"))
    entries = write_table(placed.filter(F.col("pos") <= F.col("size") - least).drop("many"), "differences")
    need = least_overlap("l.n", "r.n", percent) - F.col("l.c") - F.col("r.c") + F.col("l.sa")
    fits = (F.col("l.size") - F.col("l.pos") >= need) & (F.col("r.size") - F.col("r.pos") >= need)
    once = (F.col("r.tag") == 1) | (F.col("l.x") < F.col("r.x"))
    apart = (F.col("l.tag") != F.col("r.tag")) | (F.col("l.tag") == 0)
    met = entries.filter("tag != 1").alias("l").join(entries.alias("r"), (F.col("l.p") == F.col("r.p")) & (F.col("l.token") == F.col("r.token")) & once & apart & fits)
    pairs = write_table(met.select(F.col("l.p").alias("p"), F.col("l.x").alias("x"), F.col("r.x").alias("y")).distinct(), "pairs-near")
    one, two = (near.select("p", F.col("x").alias(y), *(F.col(c).alias(f"{c}_{y}") for c in ("n", "c", "differ")), *(["sa"] if y == "x" else [])) for y in "xy")
    overlap = F.col("c_x") + F.col("c_y") - F.col("sa") + F.size(F.array_intersect("differ_x", "differ_y"))
    links = write_table(pairs.join(one, ["p", "x"]).join(two, ["p", "y"]).filter(overlap >= least_overlap("n_x", "n_y", percent)).select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(stars), "links-near")
    drop_table(near, entries, pairs)
    return links


def find_links(live: DataFrame, percent: int, short: int = SHORT) -> DataFrame:
    """(set, n, tokens) -> links (a, b) that connect just the sets that all links of percent % similarity connect."""
    entries = write_table(prefixes(live, percent), "entries")
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    lists = write_table(entries.join(lists, "token"), "lists")
    drop_table(entries)
    few, long = lists.filter(F.col("many") <= short).drop("many"), lists.filter(F.col("many") > short)
    ordered = F.col("l.set") < F.col("r.set")
    pairs = few.alias("l").join(few.alias("r"), (F.col("l.token") == F.col("r.token")) & ordered & room(percent)).select(F.col("l.set").alias("a"), F.col("r.set").alias("b"))
    # the pivot of a long list is the set that meets most others in long lists
    typical = long.groupBy("set").agg(F.sum("many").alias("typical"))
    pivots = long.join(typical, "set").groupBy("token").agg(F.max(F.struct("typical", "set", "n")).alias("top"))
    pivots = write_table(pivots.select("token", F.col("top.set").alias("pivot"), F.col("top.n").alias("np")), "pivots")
    pivoted = write_table(long.drop("many").join(pivots, "token"), "pivoted")
    near_size = F.least("n", "np") * 100 >= F.greatest("n", "np") * percent
    asked = pivoted.filter((F.col("set") != F.col("pivot")) & near_size).select(F.col("pivot").alias("a"), F.col("set").alias("b")).distinct()
    near = write_table(compare(asked, live, differ=True).filter(F.col("common") * 2 >= least_overlap("na", "nb", percent)), "pivot-answers")
    linked = F.col("common") >= least_overlap("na", "nb", percent)
    # sets that are not near a list's pivot meet all sets of the list
    known = near.select(F.col("a").alias("pivot"), F.col("b").alias("set"), F.lit(True).alias("near"))
    status = pivoted.join(known, ["pivot", "set"], "left").withColumn("near", F.coalesce("near", F.col("set") == F.col("pivot")))
    status = write_table(status.select("token", "set", "n", "pos", "near"), "status")
    far = status.filter("not near").alias("l").join(status.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.set") != F.col("r.set")) & (F.col("r.near") | ordered) & room(percent))
    pairs = pairs.unionByName(far.select(F.least("l.set", "r.set").alias("a"), F.greatest("l.set", "r.set").alias("b")))
    pairs = write_table(pairs.distinct(), "pairs")
    links = compare(pairs, live).filter(linked).select("a", "b").unionByName(near.filter(linked).select("a", "b"))
    links = write_table(links.unionByName(links_by_differences(near, percent)), "links-found")
    drop_table(lists, pivots, pivoted, near, status, pairs)
    return links


def group_sets(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """(doc, key, set, n) of every row, key being a hash of its text, and (set, root) of the sets that have links."""
    text = F.col(text_col).cast("string")
    sets = describe_sets(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key")), k, percent)
    live = write_table(sets.filter("tokens is not null").select("set", "n", "tokens").dropDuplicates(["set"]), "live")
    members = write_table(sets.drop("tokens"), "members")
    drop_table(sets)
    links = find_links(live, percent, short)
    drop_table(live)
    roots = components(links)
    drop_table(links)
    return members, roots.withColumnRenamed("node", "set")


def join_sets(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least id that links of percent % similarity reach.

    Texts without words have no shingles and no links; fewer words than k are one shingle; rows with
    equal sets are one set. A null id is nobody's component. Links that others connect already are
    not listed, so there is no number of links; no link between components is lost. An empty table
    gives an empty result; other columns, whatever their names, are not read.
    """
    members, roots = group_sets(docs, k, percent, id_col, text_col, short)
    kinds = members.filter("n > 0").groupBy("set").agg(F.min("doc").alias("doc"))
    grouped = kinds.join(roots, "set", "left").select("set", "doc", F.coalesce("root", "set").alias("root"))
    least = grouped.groupBy("root").agg(F.min("doc").alias("least"))
    answers = write_table(grouped.join(least, "root").select("set", "least"), "answers")
    return members.join(answers, "set", "left").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc")).otherwise(F.col("doc")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay if one of each group of linked texts does: that with the least id (nulls last).

    Rows without a word have no links and stay. Decisions are by row, not by id: rows with one id and
    different texts are told apart by the texts, and of equal rows one stays.
    """
    members, roots = group_sets(docs, k, percent, id_col, text_col)
    rows = members.groupBy("doc", "key", "set", "n").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("first")
    chosen = rows.filter("n > 0").groupBy("root").agg(first)
    stays = rows.join(chosen, "root", "left").filter((F.col("n") == 0) | (F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.key") == F.col("key"))))
    stays = write_table(stays.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), "times", F.col("n").alias("words")), "stays")
    drop_table(members, roots)
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_hash"))
    left = own.join(stays, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_key")))
    once = left.filter("times = 1 or words = 0").select("_row")
    again = left.filter("times > 1 and words > 0").dropDuplicates(["_id", "_hash"]).select("_row")
    return once.unionByName(again).select("_row.*")
