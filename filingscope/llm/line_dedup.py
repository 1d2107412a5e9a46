"""Line deduplication: prefix doubling over line-ID sequences, LCP intervals, later copies of repeated runs deleted.

A suffix is a text from one of its lines on. Doubling ranks the suffixes by their first 1, 2, 4, ...
lines until no two are equal. From the longest such prefixes down, the ranks split the suffixes into
the intervals of the suffix array with one longest common prefix: that tells, for each suffix, how many
lines it has in common with an earlier one, and where those stand first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingscope.llm.common import drop_table, texts_of, write_table

#: Words that a repeated run of lines has at least.
MIN_WORDS = 6
#: Rows up to which a step is one plan. Beyond, tables cut it, so that AQE can split joins with a line that very many texts have.
SMALL = 50_000


def run_lengths(words: np.ndarray, least: int) -> np.ndarray:
    """Per line, the lines of the shortest run with `least` words that starts there (0: none)."""
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + least)
    return np.where(end <= len(words), end - np.arange(len(words)), 0)


def line_table(docs: DataFrame, least: int) -> DataFrame:
    """(doc, row, text) -> lines with a word: doc, row, at (among the text's lines with a word), id, ahead."""
    schema = "doc long, row long, at int, id long, ahead int"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())

    def cut(batches):
        import xxhash

        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                lines = [(x, len(x.split())) for x in (text or b"").split(b"\n")]
                lines = [x for x in lines if x[1]]
                ids = np.array([xxhash.xxh3_64_intdigest(x.strip()) for x, _ in lines], np.uint64).view(np.int64)
                ahead = run_lengths(np.array([n for _, n in lines], np.int64), least)
                for c, new in zip(cols, ([doc] * len(lines), [row] * len(lines), range(len(lines)), ids, ahead)):
                    c.extend(new)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc", "row", "text").mapInArrow(cut, schema)


def _ranked(rows: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """doc, row, at and the rank of its keys among the sorted keys that occur twice or more; the others are dropped."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # ids of a range-sorted table are in the keys' order
    ranks = twice.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id())
    ranks = ranks if small else write_table(ranks, "suffix-ranks")
    found = write_table(rows.join(ranks, keys).select("doc", "row", "at", "rank"), "suffixes")
    if not small:
        drop_table(ranks)
    return found


def suffix_ranks(lines: DataFrame) -> dict[int, DataFrame]:
    """h -> (doc, row, at, rank): the suffixes' ranks by their first h lines, for h = 1, 2, 4, ... until none are equal.

    Each round sorts the pairs (rank at h, rank h lines on). Suffixes whose first h lines occur once
    are in no repeated run of h lines and drop out, so later rounds have fewer rows.
    """
    h, levels = 1, {}
    found = _ranked(lines, ["id"], False)
    while n := found.count():
        levels[h] = found
        later = found.select("row", (F.col("at") - h).alias("at"), F.col("rank").alias("later"))
        found = _ranked(found.join(later, ["row", "at"]).withColumnRenamed("rank", "first"), ["first", "later"], n <= SMALL)
        h *= 2
    drop_table(found)
    return levels


def earlier_copies(levels: dict[int, DataFrame]) -> DataFrame | None:
    """(row, at, n, origin): for each suffix with an earlier one that starts with the same line, the most lines n that
    it has in common with an earlier one, and the place (doc, row, at) where these n lines stand first.

    Suffixes are in groups of which the first n lines are known to be equal; at the beginning there is
    one, with n = 0. Each step, of half the lines of the last, splits the groups by the next s lines.
    What is equal there is a group with n + s lines, an interval of the suffix array with that common
    prefix; in the group with n only its first suffix stays, as the others have s lines more in common
    with that one, and for the rest of the group they are no better. So each suffix is looking for
    earlier copies in one group only, the number of rows is twice that of the suffixes at most, and no
    task needs a group as a whole.
    """
    place = F.struct("doc", "row", "at")
    deeper = gone = None
    tables: list[DataFrame] = []
    n = 0
    for s in sorted(levels, reverse=True):
        ranks = levels[s]
        n += ranks.count()
        small = n <= SMALL
        whole = ranks if gone is None else ranks.join(gone, ["row", "at"], "left_anti")
        rows = whole.select(F.lit(0).cast("long").alias("group"), F.lit(0).alias("n"), "doc", "row", "at", F.lit(True).alias("seeks"), "rank", F.lit(None).cast("struct<doc:long,row:long,at:int>").alias("origin"))
        if deeper is not None:
            ahead = ranks.select("row", F.col("at").alias("next"), "rank")
            rows = rows.unionByName(deeper.withColumn("next", F.col("at") + F.col("n")).join(ahead, ["row", "next"], "left").drop("next"))
        rows = rows if small else write_table(rows, "line-groups")
        parts = rows.filter("rank is not null").groupBy("group", "rank").agg(F.min(place).alias("lead"), F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many")
        parts = parts if small else write_table(parts, "line-parts")
        split = rows.join(parts, ["group", "rank"], "left").withColumn("leads", (F.col("lead.row") == F.col("row")) & (F.col("lead.at") == F.col("at")))
        split = write_table(split, "line-split")
        if not small:
            drop_table(rows, parts)
        n = split.filter("group != 0 or lead is not null").count()
        stay = split.filter("group != 0 and (lead is null or leads)").select("group", "n", "doc", "row", "at", "seeks", "origin")
        inner = split.filter("lead is not null")
        inner = inner.select(F.xxhash64("group", "n", F.lit(s), "rank").alias("group"), (F.col("n") + s).alias("n"), "doc", "row", "at", (F.col("seeks") & ~F.col("leads")).alias("seeks"), F.when(F.col("leads"), F.col("origin")).otherwise(F.col("lead")).alias("origin"))
        deeper = stay.unionByName(inner)
        left = split.filter("group = 0 and lead is not null and not leads").select("row", "at")
        gone = left if gone is None else gone.unionByName(left)
        tables.append(split)
    if deeper is None:
        return None
    found = write_table(deeper.filter("seeks").select("row", "at", "n", "origin"), "line-copies")
    drop_table(*tables)
    return found


def repeated_runs(lines: DataFrame) -> DataFrame | None:
    """(row, first, n, origin): all maximal runs of lines with an earlier copy, as long as `ahead` asks for; None: no lines.

    A run goes on as far as an earlier copy of it does, and is left out if it is part of the run that starts a line before.
    """
    levels = suffix_ranks(lines)
    found = earlier_copies(levels)
    if found is None:
        return None
    before = Window.partitionBy("row").orderBy("at")  # the lines of one text
    inside = (F.lag("at").over(before) == F.col("at") - 1) & (F.lag("n").over(before) == F.col("n") + 1)
    maximal = found.withColumn("inside", F.coalesce(inside, F.lit(False))).filter("not inside")
    asked = lines.filter("ahead > 0").select("row", "at", "ahead")
    runs = write_table(maximal.join(asked, ["row", "at"]).filter("n >= ahead").select("row", F.col("at").alias("first"), "n", "origin"), "runs")
    drop_table(found, *levels.values())
    return runs


def _delete(batches):
    """Texts without the lines of their runs, and what was deleted; the columns before pass through."""
    for batch in batches:
        *rest, texts, starts, sizes = batch.columns
        out = []
        for text, first, n in zip(texts_of(texts), starts.to_pylist(), sizes.to_pylist()):
            lines = (text or b"").split(b"\n")
            worded = [i for i, x in enumerate(lines) if x.split()]
            gone = np.zeros(len(worded) + 1, np.int64)
            if first:
                np.add.at(gone, np.array(first), 1)
                np.add.at(gone, np.array(first) + np.array(n), -1)
            flag = np.cumsum(gone)[:-1] > 0
            dead = {worded[i] for i in np.flatnonzero(flag)}
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(int), [0]])))
            kept = text if not dead else b"\n".join(x for i, x in enumerate(lines) if i not in dead)
            out.append((kept, len(worded), len(dead), edges[::2], np.diff(edges)[::2]))
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        made = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)]
        yield pa.RecordBatch.from_arrays([*rest, made[0].cast(pa.string()), *made[1:]], names=[*batch.schema.names[:-3], "text", *MADE])


MADE = ["n_lines", "n_deleted", "run_starts", "run_lines"]


def dedupe_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the text that is left, n_lines (with a word), n_deleted, run_starts and run_lines.

    Lines are compared without outer white space; lines without a word are no part of a run and stay.
    Of each maximal run of equal lines with min_words words at least that occurs again, in one text or
    in others, the first copy by id (nulls first) and place stays whole and later ones are deleted; of
    rows with one id any counts as first. A run is as long as an earlier copy of it, wherever that
    stands, and may overlap its own copy. Other columns are kept (but for such as have the names of
    what is made here); n_chars, if there is one, follows the new text. Null texts stay null.
    """
    others = [c for c in docs.columns if c != text_col and c not in MADE]
    # the row's number is written with the row, so it stays the same when a task runs again
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "line-docs")
    lines = write_table(line_table(rows, min_words), "lines")
    runs = repeated_runs(lines)
    drop_table(lines)
    found = F.array_distinct(F.collect_list(F.struct("first", "n"))).alias("r")
    runs = rows.select("row").limit(0).select("row", F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("n"))).alias("r")) if runs is None else runs.groupBy("row").agg(found)
    # runs grow with the documents, so they are never broadcast
    joined = rows.drop("doc").join(runs.hint("merge"), "row", "left").select(*[f"c{i}" for i in range(len(others))], "text", "r.first", "r.n")
    schema = joined.drop("first", "n", "text").schema
    for name, kind in zip(("text", *MADE), (T.StringType(), T.IntegerType(), T.IntegerType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, kind)
    cut = joined.mapInArrow(_delete, schema)
    length = F.length("text").cast("long")
    names = {c: length if c == "n_chars" else F.col(f"c{i}") for i, c in enumerate(others)} | {text_col: F.col("text")} | {c: F.col(c) for c in MADE}
    order = [c for c in docs.columns if c not in MADE] + MADE
    return cut.select(*[names[c].alias(c) for c in order])
