"""Cheapest repair of conversations' structure by a checkpointed dynamic program, ties resolved to the ASCII-least audit.

A conversation's roles should read system? (user assistant)+. Keeping a turn is free, another role costs 1,
deleting 2 (a must for blank and repeated turns), an inserted empty turn 5, a truncated turn that stays 5
more. The state is what the last turn kept was, so the costs to the end from a place are a vector of four.

Backward vectors are stored at checkpoints only; between them they are computed again while the walk goes
forward and takes, of the edits that keep the cost, the first letter in ASCII order. This is done at two
levels. A conversation is cut into blocks of about the square root of the longest one's turns; each block
gives the cheapest cost between any two states (a min-plus matrix), and from these the vectors at the
blocks' ends, so that a conversation of very many turns is spread over tasks. Inside a block the same is
done at every square root of its turns.
"""

from __future__ import annotations

import hashlib
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import drop_table, texts_of, write_table

#: Turns in a block at least.
BLOCK = 4096
#: A state is what stands last: nothing, a system turn, a user turn, an assistant turn. The state after an inserted turn.
INSERT = (2, 2, 3, 2)
#: The state after a turn of a class (other, system, user, assistant) that is kept; None where its role may not follow.
KEEP = ((None, 1, 2, None), (None, None, 2, None), (None, None, None, 3), (None, None, 2, None))
ROLE = (None, "system", "user", "assistant")
#: A turn's code: its class, and whether it must go, and whether it is truncated.
MUST_GO, CUT = 4, 8
REROLED, DELETED, INSERTED, LEFT_CUT = 1, 2, 5, 5


def inserts(v: list) -> list:
    """The costs from a place if turns may be inserted there (two in a row at most are of use)."""
    one = [min(v[s], v[INSERT[s]] + INSERTED) for s in range(4)]
    return [min(one[s], one[INSERT[s]] + INSERTED) for s in range(4)]


#: Costs at a conversation's end: it may be empty or end with an assistant turn.
END = tuple(inserts([0, inf, inf, 0]))


def before(code: int, v: list) -> list:
    """The costs from before a turn, from those after it."""
    if code & MUST_GO:
        return inserts([x + DELETED for x in v])
    cut, out = LEFT_CUT * (code & CUT > 0), []
    for s in range(4):
        kept = KEEP[s][code & 3]
        out.append(min(v[s] + DELETED, v[INSERT[s]] + REROLED + cut, inf if kept is None else v[kept] + cut))
    return inserts(out)


def matrix(codes: bytes) -> list[int]:
    """Cheapest costs from each state before the block to each state after it (-1: none), row by row."""
    columns = []
    for end in range(4):
        v = [0 if s == end else inf for s in range(4)]
        for code in reversed(codes):
            v = before(code, v)
        columns.append(v)
    return [-1 if columns[e][s] == inf else columns[e][s] for s in range(4) for e in range(4)]


def through(m: list[int], v: list) -> list:
    """The costs from before a block, from its matrix and those after it."""
    return [min((m[4 * s + e] + v[e] for e in range(4) if m[4 * s + e] >= 0), default=inf) for s in range(4)]


class Walk:
    """Forward walks over a block whose costs at its end are known; vectors are kept at checkpoints only."""

    def __init__(self, codes: bytes, end: list, last: bool):
        self.codes, self.end, self.last = codes, list(end), last
        self.step = max(1, isqrt(len(codes)))
        self.marks, v = {len(codes): self.end}, self.end
        for i in range(len(codes) - 1, -1, -1):
            v = before(codes[i], v)
            if i % self.step == 0:
                self.marks[i] = v

    def from_state(self, state: int) -> tuple[int, int, str]:
        """(state at the end, cost, edits): the ASCII-least of the cheapest."""
        audit, i, cost = [], 0, self.marks[0][state]
        while i < len(self.codes):
            stop = min(len(self.codes), i + self.step)
            block = [self.marks[stop]]
            for j in range(stop - 1, i - 1, -1):
                block.append(before(self.codes[j], block[-1]))
            block.reverse()
            for j in range(i, stop):
                state = self._turn(self.codes[j], block[j - i], block[j - i + 1], state, audit)
            i = stop
        if self.last:
            while state not in (0, 3):
                audit.append("I")
                state = INSERT[state]
        return state, cost - (0 if self.last else self.end[state]), "".join(audit)

    @staticmethod
    def _turn(code: int, here: list, after: list, state: int, audit: list) -> int:
        while True:
            left = here[state]
            if after[state] + DELETED == left:
                audit.append("D")
                return state
            if here[INSERT[state]] + INSERTED == left:
                audit.append("I")
                state = INSERT[state]
                continue
            cut = LEFT_CUT * (code & CUT > 0)
            kept = KEEP[state][code & 3]
            if kept is not None and after[kept] + cut == left:
                audit.append("K")
                return kept
            audit.append("R")
            return INSERT[state]


def edits_of(ats: list[int], state: int, audit: str, codes: bytes) -> list[tuple]:
    """(at, edit, role, roles inserted before, roles inserted after) for each turn of a block."""
    out, waiting, turns = [], [], iter(range(len(ats)))
    for letter in audit:
        if letter == "I":
            state = INSERT[state]
            waiting.append(ROLE[state])
            continue
        i = next(turns)
        if letter != "D":
            state = KEEP[state][codes[i] & 3] if letter == "K" else INSERT[state]
        out.append((ats[i], letter, ROLE[state] if letter == "R" else None, waiting, []))
        waiting = []
    if waiting:
        out[-1] = (*out[-1][:4], waiting)
    return out


def arrange(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, at): all turns in order (null turns first; ties by role and text), at numbering them.

    They are sorted in ranges, so a conversation of very many turns, even of equal ones, is in several tasks.
    """
    conv = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit(""))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    own = rows.select(conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    keys = ["conv", "turn", "role", F.sha2("text", 256).alias("hash"), F.monotonically_increasing_id().alias("salt")]
    order = ["conv", "turn", "role", "hash", "salt"]
    ranged = own.select(*keys, "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return write_table(ranged.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "turns")


WORDED, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _faults(turns: DataFrame) -> DataFrame:
    """(conv, at, turn, code, blank, duplicate, truncated): each turn's first fault. Only hashes of texts are exchanged."""
    own = turns.select("conv", "at", "turn", "role", F.sha2("text", 256).alias("hash"), (~F.col("text").rlike(WORDED)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut"))
    seen = turns.groupBy("conv", "role", F.sha2("text", 256).alias("hash")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    found = own.join(seen, ["conv", "role", "hash"], "left")
    blank, duplicate = F.col("blank"), ~F.col("blank") & (F.coalesce("first", "at") != F.col("at"))
    truncated = ~blank & ~duplicate & F.col("cut")
    kind = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    code = kind + F.when(blank | duplicate, MUST_GO).otherwise(0) + F.when(truncated, CUT).otherwise(0)
    return found.select("conv", "at", code.cast("tinyint").alias("code"), *(F.when(x, 1).otherwise(0).cast("long").alias(n) for n, x in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated))))


def _blocks(faults: DataFrame, size: int) -> DataFrame:
    """Blocks of at most size turns: their places and codes in order, and counts of faults and of illegal neighbours inside."""
    rows = faults.groupBy("conv", F.floor(F.col("at") / size).alias("cut")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("t"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    classes = F.transform("codes", lambda x: x.cast("int").bitwiseAND(F.lit(3)))
    pairs = F.zip_with(F.slice("kinds", F.lit(1), F.size("kinds") - 1), F.slice("kinds", F.lit(2), F.size("kinds") - 1), lambda a, b: illegal(a, b))
    rows = rows.select("conv", "blank", "duplicate", "truncated", F.transform("t", lambda x: x["at"]).alias("ats"), F.transform("t", lambda x: x["code"]).alias("codes")).withColumn("kinds", classes)
    rows = rows.withColumn("illegal", F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x))
    return rows.select("conv", F.element_at("ats", 1).alias("begin"), "ats", "codes", "blank", "duplicate", "truncated", "illegal", F.element_at("kinds", 1).alias("first_kind"), F.element_at("kinds", -1).alias("last_kind"))


def illegal(a, b):
    """1 unless role b may follow role a: a user after system or assistant, an assistant after a user."""
    return F.when(((b == 2) & a.isin(1, 3)) | ((a == 2) & (b == 3)), 0).otherwise(1).cast("long")


def _bytes(codes: pa.Scalar) -> bytes:
    return bytes(codes.as_py())


def _vectors(blocks: DataFrame) -> DataFrame:
    """(conv, begin, end, last, border) of the blocks of conversations with several: costs at each one's end."""

    def matrices(batches):
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            yield pa.RecordBatch.from_arrays([c["conv"], c["begin"], c["first_kind"], c["last_kind"], pa.array([matrix(_bytes(x)) for x in c["codes"]], pa.list_(pa.int64()))], names=["conv", "begin", "first_kind", "last_kind", "m"])

    def scan(batches):
        for b in batches:
            out = []
            for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, later = list(END), None
                for x in reversed(parts):
                    out.append((conv, x["begin"], v, later is None, 0 if later is None else int(not ((later == 2 and x["last_kind"] in (1, 3)) or (x["last_kind"] == 2 and later == 3)))))
                    v, later = through(x["m"], v), x["first_kind"]
            conv, begin, end, last, border = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.list_(pa.int64())), pa.array(last, pa.bool_()), pa.array(border, pa.int64())], names=["conv", "begin", "end", "last", "border"])

    several = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv")
    parts = blocks.select("conv", "begin", "codes", "first_kind", "last_kind").join(several, "conv").mapInArrow(matrices, "conv string, begin long, first_kind int, last_kind int, m array<long>")
    chains = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("begin", "first_kind", "last_kind", "m"))).alias("parts"))
    return chains.mapInArrow(scan, "conv string, begin long, end array<long>, last boolean, border long")


WALKED = "conv string, begin long, ats array<long>, codes array<tinyint>, exits array<int>, costs array<long>, audits array<string>"


def _walks(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    """Each block's walks: from the start state if it is its conversation's only one, else from all four."""

    def walk(batches):
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            exits, costs, audits = [], [], []
            for codes, end, last in zip(c["codes"], c["end"].to_pylist(), c["last"].to_pylist()):
                w = Walk(_bytes(codes), END if end is None else end, last is not False)
                found = [w.from_state(s) for s in (range(4) if end is not None else (0,))]
                for out, i in ((exits, 0), (costs, 1), (audits, 2)):
                    out.append([x[i] for x in found])
            yield pa.RecordBatch.from_arrays([c["conv"], c["begin"], c["ats"], c["codes"], pa.array(exits, pa.list_(pa.int32())), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=[x.split()[0] for x in WALKED.split(", ")])

    return blocks.select("conv", "begin", "ats", "codes").join(ends.select("conv", "begin", "end", "last"), ["conv", "begin"], "left").mapInArrow(walk, WALKED)


def _entries(walked: DataFrame) -> DataFrame:
    """(conv, begin, entry): the state in which a conversation's walk enters each of its blocks; the first begins with none."""
    step = lambda acc, x: F.struct(F.get(x["exits"], acc["state"]).alias("state"), F.array_append(acc["seen"], acc["state"]).alias("seen"))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("seen"))
    chains = walked.filter(F.size("exits") > 1).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("begin", "exits"))).alias("parts"))
    states = F.aggregate("parts", start, step, lambda acc: acc["seen"])
    return chains.select("conv", F.inline(F.arrays_zip(F.transform("parts", lambda x: x["begin"]).alias("begin"), states.alias("entry"))))


EDITS = "at long, edit string, new_role string, before array<string>, after array<string>"


def _edits(chosen: DataFrame) -> DataFrame:
    def spell(batches):
        for b in batches:
            ats, codes, entry, audit = (b.column(i) for i in range(4))
            out = [e for a, c, s, x in zip(ats.to_pylist(), codes, entry.to_pylist(), audit.to_pylist()) for e in edits_of(a, s, x, _bytes(c))]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in EDITS.split(", ")])

    return chosen.select("ats", "codes", "entry", "audit").mapInArrow(spell, EDITS)


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): what was found and done per conversation, and the repaired turns in order.

    conversations: conv (conv_name() of the id), gaps (turns missing between the least and the greatest),
    blank, duplicate, truncated (each turn's first fault), illegal (neighbours whose roles may not follow
    each other), cost, audit (edits' initials in order). turns: conv, at and k (which order them), edit,
    role, text; deleted turns are not there. A null conversation id is one conversation, null roles and
    texts are one space, null turns come first and count in no gap; turns of one number are in the order
    of role and text, repeated rows next to each other. An empty table gives two empty ones.
    """
    turns = arrange(rows, conv_col, turn_col, role_col, text_col)
    longest = turns.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    blocks = write_table(_blocks(_faults(turns), max(block, isqrt(longest) + 1)), "blocks")
    ends = write_table(_vectors(blocks), "vectors")
    walked = write_table(_walks(blocks, ends), "walks")
    entry = F.coalesce("entry", F.lit(0))
    chosen = walked.join(_entries(walked), ["conv", "begin"], "left").select("conv", "begin", "ats", "codes", entry.alias("entry"), F.get("audits", entry).alias("audit"), F.get("costs", entry).alias("cost"))
    chosen = write_table(chosen, "edits")
    drop_table(walked)
    counts = blocks.join(ends.select("conv", "begin", "border"), ["conv", "begin"], "left").withColumn("illegal", F.col("illegal") + F.coalesce("border", F.lit(0)))
    counts = counts.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    done = chosen.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    numbers = turns.filter("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    found = counts.join(done, "conv").join(numbers, "conv", "left").select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    kept = F.when(F.col("edit") != "D", F.array(F.struct(F.col("edit"), F.coalesce("new_role", "role").alias("role"), F.col("text")))).otherwise(F.array())
    added = lambda c: F.transform(c, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))
    repaired = turns.select("conv", "at", "role", "text").join(_edits(chosen), "at").select("conv", "at", F.posexplode(F.concat(added("before"), kept, added("after"))).alias("k", "t")).select("conv", "at", "k", "t.*")
    return found, repaired


def conv_name(conv):
    """The name of a conversation's id in repair_conversations(): c and the id; empty for a null one."""
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit(""))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired turns as role:text lines. A digest is of one sequence: its turns stream through one task, unkept."""

    def digest(batches):
        name, sha = None, None
        for b in batches:
            done = []
            for conv, line in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                if conv == name:
                    sha.update(b"\n" + line)
                    continue
                if sha:
                    done.append((name, sha.hexdigest()))
                name, sha = conv, hashlib.sha256(line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], names=["conv", "sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["conv", "sha256"])

    lines = repaired.select("conv", F.concat("role", F.lit(":"), "text").alias("line"), "at", "k").repartition("conv").sortWithinPartitions("conv", "at", "k")
    return lines.select("conv", "line").mapInArrow(digest, "conv string, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the turns' numbers: dropped, emptied, cut, repeated and wrongly attributed turns."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("fault"))
    rows = rows.filter("fault <> 0").withColumn("copies", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def repair_damaged(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The query's rows: per original conversation the counts, cost, audit and digest of its repair after damage()."""
    found, repaired = repair_conversations(damage(conversations), block=block)
    every = conversations.select("conv_id").distinct().withColumn("conv", conv_name(F.col("conv_id")))
    out = every.join(found, "conv", "left").join(digests(repaired), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
