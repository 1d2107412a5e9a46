"""Conversation repair against a plain dynamic program over (cost, audit), whatever the blocks' size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from filingscope.llm import conversation_repair as C

TURNS = "conv_id long, turn long, role string, text string, at long, edit string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def expected(rows):
    groups = defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r[1:])
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            worded = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not worded else "duplicate" if (role, text) in seen else "truncated" if worded[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))

        @cache
        def best(i, state, added=0):
            """(cost, audit) from a turn on; state is what stands last of '', s, u, a."""
            options = [(0, "")] if i == len(own) and state in ("", "a") else []
            role = "a" if state == "u" else "u"
            if added < 2:
                cost, audit = best(i, role, added + 1)
                options.append((cost + 5, "I" + audit))
            if i < len(own):
                cost, audit = best(i + 1, state)
                options.append((cost + 2, "D" + audit))
                if faults[i] not in ("blank", "duplicate"):
                    cut, first = 5 * (faults[i] == "truncated"), own[i][1][:1]
                    if first == role or (first == "s" and state == ""):
                        cost, audit = best(i + 1, first)
                        options.append((cost + cut, "K" + audit))
                    cost, audit = best(i + 1, role)
                    options.append((cost + cut + 1, "R" + audit))
            return min(options, default=(10**9, ""))

        cost, audit = best(0, "")
        lines, state, i = [], "", 0
        for letter in audit:
            role = {"u": "user", "a": "assistant"}["a" if state == "u" else "u"]
            if letter == "I":
                lines.append(f"{role}:")
                state = role[0]
                continue
            if letter != "D":
                name = own[i][1] if letter == "K" else role
                lines.append(f"{name}:{own[i][2]}")
                state = name[0]
            i += 1
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=150):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), role, rng.choice(["Yes.", "no", "", " \t", "Well!", "So?", "é…", "End. \n", f"text {rng.randint(0, 9)}."])))
    for turn in range(60):  # longer than several blocks
        rows.append((n, turn, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"t {turn}."])))
    rows += [(n + 1, 5, "user", "Same.")] * 40 + [(n + 2, None, "user", "Q?"), (n + 2, None, None, None), (n + 2, 3, "assistant", "A.")]
    rows += [(None, 0, "user", "Q?"), (None, 1, "assistant", "A."), (None, None, "system", "S."), (n + 3, None, None, None)]
    return rows


def got(df):
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 3), (3, 1)])
def test_repairs_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(C, "isqrt", lambda n: 0 if n > 9 else max(1, n - 1))  # so that block alone says how long a block is
    rows = conversations(seed)
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], TURNS).repartition(4)
    assert got(C.repair_damaged(docs, block=block)) == expected(rows)


def test_walk_keeps_few_vectors_and_matrices_agree():
    rng = random.Random(5)
    for n in (1, 2, 3, 10, 50, 400):
        codes = bytes(rng.choice([0, 1, 2, 3, 2, 3, 6, 7, 10, 11]) for _ in range(n))
        v = list(C.END)
        for code in reversed(codes):
            v = C.before(code, v)
        assert C.through(C.matrix(codes), list(C.END)) == v
        walk = C.Walk(codes, C.END, True)
        assert len(walk.marks) <= 2 * int(n**0.5) + 3
        state, cost, audit = walk.from_state(0)
        assert state in (0, 3) and cost == v[0] and len(audit.replace("I", "")) == n


def test_no_rows_and_dropped_conversations(spark):
    assert got(C.repair_damaged(spark.createDataFrame([], TURNS))) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    rows = spark.createDataFrame([(gone, 0, "user", "Q?")], "conv_id long, turn long, role string, text string")
    assert got(C.repair_damaged(rows)) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]


def test_one_conversation_of_many_turns_is_several_blocks(spark):
    """A hot conversation: its turns are dealt to blocks of bounded size, and its texts to several tasks."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * (200_000 if i == 77 else 5) + f" turn {i}.") for i in range(5000)]
    docs = spark.createDataFrame([r + (0, "") for r in rows], TURNS).repartition(4)
    turns = C.arrange(docs, "conv_id", "turn", "role", "text")
    blocks = C._blocks(C._faults(turns), 100)
    assert blocks.count() >= 50 and max(len(r.ats) for r in blocks.collect()) <= 100
    found, repaired = C.repair_conversations(docs, block=100)
    assert found.first().audit == "K" * 5000 and repaired.count() == 5000
