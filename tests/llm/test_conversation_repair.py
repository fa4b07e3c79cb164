"""Conversation repair against an enumeration of all edits, and on edge cases."""

import hashlib
import random
import re
import zlib

from seqloom.llm.conversation_repair import repair_conversations, repair_digests
from seqloom.llm.queries import damaged_conversations, op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def all_repairs(rows, faults):
    """(cost, audit, repaired) of every way of editing, with up to two insertions in a row."""
    n = len(rows)

    def go(i, initials, inserted):
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if i == n and re.fullmatch(r"(s?(ua)+)?", initials):
            yield 0, "", []
        if inserted < 2:
            for role in ("user", "assistant"):
                for c, a, r in go(i, initials + role[0], inserted + 1):
                    yield c + 2, "I" + a, [(role, ""), *r]
        if i < n:
            role, text = rows[i]
            for c, a, r in go(i + 1, initials, 0):
                yield c + 3, "D" + a, r
            if faults[i] in (0, 3):
                extra = faults[i] == 3
                if role:
                    for c, a, r in go(i + 1, initials + role[0], 0):
                        yield c + extra, "K" + a, [(role, text), *r]
                for new in ("user", "assistant"):
                    for c, a, r in go(i + 1, initials + new[0], 0):
                        yield c + 2 + extra, "R" + a, [(new, text), *r]

    return go(0, "", 0)


def expected(rows):
    """rows: (turn, role, text) of one conversation, nulls replaced, in order."""
    said = [(r, t) for _, r, t in rows]
    faults = faults_of(said)
    cost, audit, repaired = min(all_repairs(said, faults))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha


def got_of(df):
    return {r[0]: tuple(r[1:]) for r in repair_digests(repair_conversations(df)).collect()}


def test_all_edits_of_random_conversations(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for conv in range(250):
        own = []
        for _ in range(rng.randint(1, 4)):
            turn = rng.choice([None, *range(6)])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            text = rng.choice(["A.", "B?", "cut", "", " \n", None, "C!", "x. "])
            own.append((turn, role, text))
        rows += [(conv, *r) for r in own]
        filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in own]
        want[conv] = expected(sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
    rng.shuffle(rows)
    assert got_of(spark.createDataFrame(rows, SCHEMA).repartition(7)) == want


def test_long_conversation_crosses_batches(spark):
    """30,000 rows of one conversation; a repeat far from its original; one row in a thousand has the wrong role."""
    n = 30_000
    rows = [(1, k, "user" if (k % 2 == 0) != (k % 1000 == 999) else "assistant", f"said {k}.") for k in range(n)]
    rows.append((1, n + 5, "user", "said 0."))
    got = got_of(spark.createDataFrame(rows, SCHEMA).repartition(5))[1]
    assert got[:6] == (5, 0, 1, 0, 31 + 29, 30 * 2 + 3)
    assert got[6].count("R") == 30 and got[6].count("K") == n - 30 and got[6].endswith("D") and len(got[6]) == n + 1
    text = "\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:said {k}." for k in range(n))
    assert got[7] == hashlib.sha256(text.encode()).hexdigest()


def test_edge_cases(spark):
    huge = "y" * 3_000_000
    rows = [
        (None, None, None, None), (None, 1, "user", "a."), (2, 1, "user", huge), (2, 2, "assistant", huge), (3, 9, "system", "s."),
        (4, -(1 << 63), "user", "a."), (4, (1 << 63) - 1, "assistant", "b."), (5, 0, "assistant", "same."), (5, 0, "assistant", "same."),
    ]
    df = spark.createDataFrame(
        [(*r, 7, "x", None) for r in rows], SCHEMA + ", left long, edit string, fault int"
    )
    got = got_of(df)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[None] == (0, 1, 0, 0, 1, 5, "DKI", sha("user:a.\nassistant:"))
    assert got[2] == (0, 0, 0, 2, 0, 2, "KK", sha(f"user:{huge}\nassistant:{huge}"))
    assert got[3] == (0, 0, 0, 0, 0, 3, "D", sha(""))
    assert got[4][0] == (1 << 63) - 1 and got[4][6] == "KK"
    assert got[5] == (0, 0, 1, 0, 1, 5, "IKD", sha("user:\nassistant:same."))
    assert repair_conversations(df.limit(0)).count() == 0 and got_of(df.limit(0)) == {}


def test_edits_are_rows(spark):
    df = spark.createDataFrame([(1, 3, "assistant", "late."), (1, 1, "system", "s."), (1, 2, "bot", "cut")], SCHEMA)
    edits = repair_conversations(df).orderBy("position").collect()
    assert [(e.edit, e.turn, e.fault, e.role, e.text) for e in edits] == [
        ("K", 1, 0, "system", "s."), ("R", 2, 3, "user", "cut"), ("K", 3, 0, "assistant", "late."),
    ]
    assert [e.last for e in edits] == [False, False, True] and edits[-1].report.cost == 3


def test_query_keeps_conversations_that_lost_all_rows(spark, tmp_path):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    kept = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    rows = [(lost, 0, "user", "a."), (kept, 0, "user", "a.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[kept][5:7] == (2, "KI")


def test_damage(spark):
    rows = [(k, 0, "assistant", "a.b!c?") for k in range(200)] + [(None, None, None, None)]
    got = {}
    for r in damaged_conversations(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    what = {0: None, 1: [("assistant", "")], 2: [("assistant", "abc")], 3: [("assistant", "a.b!c?")] * 2, 4: [("user", "a.b!c?")]}
    for k in range(200):
        assert got.get(k) == what.get(zlib.crc32(f"{k}:0".encode()) % 20, [("assistant", "a.b!c?")])
    assert zlib.crc32(b" : ") % 20 > 4 and got[None] == [(" ", " ")]
