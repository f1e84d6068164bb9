import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from stratagrid.llm import turn_repair
from stratagrid.llm.turn_repair import damaged, repair

GRAMMAR = re.compile("(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string, batch string, segment int, seen int, copy string"
SIGN = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        signs = SIGN.findall(text)
        out.append("blank" if not signs else "duplicate" if (role, text) in seen else "none" if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows):
    """The cheapest audit of all: every edit of every turn, every insertion, every role."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults(rows), strict=True)):
            continue
        price = sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (f == "truncated" and e != "D") for e, f in zip(edits, faults(rows), strict=True))
        for put in itertools.product(range(3), repeat=len(rows) + 1):
            cost = price + 5 * sum(put)
            audit = "".join("I" * n + e for n, e in zip(put, [*edits, ""], strict=True))
            if best is None or (cost, audit) < best[:2]:
                free = "".join("." * n + {"K": r[0][:1] or "-", "R": ".", "D": ""}[e] for n, e, r in zip(put, [*edits, "D"], [*rows, ("", "")], strict=True))
                for roles in itertools.product("ua", repeat=free.count(".")):
                    filled = iter(roles)
                    if GRAMMAR.fullmatch(found := "".join(next(filled) if c == "." else c for c in free)):
                        best = (cost, audit, found)
    cost, audit, found = best
    lines, k, names = [], 0, {"u": "user", "a": "assistant"}
    shown = iter(found)
    for e in audit:
        role, text = rows[k] if e != "I" else ("", "")
        k += e != "I"
        if e != "D":
            c = next(shown)
            lines.append(f"{role if e == 'K' else names[c]}:{text}")
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain(rows):
    """The same for any length, from the last turn to the first."""
    best = {"0": (0, "", []), "s": (10, "II", ["user:", "assistant:"]), "u": (5, "I", ["assistant:"]), "a": (0, "", [])}
    for (role, text), f in reversed(list(zip(rows, faults(rows), strict=True))):
        direct = {}
        for s in "0sua":
            options = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
            if f not in ("blank", "duplicate"):
                more, to = 5 * (f == "truncated"), "a" if s == "u" else "u"
                if role[:1] == to or (role[:1], s) == ("s", "0"):
                    after = best[role[0]]
                    options.append((after[0] + more, "K" + after[1], [f"{role}:{text}", *after[2]]))
                options.append((best[to][0] + 1 + more, "R" + best[to][1], [f"{'user' if to == 'u' else 'assistant'}:{text}", *best[to][2]]))
            direct[s] = min(options, key=lambda o: o[:2])
        best = {}
        for s in "0sua":
            options, at, put = [direct[s]], s, []
            for n in (1, 2):
                at = "a" if at == "u" else "u"
                put = [*put, "assistant:" if at == "a" else "user:"]
                options.append((direct[at][0] + 5 * n, "I" * n + direct[at][1], put + direct[at][2]))
            best[s] = min(options, key=lambda o: o[:2])
    cost, audit, lines = best["0"]
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def made(rng, n):
    return [(rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", "seer", "under"]), rng.choice(["", " \n", "Yes.", "No", "Why?", "So!", "A. B.\n", "end", f"t{rng.random()}.", f"t{rng.random()}"])) for _ in range(n)]


def table(spark, conversations):
    rows = [(c, k, role, text, "x", 1, 2, "y") for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, TURNS)


def test_against_every_repair(spark):
    rng = random.Random(5)
    conversations = {c: made(rng, 1 + c % 4) for c in range(160)}
    got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in repair(table(spark, conversations)).collect()}
    for c, turns in conversations.items():
        assert got[c] == every_repair(turns) == plain(turns), turns


@pytest.mark.parametrize("span", [3, 256])
def test_long_conversations(spark, monkeypatch, span):
    """In segments and whole, all turns in one conversation or in many."""
    monkeypatch.setattr(turn_repair, "SPAN", span)
    monkeypatch.setattr(turn_repair, "BATCH", 20_000)
    rng = random.Random(6)
    conversations = {c: made(rng, rng.choice([1, 2, 3, 4, 7, 30, 300])) for c in range(60)} | {None: made(rng, 700), 99: [("user", " ")] * 20}
    rows = {r.conv_id: r for r in repair(table(spark, conversations)).collect()}
    assert len(rows) == len(conversations)
    for c, turns in conversations.items():
        r, named = rows[c], faults(turns)
        assert (r.cost, r.audit, r.repaired_sha256) == plain(turns)
        assert (r.gaps, r.blank, r.duplicate, r.truncated) == (0, *(named.count(f) for f in ("blank", "duplicate", "truncated")))
        assert r.illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, 3, "assistant", "Yes."), (1, 7, "user", "So?"), (1, 7, "assistant", "Yes!"),
            (2, None, "user", "x" * 300_000), (3, -5, "system", "S."), (3, 10**12, "assistant", "A."), (None, 1, "user", "Q?"), (None, 1, "user", "Q?")]
    turns = spark.createDataFrame([(*r, None, None, None, None) for r in rows], TURNS)
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (None,)], "conv_id long")
    got = {r.conv_id: tuple(r)[1:8] for r in repair(turns, ids).collect()}
    assert got == {1: (3, 1, 0, 0, 2, 4, "DKKRR"), 2: (0, 0, 0, 1, 0, 2, "D"), 3: (10**12 + 4, 0, 0, 0, 1, 1, "RK"),
                   None: (0, 0, 1, 0, 1, 4, "DD"), 4: (0, 0, 0, 0, 0, 0, "")}
    assert repair(turns.limit(0)).collect() == []


def test_damage(spark):
    made_rows = spark.range(400).select((F.col("id") % 7).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("A. b!").alias("text"), F.lit(1).alias("fault"))
    from zlib import crc32

    want = []
    for r in made_rows.collect():
        k = crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if k:
            row = (r.conv_id, r.turn, "user" if k == 4 else r.role, "" if k == 1 else "A b" if k == 2 else r.text)
            want += [row] * (2 if k == 3 else 1)
    assert sorted(tuple(r) for r in damaged(made_rows).collect()) == sorted(want)
    nulls = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    k = crc32(b" : ") % 20
    assert damaged(nulls).count() == (0 if not k else 2 if k == 3 else 1)
