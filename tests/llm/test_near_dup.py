import random
import re

import numpy as np
import pytest

from stratagrid.llm import near_dup
from stratagrid.llm.near_dup import Sketcher, WordHashes, components, link, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent=80):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            low[root(i)] = min(low.get(root(i), r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], len(s), low.get(root(i)), r["doc_id"] == low.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [2, 5])
def test_link(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(docs.collect(), size)
    assert got(link(docs, size=size)) == want
    assert any(not r[3] for r in want)


def test_large_group(spark, monkeypatch):
    """A group whose members differ from one another by about a fifth, with strays at the limit."""
    random.seed(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(random.choice((1, 2, 3, 4, 5, 6))):
            w[random.randrange(60)] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(df.collect(), 2)
    assert got(link(df, size=2)) == want
    monkeypatch.setattr(near_dup, "BLOCK", 400)
    assert got(link(df, size=2, classes=1)) == want


@pytest.mark.parametrize("members", [2, 3])
def test_few_sets_larger_than_a_block(spark, monkeypatch, members):
    """Sets that share buckets but no link, each larger than a block; many groups, so that some deal leaves a side empty."""
    monkeypatch.setattr(near_dup, "BLOCK", 50)
    rows = []
    for g in range(24):
        shared = [f"g{g}w{k}" for k in range(160)]
        for m in range(members):
            rows.append((g * 10 + m, " ".join(shared + [f"g{g}m{m}x{k}" for k in range(30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(link(df, size=2)) == brute(df.collect(), 2)


def test_odd_rows(odd_docs, no_docs):
    assert got(link(odd_docs, size=2)) == brute(odd_docs.collect(), 2)
    assert link(no_docs).count() == 0


def test_sketch_finds_similar_sets():
    rng, sketcher, missed = np.random.default_rng(0), Sketcher(2, 3, 6), 0
    for _ in range(400):
        u = rng.integers(0, 2**63, 360, dtype=np.uint64)
        a, b = (sketcher.halves(np.sort(x)).reshape(6, 2, 3) for x in (u[:324], u[36:]))  # similarity 0.8
        missed += not any((a[t, 0] == b[t, 0]).any() and (a[t, 1] == b[t, 1]).any() for t in range(6))
    assert missed == 0


def test_shingles():
    memo = WordHashes()
    assert len(shingles("a b c a b", 2, memo)) == 3 and len(shingles("A", 2, memo)) == 1 and not len(shingles(" ", 2, memo))
    assert (shingles("A b", 2, memo) == shingles("a\tB", 2, memo)).all()


def test_components(spark):
    chain = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40) if i != 20], "a binary, b binary")
    found = {bytes(r["node"]): bytes(r["comp"]) for r in components(chain).collect()}
    assert all(c == (bytes([0]) if n <= bytes([20]) else bytes([21])) for n, c in found.items()) and len(found) == 41
