import hashlib
import random
import re

import numpy as np
import pytest

from stratagrid.llm import block_names, periodic_runs
from stratagrid.llm.block_names import deduplicate, identities
from stratagrid.llm.periodic_runs import find, lag_counts, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """All maximal runs by trying every stretch."""
    out = []
    for s in range(len(w)):
        for e in range(s + 24, len(w) + 1):
            for q in range(1, (e - s) // 3 + 1):
                if all(w[i] == w[i + q] for i in range(s, e - q)):
                    if not (s and w[s - 1] == w[s - 1 + q]) and not (e < len(w) and w[e] == w[e - q]):
                        out.append((s, e - s, q))
                    break
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_every_stretch():
    rng, seen = random.Random(3), 0
    for _ in range(80):
        w = []
        while len(w) < rng.randint(0, 80):
            period = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.choice([1, 2, 3, 4, 7, 12]))]
            w += (period * 30)[: rng.randint(1, 60)] + [rng.randint(0, 5) for _ in range(rng.choice([0, 0, 5]))]
        a = np.array(w[:100], dtype=np.int64)
        want = brute_runs(a.tolist())
        seen += len(want)
        assert runs(a, lag_counts([a])[0]) == want
    assert seen > 50


def test_lag_counts_frequent_and_rare():
    rng = np.random.default_rng(0)
    long = np.concatenate([np.zeros(3000, int), rng.integers(0, 40, 20_000), np.tile([1, 2], 4000), rng.integers(100, 9000, 3000)])
    texts = [np.zeros(0, int), long, np.array([5, 5, 5, 6]), rng.integers(0, 3, 500)]
    for t, counts in zip(texts, lag_counts(texts), strict=True):
        assert len(counts) == len(t) // 3 + 1
        for q in {1, 2, 7, 100, len(t) // 3} & set(range(1, len(counts))):
            assert counts[q] == (t[q:] == t[:-q]).sum()
    assert runs(long, lag_counts([long])[0]) == [(0, 3000, 1), (23_000, 8000, 2)]


def test_long_island_on_the_grid():
    rng = np.random.default_rng(1)
    t = np.concatenate([rng.integers(0, 500, 20_000), np.tile(rng.integers(0, 10**6, 700), 4)[:2100], rng.integers(0, 500, 9000)])
    found = runs(t, lag_counts([t])[0])
    assert [(n >= 2100, q) for _, n, q in found] == [(True, 700)] and periodic_runs.kept_words(len(t), found).sum() == len(t) - found[0][1] + 700


def test_find_odd_rows(spark, odd_docs, no_docs):
    rows = find(odd_docs).collect()
    assert len(rows) == odd_docs.count() and find(no_docs).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_runs, by[1].start, by[1].runs_sha256, by[1].collapsed_sha256) == (0, None, empty, empty)
    assert tuple(by[6])[:6] == (6, 1, 0, 90_000, 3, 30_000_000) and by[6].collapsed_sha256 == hashlib.sha256(b"one two three").hexdigest()
    assert len([r for r in rows if r.doc_id == 7]) == 2 and len([r for r in rows if r.doc_id is None]) == 2
    assert find(odd_docs).columns == find(no_docs).columns


def test_ties_and_planting(spark):
    text = " ".join(["a b"] * 12 + ["z"] + ["c d"] * 12 + ["y"] + ["e"] * 24)
    docs = spark.createDataFrame([(k, text) for k in range(200)] + [(None, text)], "doc_id long, text string")
    one = find(docs).where("doc_id = 0").first()
    assert (one.n_runs, one.start, one.length, one.period) == (3, 50, 24, 1)
    planted = find(docs, plant=True).collect()
    assert 5 < sum(tuple(r)[1:] != tuple(one)[1:] for r in planted) < 50
    assert next(tuple(r)[1:] for r in planted if r.doc_id is None) == tuple(one)[1:]


def brute_copies(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""), []).append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is not None, x))
        out += [(i, ids[-1], len(ids), k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, bits", [(2048, 128), (7, 128), (7, 3), (64, 0)])
def test_copies(spark, odd_docs, no_docs, block, bits):
    """Small blocks make many levels; few bits of digest make different blocks clash, so they are named anew."""
    docs = odd_docs if block > 7 else odd_docs.where("length(text) < 2000 or text is null")
    assert sorted((tuple(r) for r in deduplicate(docs, block, bits).collect()), key=str) == brute_copies(docs.collect())
    assert deduplicate(no_docs, block, bits).collect() == []


def test_names_tell_orders_apart(spark):
    """The same blocks in other orders and counts are other texts; upper case outside A-Z counts."""
    a, b = "a" * 8, "b" * 8
    texts = [a + b, b + a, a + b + a, a + b + a + b, a + b + a + b + a, a * 2, a * 3, a * 4, a, "", "É", "é", (a + b).upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = identities(docs, block=8).collect()
    assert len({(r.n_blocks, r.name) for r in found}) == len(texts) - 1
    assert {r.keep_id for r in deduplicate(docs, block=8).where("doc_id in (0, 12)").collect()} == {12}


def test_one_text_in_a_third_of_the_rows(spark):
    texts = ["common text " * 400 if k % 3 == 0 else f"text {k} " * (k % 700) for k in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((tuple(r) for r in deduplicate(docs).collect()), key=str) == brute_copies(docs.collect())


def test_blocks_of_a_text():
    assert block_names._blocks(b"", 4) == [b""] and block_names._blocks(b"abcdefgh", 4) == [b"abcd", b"efgh"] and block_names._blocks(b"abcde", 4) == [b"abcd", b"e"]
