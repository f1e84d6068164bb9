import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratagrid.llm import ppm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Trie:
    """PPM by the book: a dictionary of followers for each context."""

    def __init__(self, texts, order):
        self.order, self.next = order, defaultdict(Counter)
        for t in texts:
            s = bytes([255]) * order + t + bytes([255])
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.next[s[i - k : i]][s[i]] += 1

    def log10(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            c = {s: n for s, n in self.next.get(context[len(context) - k :], {}).items() if s not in excluded}
            if symbol in c:
                return out + math.log10((2 * c[symbol] - 1) / (2 * sum(c.values())))
            if c:
                out += math.log10(len(c) / (2 * sum(c.values())))
            excluded |= c.keys()
        return out - math.log10(max(1, 256 - len(self.next.get(b"", ()))))

    def text(self, t):
        s = bytes([255]) * self.order + t + bytes([255])
        return sum(self.log10(s[i - self.order : i], s[i]) for i in range(self.order, len(s)))


def brute(rows, order=5):
    texts = [lower(r["text"]).encode() for r in rows]
    train = [t for r, t in zip(rows, texts) if not held(r["doc_id"])]
    count = Counter()
    for t in train:
        count.update([*WORD.findall(t.decode()), None])
    n, v, trie = sum(count.values()), len(count), Trie(train, order)
    out = []
    for r, t in zip(rows, texts):
        tokens = [*WORD.findall(t.decode()), None]
        out.append((r["doc_id"], held(r["doc_id"]), len(tokens), sum(count[x] > 0 for x in tokens), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens), trie.text(t)))
    return sorted(out, key=str)


def same(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_scores(spark, docs, monkeypatch):
    some = docs.where("length(text) < 1500").coalesce(2)
    want = brute(some.collect())
    same(ppm.score(some).collect(), want)
    monkeypatch.setattr(ppm, "CHUNK", 3000)
    same(ppm.score(some, block_bytes=20_000).collect(), want)
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in some.collect()}
    assert sum(r[6] for r in want if r[1]) > -math.log10(16) * sum(size[r[0]] for r in want if r[1])  # below four bits a byte


def test_odd_rows(odd_docs, no_docs):
    few = odd_docs.where("doc_id is null or doc_id not in (6, 9, 10, 11)")
    same(ppm.score(few).collect(), brute(few.collect()))
    assert len(ppm.score(odd_docs).collect()) == odd_docs.count()
    assert ppm.score(no_docs).count() == 0
    only_held = odd_docs.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    same(ppm.score(only_held).collect(), brute(only_held.collect()))


def test_probabilities_sum_to_one():
    trie = Trie([b"abracadabra", b"abba"], 3)
    for context in (b"abr", b"zzz", b"\xffab"):
        assert math.isclose(sum(10 ** trie.log10(context, s) for s in range(256)), 1)


@pytest.mark.parametrize("limit", [1 << 27, 256])
def test_gram_ranks(monkeypatch, limit):
    monkeypatch.setattr(ppm, "_LARGEST_TABLE", limit)
    a = np.random.default_rng(1).integers(0, 7, 500).astype(np.uint8)
    keys, rank = ppm.gram_ranks(a, 3)
    want = [int.from_bytes(a[i : i + 4].tobytes(), "big") for i in range(497)]
    assert keys[rank].tolist() == want and sorted(set(want)) == keys.tolist()
