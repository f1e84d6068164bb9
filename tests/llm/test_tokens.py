import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from stratagrid.llm.encoding import default_tokenizer, encoder
from stratagrid.llm.packing import pack_documents, patterns, plan
from stratagrid.llm.token_file import Segment, bits_for, pack, read_segments, segment, unpack, write_segments


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_equals_the_library(tok):
    random.seed(3)
    signs = [" ", " ", "  ", "\n", "\t", "a", "bc", "é", "1", "!", "|", "'s", "\r", "\x1c", "\x85", "日本", "<|endoftext|>", "　", "̀"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 14))) for _ in range(3000)]
    got = encoder(default_tokenizer()).encode(texts)
    want = [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert got == want


@pytest.mark.parametrize("bits", range(1, 33))
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype("<u4")
    assert (unpack(pack(ids, bits), 1003, bits) == ids).all()
    assert len(pack(ids, bits)) == -(-1003 * bits // 8)


def test_segment_random_access():
    s = Segment(segment([5, None, 7], [np.arange(9000, dtype="<u4").tobytes(), b"", np.arange(77, dtype="<u4").tobytes()], 17, 1000))
    assert s.doc_ids == [5, None, 7] and len(s.document(1)) == 0
    for a, b in ((0, 1), (998, 1003), (4090, 4100), (8999, 9077), (-3, 10**6)):
        want = np.concatenate([np.arange(9000), np.arange(77)])[max(a, 0) : b]
        assert (s.tokens(a, b) == want).all()
    assert bits_for(50257) == 16 and bits_for(1) == 1
    with pytest.raises(ValueError):
        segment([1], [np.asarray([8], "<u4").tobytes()], 3)


def check_file(rows, source, tok):
    start, want = 0, []
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")
    for r in sorted(source, key=key):
        ids = ids_of(tok, r["text"])
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_file_round_trip(docs, tok):
    segments = write_segments(docs, partition_bytes=100_000, segment_tokens=20_000)
    assert segments.count() > 3
    check_file(read_segments(segments).collect(), docs.collect(), tok)


def test_token_file_odd_rows(odd_docs, no_docs, tok):
    check_file(read_segments(write_segments(odd_docs)).collect(), odd_docs.collect(), tok)
    assert read_segments(write_segments(no_docs)).count() == 0


def check_packing(rows, source, tok, limit):
    want = []
    for r in source:
        ids = ids_of(tok, r["text"])
        first = len(ids) % limit or limit
        cuts = [0, *range(first, len(ids) + 1, limit)]
        want += [(r["doc_id"], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= limit
    return len(by), -(-sum(r["length"] for r in rows) // limit)


def test_packing(docs, odd_docs, no_docs, tok):
    n, least = check_packing(pack_documents(docs).collect(), docs.collect(), tok, 1024)
    assert n <= 1.02 * least + 1
    check_packing(pack_documents(odd_docs, limit=64).collect(), odd_docs.collect(), tok, 64)
    assert pack_documents(no_docs).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    hist = np.zeros(129, np.int64)
    for x in rng.integers(1, 129, 5000):
        hist[x] += 1
    out = plan(hist, 128)
    got = np.zeros(129, np.int64)
    for lengths, n in out:
        assert sum(lengths) <= 128
        for v in lengths:
            got[v] += n
    assert (got == hist).all()
    assert sum(n for _, n in out) <= 1.01 * -(-int(hist @ np.arange(129)) // 128)
    assert (patterns(128).sum(axis=1) == 128).all()
    assert plan(np.zeros(129, np.int64), 128) == []
