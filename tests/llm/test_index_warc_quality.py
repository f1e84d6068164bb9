import hashlib
import re
import zlib

import numpy as np
import pytest

from stratagrid.llm import positional_index, warc_store
from stratagrid.llm.nbsvm import BITS, BUCKETS, FAMILIES, WordMemo, classify, descend, features, fit, ratios, shape, train
from stratagrid.llm.positional_index import Phrases, build_index, contamination, search, words
from stratagrid.llm.warc_store import read_archive, records, write_archive

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_contamination(docs, items, size=10):
    windows = {}
    for i in items:
        w = WORD.findall(lower(i["text"]))
        for k in range(max(0, len(w) - size) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i["item_id"]) if i["item_id"] is not None else "")
    sizes = {len(w) for w in windows}
    out = []
    for d in docs:
        w = WORD.findall(lower(d["text"]))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((d["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.drop("items", "spans").collect()), key=str)


def test_contamination(spark, docs, odd_docs, no_docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute_contamination(docs.collect(), items.collect())
    assert rows(contamination(docs, items)) == want and any(w[-1] for w in want)
    assert rows(contamination(docs, items, block_bytes=2000)) == want
    odd = spark.createDataFrame([(None, "word"), (1, None), (2, " ! "), (3, "again and"), (3, "again and"), (4, "TIE"), (5, "one two three " * 9), (6, "日本")], "item_id long, text string")
    assert rows(contamination(odd_docs, odd)) == brute_contamination(odd_docs.collect(), odd.collect())
    assert contamination(no_docs, items).count() == 0
    assert not any(r["contaminated"] for r in contamination(docs, items.limit(0)).collect())


def test_blocks_agree_whatever_the_batches(spark):
    """Many documents a partition: the blocks' indexes have other shards each, and a session starts with large ones."""
    rows_of = [(i if i % 7 else None, f"start {i} " + " ".join(f"w{i % 60}x{j}" for j in range(14))) for i in range(400)]
    many = spark.createDataFrame(rows_of, "doc_id long, text string").coalesce(2)
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(2, 13))) for k in range(0, 60, 3)], "item_id long, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        got = rows(contamination(many, items, block_bytes=200))
    finally:
        spark.conf.set(key, before)
    assert got == brute_contamination(many.collect(), items.collect()) and any(r[-1] for r in got)


def test_one_index_answers_any_phrase(spark, docs, monkeypatch):
    """Phrases that no benchmark holds, among them single words and whole documents; also a few places at a time."""
    texts = {r["doc_id"]: words(r["text"] or "") for r in docs.collect()}
    index = build_index(docs)
    asked = [t[k : k + n] for t in list(texts.values())[:40] for k, n in ((0, 1), (3, 2), (1, 7), (0, len(t))) if len(t) >= k + n > k] + [[b"nowhere"]]
    phrases = Phrases.windows(((str(i), b" ".join(a).decode()) for i, a in enumerate(asked)), None)
    for together in (1 << 20, 50):
        monkeypatch.setattr(positional_index, "TOGETHER", together)
        for r in search(index, phrases).collect():
            t = texts[r["doc_id"]]
            at = {i: {k for k in range(len(t) - len(a) + 1) if t[k : k + len(a)] == a} for i, a in enumerate(asked)}
            assert r["items"] == sorted(str(i) for i, k in at.items() if k)
            hit = {k + j for i, found in at.items() for k in found for j in range(len(asked[i]))}
            assert {k for a, b in zip(r["spans"][::2], r["spans"][1::2]) for k in range(a, b)} == hit


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha x x x x beta"), (4, "alpha"), (5, "beta")], "doc_id long, text string")
    index = build_index(docs)
    found = search(index, Phrases.windows([("q", "alpha beta")], None), slop=3)
    assert {r["doc_id"] for r in found.collect() if r["items"]} == {1, 2}


@pytest.mark.parametrize("hot", [warc_store.HOT, 4, 1])
def test_archive(spark, sf_dir, monkeypatch, hot):
    """With all addresses hot, some, and none."""
    monkeypatch.setattr(warc_store, "HOT", hot)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    a = "a" * 1200
    extra = spark.createDataFrame(
        [(900, "u1", a, 1), (901, "u2\r\nX: y", a, 1), (902, None, a, 1), (903, "s", "short", 1), (904, "s", "short", 1), (905, "n", None, 1), (None, "z", a, 1), (906, "é", "ü" * 500, 1), (907, "é", "ü" * 500, 1), (906, "é", "ü" * 500, 1)],
        "page_id long, url string, html string, n int")
    for df in (pages, extra, extra.limit(0), pages.unionByName(extra.drop("n"))):
        source = df.collect()
        archive = write_archive(df)
        largest = {}
        for r in source:
            b = (r["html"] or "").encode()
            largest[b] = max(largest.get(b, -1), -1 if r["page_id"] is None else r["page_id"])
        want = []
        for r in source:
            b = (r["html"] or "").encode()
            again = len(b) >= 1000 and r["page_id"] != largest[b]
            want.append((r["page_id"], len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", largest[b] if again else None))
        assert sorted(map(tuple, read_archive(archive).collect()), key=str) == sorted(want, key=str)
        assert archive.payloads.count() == len(largest)
        made = [bytes(r["record"]) for r in records(archive).collect()]
        assert len(made) == len(source)
        for m in made:
            head, _, rest = m.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[n:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")


def test_quality(spark, docs, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    more, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train(more, labels)
    out = classify(more, model).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held) and len(held) > 40
    assert classify(odd_docs, model).count() == odd_docs.count() and classify(no_docs, model).count() == 0
    nothing = train(no_docs, labels)
    assert {r["score"] for r in classify(odd_docs, nothing).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert train(docs, nulls).slope == 0


def test_each_family_tells_quality(spark):
    """Held-out accuracy of each kind of gram alone and of all together, on the largest tables."""
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    labelled = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    right = {}
    for families in [(f,) for f in FAMILIES] + [FAMILIES]:
        model = train(labelled, spark.read.parquet(f"{sf}/labels.parquet"), families=families)
        held = [r for r in classify(labelled, model).collect() if r["held_out"]]
        right[families] = sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)
    assert right[FAMILIES] >= 0.99 and min(right.values()) >= 0.94


def plain_grams(text):
    """The indicators of a text as (family, gram), without hashing."""
    words = text.split()
    low = [w.lower() for w in words]
    shapes = [shape(w) | (k > 0 and words[k - 1] == w) << 6 for k, w in enumerate(words)]
    raw = text.lower().encode()
    runs = lambda x, n: {(n, tuple(x[i : i + n])) for i in range(len(x) - n + 1)}
    return {("words", *g) for n in (1, 2) for g in runs(low, n)} | {("characters", *g) for g in runs(raw, 4)} | {("shapes", *g) for n in (1, 2, 3) for g in runs(shapes, n)}


def test_features_are_the_grams_of_whole_texts():
    texts = ["Aa bb bb", "", "x", "the cat, THE cat ### ran 12 ran", "un deux " * 300 + "END!", "abc"]
    doc, bucket = features(texts, WordMemo())
    bucket_of = {}
    for k, t in enumerate(texts):
        own = bucket[doc == k]
        assert len(set(own.tolist())) == len(own)
        grams = plain_grams(t)
        for f, family in enumerate(FAMILIES):  # equal up to the few grams that share a bucket
            n = sum(g[0] == family for g in grams)
            assert 0 <= n - int((own >> BITS == f).sum()) <= 1
        bucket_of[k] = set(own.tolist())
    assert doc.tolist() == sorted(doc.tolist()) and bucket.max() < BUCKETS
    again = features(texts[::-1], WordMemo())
    assert set(again[1][again[0] == 2].tolist()) == bucket_of[3]  # whatever stands beside a text
    part = features([texts[4]], WordMemo(), ("words",))[1]
    assert set(part.tolist()) == {b for b in bucket_of[4] if b >> BITS == 0}


def test_ratios_are_log_shares():
    rows = [np.array([1, 5, 1 << BITS]), np.array([1, 7]), np.array([5, (1 << BITS) + 3])]
    got = ratios(rows, [1, 1, 0])
    size = 1 << BITS
    share = lambda n, total: (n + 1) / (total + size)
    want = {1: share(2, 4) / share(0, 1), 5: share(1, 4) / share(1, 1), 7: share(1, 4) / share(0, 1), size: share(1, 1) / share(0, 1), size + 3: share(0, 1) / share(1, 1)}
    assert all(np.isclose(got[b], np.log(v)) for b, v in want.items())


def test_dual_solution_is_optimal():
    """The dual objective meets the primal one, and every coordinate keeps its condition."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, 15)) for _ in range(120)]
    values = [rng.normal(size=len(r)) for r in rows]
    y = np.where(rng.random(120) < 0.4, 1.0, -1.0)
    most = np.where(y > 0, 0.7, 0.4)
    alpha, w, b = descend(rows, values, y, most, epochs=3000)
    assert (alpha >= 0).all() and (alpha <= most).all()
    x = np.zeros((120, BUCKETS + 1 if BUCKETS < 100 else 61))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, 60] = v, 1.0
    full = np.append(w[:60], b)
    assert np.allclose(full, (alpha * y) @ x)
    slack = np.maximum(0, 1 - y * (x @ full))
    primal, dual = 0.5 * full @ full + most @ slack, alpha.sum() - 0.5 * full @ full
    assert abs(primal - dual) <= 2e-2 * primal


def test_fit_separates():
    rng = np.random.default_rng(0)
    sets = [np.unique(np.append(rng.integers(10, 200, 20), 1 if i % 2 else 2)) for i in range(200)]
    model = fit(sets, np.arange(200) % 2)
    z = np.asarray([model.weights[r].sum() / np.sqrt(len(r)) + model.bias for r in sets])
    assert ((z > 0) == (np.arange(200) % 2 == 1)).all()
    assert shape("WORD!!") != shape("word")
