"""Each stage of the pipeline against a brute-force version over what its predecessor kept."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stratagrid.llm.common import table, written
from stratagrid.llm.nbsvm import classify, train

from .test_index_warc_quality import brute_contamination
from .test_near_dup import brute
from .test_rules_pii import brute_spans
from .test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def test_stages(spark, tok):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        docs = written(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns

    scored = classify(table(spark, SF, "documents"), train(table(spark, SF, "documents"), table(spark, SF, "labels")))
    assert {r["doc_id"] for r in kept["quality"].collect()} == {r["doc_id"] for r in scored.collect() if r["predicted"]}

    groups = brute(inputs["near_duplicates"], 5)
    assert {r["doc_id"] for r in kept["near_duplicates"].collect()} == {r[0] for r in groups if r[3]}
    assert len(groups) > kept["near_duplicates"].count()

    items = table(spark, SF, "benchmark").collect()
    hit = brute_contamination(inputs["decontamination"], items)
    assert {r["doc_id"] for r in kept["decontamination"].collect()} == {r[0] for r in hit if not r[-1]}

    before = {r["doc_id"]: r for r in inputs["personal_data"]}
    for r in kept["personal_data"].collect():
        assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not re.search("[0-9@]", before[r["doc_id"]]["text"]):
            assert r == before[r["doc_id"]]
    n, least = check_packing(kept["packing"].collect(), inputs["packing"], tok, 1024)
    assert n <= 1.02 * least + 1


def test_rows_are_dropped_not_ids(spark):
    """Null and repeated ids that hold different texts: only the rows that are copies or contaminated go."""
    say = lambda w, n=40: " ".join(f"{w}{k}" for k in range(n))
    leak = " ".join(table(spark, SF, "benchmark").where("length(text) > 200").first()["text"].split()[:14])
    rows = [
        (1, say("a"), "x"), (2, say("a"), "x"), (2, say("b"), "x"), (2, say("c"), "x"), (None, say("a", 39), "x"), (None, say("d"), "x"), (None, None, "x"),
        (None, say("e"), "x"), (None, say("e", 39), "x"),  # linked, both without an id
        (3, say("f"), "x"), (3, say("f", 39), "x"), (4, say("f"), "x"),  # linked, two with the smallest id
        (5, say("g"), "x"), (5, say("g"), "y"), (5, "", "x"), (5, "", "y"),  # equal rows, one with a text
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    one = lambda i, w: sum(g in ((i, say(w)), (i, say(w, 39))) for g in got) == 1
    assert one(None, "e") and one(3, "f") and one(5, "g") and len(got) == 10
    assert {(1, say("a")), (2, say("b")), (2, say("c")), (None, say("d")), (None, None), (5, "")} <= set(got) and got.count((5, "")) == 2

    rows = [(None, f"{say('h')} {leak}"), (None, say("i")), (7, f"{leak} {say('j')}"), (7, say("k")), (7, say("k")), (7, None), (8, leak), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.decontamination(spark, docs, SF).collect()), key=str)
    assert got == sorted([rows[k] for k in (1, 3, 4, 5, 7)], key=str)


def test_stages_without_rows(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "none")
        assert docs.count() == 0


def test_stages_keep_odd_rows(spark, odd_docs):
    """Columns with clashing names, nulls, repeated rows and very long texts: each stage's rows are known."""
    clash = odd_docs.withColumns({c: F.lit(c) for c in ("gone", "text_key", "told_id", "told_key", "stays", "TEXT_KEY_", "labels", "quality", "node", "comp")})
    rows = sorted(map(tuple, clash.collect()), key=str)
    model_free = [r for r in rows if not r[1] or not r[1].strip()]
    kept = corpus_pipeline.quality(spark, clash, SF)
    assert kept.columns == clash.columns and set(map(tuple, kept.collect())) <= set(rows)
    kept = corpus_pipeline.near_duplicates(spark, clash, SF)
    got = sorted(map(tuple, kept.collect()), key=str)
    # ids 7, 7 and 8 share a text, and so do 13 and 14
    assert kept.columns == clash.columns and [r for r in got if not r[1] or not r[1].strip()] == model_free
    assert sorted(str(r[0]) for r in got) == sorted(["None", "None", *map(str, (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, -5))])
    kept = corpus_pipeline.decontamination(spark, clash, SF)
    assert kept.columns == clash.columns and sorted(map(tuple, kept.collect()), key=str) == rows
    kept = corpus_pipeline.personal_data(spark, clash, SF)
    assert kept.columns == clash.columns and kept.count() == len(rows) and kept.where("text is null").count() == clash.where("text is null").count()
    packed = corpus_pipeline.packing(spark, clash, SF).collect()
    assert all(len(r.ids) == r.length for r in packed) and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert sum(r.start + r.length for r in packed if r.doc_id == 6 and r.ids[-1] == 2) == sum(r.length for r in packed if r.doc_id == 6)


def test_decontamination_with_clashing_names(spark):
    leak = table(spark, SF, "benchmark").where("length(text) > 200").first()["text"]
    docs = spark.createDataFrame([(1, leak, "a", "b"), (None, leak, None, None), (2, "clean text", "c", "d")], "doc_id long, text string, gone string, Text_Key string")
    assert [tuple(r) for r in corpus_pipeline.decontamination(spark, docs, SF).collect()] == [(2, "clean text", "c", "d")]


def test_packed_ids(spark, tok):
    """The ids of a document's pieces, in order, are those of its text and the end."""
    docs = table(spark, SF, "documents")
    found = {}
    for r in corpus_pipeline.packing(spark, docs, SF).collect():
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
        found.setdefault(r.doc_id, []).append((r.start, r.ids))
    for r in docs.collect():
        assert sum((ids for _, ids in sorted(found[r.doc_id])), []) == [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
