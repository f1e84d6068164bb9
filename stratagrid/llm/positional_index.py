"""Distributed positional inverted index with phrase and proximity search.

The index holds the postings of every word of every document, so it is written once and answers any
phrase. A shard is one row: some documents, its distinct words, and for each word the ascending positions at
which it stands (the documents follow one another with a gap between, so a phrase cannot cross two). A
query intersects position lists adjusted by each word's offset, from the word that is rarest in the whole
corpus to the most common; all phrases that a block of test items makes are intersected side by side.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, slices, text_key, texts_of, written

#: For bytes.translate: A-Z become lower case; what is no digit, letter or byte of a longer character, a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Places that are looked at together: what bounds a search's memory.
TOGETHER = 1 << 20

_SHARD = "shard long, doc_ids array<long>, text_keys array<string>, n_words array<long>, words binary, counts binary, postings binary"
_HITS = "shard long, k int, doc_id long, text_key string, n_words long, items array<string>, spans array<long>"
_REPORT = "doc_id long, text_key string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<long>"


def words(text: str) -> list[bytes]:
    """Words of lower-cased text: runs of digits, letters a-z and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Numbers(dict):
    """Words by number, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def build_index(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """Index of docs(doc_id, text), as a written table of shards of some megabytes of text.

    Each shard has a number of its own, so documents are known by shard and place in it. A document without
    words has an entry too. A text larger than a shard is a shard of its own. keyed: with a digest of each text."""
    schema = arrow_schema(_SHARD)

    def build(batches):
        part = TaskContext.get().partitionId()
        for made, batch in enumerate(slices(batches)):
            number, at, lengths, ids, places = Numbers(), 0, [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for text in texts_of(batch):
                found = words(text)
                ids.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
                places.append(np.arange(at, at + len(found)))
                lengths.append(len(found))
                at += len(found) + 1
            flat = np.concatenate(ids)
            put = np.concatenate(places)[np.argsort(flat, kind="stable")]
            row = (part << 32 | made, batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), lengths, b" ".join(number),
                   np.bincount(flat, minlength=len(number)).astype("<u4").tobytes(), np.diff(put, prepend=0).astype("<i8" if at > 2**31 else "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

    key = text_key(F.col("text")) if keyed else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("text_key"))
    return written(rows.mapInArrow(build, _SHARD), "index", "zstd")


@dataclass(frozen=True)
class Phrases:
    """Runs of words to look for. Words are numbers into vocabulary; run r is flat[starts[r] : starts[r] + sizes[r]]
    and belongs to the item names[owners[r]]. Runs share flat, so an item's windows take no room of their own."""

    vocabulary: list[bytes]
    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    owners: np.ndarray
    names: list[str]

    @staticmethod
    def windows(items: Iterator[tuple[str, str]], size: int | None) -> Phrases:
        """All runs of `size` words of each (name, text), or all of its words where they are fewer (or size is None)."""
        number, flat, starts, sizes, owners, names, at = Numbers(), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
        for name, text in items:
            found = words(text)
            if found:
                n = min(size or len(found), len(found))
                flat.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
                starts.append(np.arange(at, at + len(found) - n + 1))
                sizes.append(np.full(len(starts[-1]), n))
                owners.append(np.full(len(starts[-1]), len(names)))
                names.append(name)
                at += len(found)
        return Phrases(list(number), *(np.concatenate(x) for x in (flat, starts, sizes, owners)), names)


def frequencies(index: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """How often each of these words stands in the whole corpus; the driver gets one number for each."""
    shared, schema = index.sparkSession.sparkContext.broadcast(vocabulary), arrow_schema("word int, n long")

    def totals(batches):
        number, out = {w: k for k, w in enumerate(shared.value)}, np.zeros(len(shared.value), dtype=np.int64)
        for batch in slices(batches, "words"):
            for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                of = np.fromiter((number.get(x, -1) for x in w.split()), dtype=np.int64)
                out[of[of >= 0]] += np.frombuffer(c, "<u4")[of >= 0]
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], schema=schema)

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for r in index.select("words", "counts").mapInArrow(totals, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


class Shard:
    """The position lists of one shard, for the words of a vocabulary."""

    def __init__(self, row: dict, number: dict[bytes, int]):
        n_words = row["n_words"]
        self.bases = np.cumsum([0, *(n + 1 for n in n_words)])
        self.span = int(self.bases[-1]) + 1
        counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        places = np.cumsum(np.frombuffer(row["postings"], "<i8" if self.span - 1 > 2**31 else "<i4"), dtype=np.int64)
        self.count, self.first = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        of = np.fromiter((number.get(w, -1) for w in row["words"].split()), dtype=np.int64)
        self.count[of[of >= 0]], self.first[of[of >= 0]] = counts[of >= 0], (np.cumsum(counts) - counts)[of >= 0]
        # where each word of the vocabulary has its list here, and all lists in one ascending row of numbers
        self.local = np.full(len(number), -1)
        self.local[of[of >= 0]] = np.flatnonzero(of >= 0)
        self.keys = np.repeat(np.arange(len(counts)), counts) * self.span + places
        self.places = places

    def find(self, phrases: Phrases, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, place at which it starts) of all occurrences."""
        runs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        here = np.concatenate([[0], np.cumsum(self.count[phrases.flat] > 0)])
        likely = np.flatnonzero(here[phrases.starts + phrases.sizes] - here[phrases.starts] == phrases.sizes)
        for n in np.unique(phrases.sizes[likely]).tolist():
            own = likely[phrases.sizes[likely] == n]
            for s in range(0, len(own), TOGETHER // n + 1):
                some = own[s : s + TOGETHER // n + 1]
                terms = phrases.flat[phrases.starts[some][:, None] + np.arange(n)]
                order = np.argsort(frequency[terms], axis=1, kind="stable")  # of equals the first comes first
                rarest = terms[np.arange(len(some)), order[:, 0]]
                ends = np.cumsum(self.count[rarest])
                a = 0
                while a < len(some):  # as many runs as have about TOGETHER places to look at
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, side="right")))
                    size = self.count[rarest[a:b]]
                    which = np.repeat(np.arange(a, b), size)
                    at = self.places[np.repeat(self.first[rarest[a:b]] - np.cumsum(size) + size, size) + np.arange(size.sum())] - order[which, 0]
                    for j in range(1, n):
                        offset = order[which, j]
                        wanted = self.local[terms[which, offset]] * self.span + at + offset
                        k = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                        # a start before the first place must not reach into the list of the word before
                        stays = (self.keys[k] == wanted) & (at >= 0)
                        which, at = which[stays], at[stays]
                    which, at = which[at >= 0], at[at >= 0]
                    runs.append(some[which])
                    found.append(at)
                    a = b
        return np.concatenate(runs), np.concatenate(found)

    def near(self, terms: np.ndarray, frequency: np.ndarray, slop: int) -> np.ndarray:
        """Places of the rarest word that have every other word within slop words, in the same document."""
        if not self.count[terms].all():
            return np.zeros(0, np.int64)
        lists = [self.places[self.first[t] : self.first[t] + self.count[t]] for t in terms[np.argsort(frequency[terms], kind="stable")]]
        hits = lists[0]
        doc = np.searchsorted(self.bases, hits, side="right")
        low, high = np.maximum(hits - slop, self.bases[doc - 1]), np.minimum(hits + slop, self.bases[np.minimum(doc, len(self.bases) - 1)] - 2)
        keep = np.ones(len(hits), dtype=bool)
        for there in lists[1:]:
            keep &= np.searchsorted(there, high, side="right") > np.searchsorted(there, low, side="left")
        return hits[keep]


def search(index: DataFrame, phrases: Phrases, slop: int | None = None, hits_only: bool = False) -> DataFrame:
    """A row for each document: the items with a phrase in it, and the spans hit (start, end, start, ...).

    The caller bounds the size of phrases, which is broadcast. With slop, words count as found where all stand
    within slop words of the rarest one. hits_only: without the documents that have no hit."""
    shared = index.sparkSession.sparkContext.broadcast((phrases, frequencies(index, phrases.vocabulary)))
    schema = arrow_schema(_HITS)

    def look(batches):
        p, frequency = shared.value
        number = {w: k for k, w in enumerate(p.vocabulary)}
        for batch in slices(batches, "postings", most_rows=1):
            row = batch.to_pylist()[0]
            s = Shard(row, number)
            if slop is None:
                runs, at = s.find(p, frequency)
                sizes = p.sizes[runs]
            else:
                each = [s.near(p.flat[a : a + n], frequency, slop) for a, n in zip(p.starts.tolist(), p.sizes.tolist())]
                runs, at = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate([np.zeros(0, np.int64), *each])
                sizes = np.ones(len(at), dtype=np.int64)
            doc = np.searchsorted(s.bases, at, side="right") - 1
            items: dict[int, list[str]] = {}
            for k, owner in np.unique(np.stack([doc, p.owners[runs]], axis=1), axis=0).tolist():
                items.setdefault(k, []).append(p.names[owner])
            edge = np.bincount(at, minlength=s.span + 1) - np.bincount(at + sizes, minlength=s.span + 1)
            hit = np.concatenate([[False], np.cumsum(edge) > 0])
            turns = np.flatnonzero(hit[1:] != hit[:-1])
            spans: dict[int, list[int]] = {}
            for k, a, b in zip((np.searchsorted(s.bases, turns[::2], side="right") - 1).tolist(), turns[::2].tolist(), turns[1::2].tolist()):
                spans.setdefault(k, []).extend((a - int(s.bases[k]), b - int(s.bases[k])))
            kept = sorted(items) if hits_only else range(len(row["doc_ids"]))
            columns = [[row["shard"]] * len(kept), list(kept), *([row[c][k] for k in kept] for c in ("doc_ids", "text_keys", "n_words")), [sorted(set(items.get(k, ()))) for k in kept], [spans.get(k, []) for k in kept]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    return index.mapInArrow(look, _HITS)


def merged(spans) -> list[int]:
    """Spans joined where they meet, flat: start, end, start, end, ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, keyed: bool = False) -> DataFrame:
    """Which benchmark items have a window of consecutive words in each document of docs(doc_id, text).

    A window is `window` words of an item, or all words of a shorter one; an item without words has none.
    A word inside any occurrence of a window is hit. The items (item_id, text) are read in blocks of at
    most about block_bytes, so what the driver and a worker hold of them has a bound; all blocks search the
    same index. Every row of docs gives a row, repeated ones too; a null text has no words; texts of any length
    are searched whole; an empty table gives no rows. A null item_id counts as the empty id; items that share
    an id are one; words that are equally rare are taken in the phrase's order, which changes no result.
    Other columns are not read. keyed: with a column text_key, a digest of the text.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    index, out = build_index(docs, keyed), None
    for b in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        phrases = Phrases.windows(((r["item"], r["text"]) for r in some.toLocalIterator()), window)
        hits = search(index, phrases, hits_only=b > 0)
        if blocks > 1:
            hits = written(hits, "hits")
        out = hits if out is None else out.unionByName(hits)
    if blocks > 1:
        out = out.groupBy("shard", "k").agg(
            *(F.max(c).alias(c) for c in ("doc_id", "text_key", "n_words")), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    schema = arrow_schema(_REPORT)

    def report(batches):
        for batch in batches:
            names = [sorted(set(x)) for x in batch.column("items").to_pylist()]
            spans = [merged(zip(s[::2], s[1::2])) for s in batch.column("spans").to_pylist()]
            n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array([n > 0 for n in n_hit], pa.bool_()),
                pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], schema=schema)

    found = out.select("doc_id", "text_key", "n_words", "items", "spans").mapInArrow(report, _REPORT)
    return found if keyed else found.drop("text_key")
