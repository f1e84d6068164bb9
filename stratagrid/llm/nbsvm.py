"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss
model fitted by dual coordinate descent.

Three families of n-grams stand side by side: one and two words, four characters, and one to three word
shapes. A shape says how a word is written (case, digits, sign at its end, length) and whether it
repeats the word before it, so its grams also fit words that no training text has. Each family is hashed
into a table of its own and brought to unit length in a text, so that none drowns another.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_schema, crc32_mod, slices, texts_of

#: Size of the table that the grams of a family are hashed into.
BITS = 18
FAMILIES = ("words", "characters", "shapes")
BUCKETS = len(FAMILIES) << BITS
#: Bytes of text whose grams are made at a time: what bounds a worker's memory.
TOGETHER = 1 << 19
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split also cuts at, in ASCII.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shape(word: str) -> int:
    """Below 64: case (3 bits), sign at the end (2 bits), length (1 bit); the bit above is for a repeated word."""
    tail = 0
    while tail < len(word) and not word[len(word) - tail - 1].isalnum():
        tail += 1
    body, last = word[: len(word) - tail], word[-1:]
    if not body:
        case = 0
    elif any(c.isdigit() for c in body):
        case = 1
    elif body.isupper() and len(body) > 1:
        case = 2
    elif body[0].isupper():
        case = 3
    elif body.islower():
        case = 4
    elif not any(c.isalpha() for c in body):
        case = 5
    else:
        case = 6
    sign = 0 if not tail else 1 if last in ".?!" else 2 if last in ",;:" else 3
    return case | sign << 3 | (len(body) > 12) << 5


class WordMemo(dict):
    """(hash of the lower-cased word, shape) by word; forgets all of them at a bounded size."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass").translate(LOWER)
        found = self[word] = xxhash.xxh3_64_intdigest(raw) >> 7 << 7 | shape(word)
        return found


def _runs(codes: np.ndarray, doc: np.ndarray, sizes: range, multiply: np.uint64) -> np.ndarray:
    """(text number << BITS | bucket) of the runs of these sizes within one text, distinct and sorted.

    32 bits hold the key of up to 16,384 texts at a time."""
    keys, gram = [np.zeros(0, np.uint32)], np.zeros(len(codes), np.uint64)
    for n in range(1, sizes.stop):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * multiply
        gram += codes[n - 1 :]
        gram += np.uint64(1)
        if n >= sizes.start:
            mixed = gram >> np.uint64(29)
            mixed ^= gram
            mixed *= _MIX
            mixed >>= np.uint64(64 - BITS)
            own = doc[: len(gram)]
            key = own << np.uint32(BITS) | mixed.astype(np.uint32) ^ np.uint32(n * 40503 & (1 << BITS) - 1)
            keys.append(key[own == doc[n - 1 :]])
    key = np.sort(np.concatenate(keys))
    return key[np.diff(key, prepend=~key[:1]) != 0] if len(key) else key


def features(texts: list[str], memo: WordMemo, families: tuple[str, ...] = FAMILIES) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each indicator, by text: grams of whole texts."""
    flat, ends = [np.zeros(0, np.uint64)], []
    for text in texts:
        words = text.split() if text.isascii() and not _SEPARATORS.search(text) else _WORD.findall(text)
        codes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(words) > 1:
            again = np.fromiter(map(str.__eq__, words[1:], words), dtype=bool, count=len(words) - 1)
            codes[1:] |= again.astype(np.uint64) << np.uint64(6)
        flat.append(codes)
        ends.append(len(words))
    codes, doc = np.concatenate(flat), np.repeat(np.arange(len(texts), dtype=np.uint32), ends)
    found = []
    for k, family in enumerate(FAMILIES):
        if family not in families:
            continue
        if family == "words":
            keys = _runs(codes >> np.uint64(7), doc, range(1, 3), _MIX)
        elif family == "shapes":
            keys = _runs(codes & np.uint64(127), doc, range(1, 4), _MIX)
        else:
            raw = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
            bytes_ = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
            keys = _runs(bytes_, np.repeat(np.arange(len(texts), dtype=np.uint32), [len(r) for r in raw]), range(4, 5), np.uint64(257))
        found.append((keys >> BITS, keys & np.uint32((1 << BITS) - 1) | np.uint32(k << BITS)))
    doc, bucket = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    order = np.argsort(doc, kind="stable")
    return doc[order], bucket[order]


def _lengths(doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """What each indicator counts: 1 / sqrt(number of grams of its family in its text)."""
    own = doc * len(FAMILIES) + (bucket >> BITS)
    return 1 / np.sqrt(np.bincount(own)[own]) if len(own) else np.zeros(0)


@dataclass(frozen=True)
class Model:
    """A score is 1 / (1 + exp(-(slope * (weights . x + bias) + shift))), x as _lengths has it."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    families: tuple[str, ...] = FAMILIES

    def margins(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weights[bucket] * _lengths(doc, bucket), minlength=n) + self.bias

    def scores(self, texts: list[str], memo: WordMemo) -> np.ndarray:
        z = self.slope * self.margins(*features(texts, memo, self.families), len(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log(share of the bucket among class 1's indicators of its family / that among class 0's), smoothed."""
    share = []
    for y in (1, 0):
        own, n = [r for r, v in zip(rows, labels) if v == y], np.full(BUCKETS, smooth)
        for a in range(0, len(own), 500):  # a copy of all rows at once would be the driver's peak
            n += np.bincount(np.concatenate(own[a : a + 500]), minlength=BUCKETS)
        n = n.reshape(len(FAMILIES), -1)
        share.append(n / n.sum(axis=1, keepdims=True))
    return np.log(share[0] / share[1]).reshape(-1)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, most: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Dual coordinate descent for min |w|^2/2 + b^2/2 + sum most * max(0, 1 - y (w . x + b)): (alpha, w, b)."""
    square = np.asarray([v @ v + 1 for v in values])
    alpha, w, bias, order = np.zeros(len(y)), np.zeros(BUCKETS), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
                w[r] += step * v
                bias += step
        if moved < 1e-3:
            break
    return alpha, w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 30, smooth: float = 1.0, families: tuple[str, ...] = FAMILIES) -> Model:
    """rows: the buckets of each text. The L1-loss support vector machine over ratio-scaled indicators.

    With one class only (or no row) every score is that class's (or 0.5)."""
    labels = np.asarray(labels)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0 if len(labels) == 0 else 60.0 * (2 * float(labels[0]) - 1), families)
    ratio = ratios(rows, labels, smooth)
    y = np.where(labels == 1, 1.0, -1.0)
    values = [(ratio[r] * _lengths(np.zeros(len(r), np.int64), r)).astype(np.float32) for r in rows]
    most = cost * np.where(y > 0, 0.5 * len(y) / (y > 0).sum(), 0.5 * len(y) / (y < 0).sum())
    _, w, bias = descend(rows, values, y, most, epochs)
    z = np.asarray([w[r] @ v + bias for r, v in zip(rows, values)])
    slope, shift = 1.0, 0.0
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(50):  # Newton steps for the logistic scale
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
        e, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([e @ z + 1e-3 * (slope - 1), e.sum()])
        hess = np.array([[h @ (z * z) + 1e-3, h @ z], [h @ z, h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(w * ratio, bias, float(slope), float(shift), families)


_LEARNT = "weights binary, bias double, slope double, shift double"


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, most_labels: int = 8000, families: tuple[str, ...] = FAMILIES) -> Model:
    """Learns quality from the labelled rows outside fold 0.

    At most most_labels labels are used (those with the smallest hash of doc_id), and of each one row of docs
    (that with the smallest digest of its text): the documented bound of what the one task that fits holds. Only
    the weights reach the driver. A doc_id that has several labels counts as 0 if any of them is 0.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(crc32_mod(F.col("doc_id"), folds) != 0)
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    schema = arrow_schema("quality int, buckets array<int>")

    def extract(batches):
        memo = WordMemo()
        for batch in slices(batches, most_bytes=TOGETHER):
            texts = texts_of(batch)
            doc, bucket = features(texts, memo, families)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([bucket[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int32()))], schema=schema)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = kept.join(F.broadcast(chosen), "doc_id")  # at most most_labels rows of two numbers
    joined = joined.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "quality")).alias("r")).select("r.text", "r.quality")
    learnt_schema = arrow_schema(_LEARNT)

    def learn(batches):
        parts = [(batch.column("quality"), batch.column("buckets")) for batch in batches]
        quality = np.concatenate([q.to_numpy() for q, _ in parts] or [np.zeros(0, np.int32)])
        found = [x.values.to_numpy() for _, column in parts for x in column]  # views, no Python numbers
        order = sorted(range(len(found)), key=lambda i: (zlib.crc32(found[i]), len(found[i]), quality[i]))  # whatever the order of tasks
        model = fit([found[i] for i in order], quality[order], families=families)
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": model.bias, "slope": model.slope, "shift": model.shift}], schema=learnt_schema)

    rows = joined.select("text", "quality").mapInArrow(extract, "quality int, buckets array<int>")
    learnt = rows.repartition(1).mapInArrow(learn, _LEARNT).first()  # one task: at most most_labels rows
    if learnt is None:
        return fit([], np.zeros(0, np.int32), families=families)
    return Model(np.frombuffer(bytes(learnt.weights)), learnt.bias, learnt.slope, learnt.shift, families)


_SCORED = "doc_id long, held_out boolean, score double, predicted int"


def classify(docs: DataFrame, model: Model, folds: int = 5, cutoff: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text).

    A null or empty text has no grams, so its score is the model's bias alone. A null doc_id is not held
    out. A text of any length is scored whole; a score equal to the cutoff is predicted 1; an empty table gives
    no rows. Repeated rows give repeated rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    schema = arrow_schema(_SCORED)

    def score(batches):
        memo = WordMemo()
        for batch in slices(batches, most_bytes=TOGETHER):
            s = shared.value.scores(texts_of(batch), memo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cutoff).astype(np.int32))], schema=schema)

    held = F.coalesce(crc32_mod(F.col("doc_id"), folds) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, _SCORED)


def keep(docs: DataFrame, model: Model, cutoff: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores cutoff or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo = WordMemo()
        for batch in slices(batches, most_bytes=TOGETHER):
            yield batch.filter(pa.array(shared.value.scores(texts_of(batch), memo) >= cutoff))

    return docs.mapInArrow(run, docs.schema)
