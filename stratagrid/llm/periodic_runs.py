"""Periodic runs of words: which stretches of a text repeat one period three times or more, and the text without the repeats.

A run with period q matches itself at lag q on at least max(24 - q, 2q) consecutive words, so a lag with fewer
equal pairs in the whole text holds no run. Equal pairs are counted exactly for all lags up to a third of the text:
frequent words by autocorrelation (one FFT of each word's places, their power summed, one transform back), rare
words by the differences of their places. Only lags with enough pairs are scanned for islands of matches.

Lags are taken in ascending order. An island that a smaller lag has found with the same bounds is a multiple of that
period: three periods long, it has by Fine and Wilf the smaller one throughout, so its bounds are the same.
A text is one value and its words one array, so memory follows the longest text; batches are cut by bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, slices, texts_of

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
_RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class _Numbers(dict):
    """Numbers of words in the order of their first sight."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with a period written over the rest of the text, for one id in ten by crc32."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def _matches(lag: int) -> int:
    """Consecutive equal pairs that a run with this period has at least."""
    return max(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)


def lag_counts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text of word numbers: at [q], how many places i have words i and i + q equal, for q up to n // 3."""
    n = np.array([len(t) for t in texts])
    lags = n // LEAST_PERIODS
    base = np.concatenate([[0], np.cumsum(lags + 1)])
    out = np.zeros(base[-1], dtype=np.int64)
    words = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    key = doc * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    key, place, doc = key[order], place[order], doc[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(first, append=len(key))
    # a word is frequent where its pairs cost more than a transform of the text
    size = 2 ** np.ceil(np.log2(np.maximum(n + lags, 2))).astype(int)
    limit = np.maximum(64, np.sqrt(0.3 * size * np.log2(size)))
    heavy = times > limit[doc[first]] if len(first) else np.zeros(0, bool)
    power: dict[int, np.ndarray] = {}
    for k in np.flatnonzero(heavy):
        d, at = doc[first[k]], place[first[k] : first[k] + times[k]]
        marks = np.zeros(size[d])
        marks[at] = 1
        found = np.abs(np.fft.rfft(marks)) ** 2
        power[d] = power[d] + found if d in power else found
    for d, p in power.items():
        out[base[d] : base[d + 1]] += np.rint(np.fft.irfft(p, size[d])[: lags[d] + 1]).astype(np.int64)
    rare = np.repeat(~heavy, times)
    key, place, doc = key[rare], place[rare], doc[rare]
    # all words by their first, second, third ... repeat; a word leaves when its repeats are too far or over
    a, step, held, kept = np.arange(len(key)), 1, [], 0
    while len(a):
        a = a[a + step < len(key)]
        b = a + step
        lag = place[b] - place[a]
        near = (key[b] == key[a]) & (lag <= lags[doc[a]])
        a = a[near]
        held.append(base[doc[a]] + lag[near])
        kept += len(a)
        step += 1
        if kept > 4_000_000 or not len(a):
            found = np.concatenate(held)
            if len(found):
                out += np.bincount(found, minlength=len(out))
            held, kept = [], 0
    return [out[base[d] : base[d + 1]] for d in range(len(texts))]


def islands(words: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of places i with words i and i + lag equal, that are long enough for a run."""
    need = _matches(lag)
    left, right = words[:-lag], words[lag:]
    if len(left) > 8192:  # a long enough stretch holds three places in a row of this grid
        grid = slice(None, None, max(1, need // 3))
        hit = left[grid] == right[grid]
        if not (hit[:-2] & hit[1:-1] & hit[2:]).any():
            return []
    edges = np.flatnonzero(np.diff((left == right).astype(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    long = end - start >= need
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def runs(words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    lags = np.arange(len(counts))
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero((lags > 0) & (counts >= np.maximum(LEAST_WORDS - lags, (LEAST_PERIODS - 1) * lags))).tolist():
        for start, end in islands(words, q):
            found.setdefault((start, end - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    depth = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def find(docs: DataFrame, plant: bool = False) -> DataFrame:
    """A row for each row of docs(doc_id, text): its runs of repeated words, the strongest of them, and digests.

    Words are what lies between ASCII white space. A run is a stretch with smallest period q and at least
    max(24, 3q) words that no neighbouring word extends. The strongest has the greatest length / period, then the
    smallest start, then the smallest period. `plant` first writes periods over one document in ten, by its id.
    A null or empty text, and one of fewer than 24 words, has no run; its four columns of the strongest are null and
    runs_sha256 is that of nothing. A null doc_id is never planted. Texts of any length are read whole; rows that
    repeat an id or a text have a row each; an empty table gives no rows; other columns are not read."""
    schema = arrow_schema(_RUNS)

    def run(batches):
        for batch in slices(batches):
            ids, out = batch.column("doc_id").to_pylist(), []
            number = _Numbers()
            numbered = []
            for doc_id, text in zip(ids, texts_of(batch), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                own = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
                numbered.append(planted(own, doc_id) if plant else own)
            word = list(number)
            for doc_id, own, counts in zip(ids, numbered, lag_counts(numbered), strict=True):
                found = runs(own, counts)
                best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                rest = own[kept_words(len(own), found)] if found else own
                collapsed = b" ".join([word[k] for k in rest.tolist()])
                out.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _RUNS)
