"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose measure passes a cutoff. The cutoffs of all rules tighten together
through fixed levels, from lenient to strict, so that what one level rejects the next rejects too. For
each stratum the labelled holdout tests the levels in that order: a level is certified while the exact
binomial test refutes "this level rejects more than `risk` of the good documents". The order is fixed
beforehand, so the levels of a stratum need no correction among themselves (fixed-sequence testing); the
strata share the error `error` by Bonferroni. With probability 1 - error every stratum's level keeps its
false rejections within risk. Of the certified levels the one that serves best is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, slices, texts_of, written

SYMBOLS = b"#*$%&|<>"
#: Cutoffs of each measure, lenient to strict: a measure above it rejects.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbol_rate": (2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.06),
    "shout_rate": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "stutter_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
    "repeat_rate": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5),
    "duplicate_line_rate": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5),
}
LEVELS = 10


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) & 0x3FFFFFFFFFFFFFFF | (word.isupper() and len(word) > 1) << 62
        return found


def measure(text: str, memo: _Hashes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shout, n_stutter."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at the six ASCII white-space characters only
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=n)
    repeated = stutter = 0
    if n > 1:
        stutter = int((h[1:] == h[:-1]).sum())
    if n > 3:
        g = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + h[2:]
        order = np.argsort(g, kind="stable")
        s = g[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(n - 2, dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), int((h >> np.uint64(62)).sum()), stutter


def content(text: str) -> int:
    """A digest of the words in lower case without signs and digits: copies that differ in those only share it."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").translate(_LETTERS).split())) - (1 << 63)


_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout", "n_stutter")
_FEATURES = "doc_id long, stratum string, " + ", ".join(f"{m} long" for m in _MEASURES) + ", content long"


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    schema = arrow_schema(_FEATURES)

    def run(batches):
        memo = _Hashes()
        for batch in slices(batches):
            found = [(*measure(t, memo), content(t)) for t in texts_of(batch)]
            columns = zip(*found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _FEATURES)


def level() -> Column:
    """The first level, from 1, at which some rule rejects; LEVELS + 1 where none does."""
    per_word = {"symbol_rate": "n_symbols", "shout_rate": "n_shout", "stutter_rate": "n_stutter", "repeat_rate": "n_repeat_words"}
    rates = {k: F.col(v) / F.greatest("n_words", F.lit(1)) for k, v in per_word.items()}
    rates["duplicate_line_rate"] = F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    first = []
    for name, cuts in CUTOFFS.items():
        found = F.lit(LEVELS + 1)
        for k in range(LEVELS, 0, -1):
            found = F.when(rates[name] > cuts[k - 1], k).otherwise(found)
        first.append(found)
    return F.least(*first)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Binomial(n, p), summed exactly from the largest term down."""
    if k >= n:
        return 1.0
    top = min(k, int(n * p))
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    total, term, i = 0.0, math.exp(log(top)), top
    while i >= 0 and term > 1e-18 * max(total, 1e-300):
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    term, i = math.exp(log(top)), top
    while i < k:
        term *= (n - i) / (i + 1) * p / (1 - p)
        i += 1
        total += term
        if term < 1e-18 * total:
            break
    return min(1.0, total)


def choose(counts: dict[str, tuple[np.ndarray, np.ndarray]], risk: float, error: float, weight: float) -> dict[str, int]:
    """The level of each stratum, 0 for none. counts: good and bad documents by first rejecting level.

    Of the certified levels, that with the most bad documents rejected less weight times the good ones;
    of equals the most lenient."""
    out = {}
    for name, (good, bad) in counts.items():
        n, lost, gained, best = int(good.sum()), np.cumsum(good), np.cumsum(bad), (0.0, 0)
        for k in range(1, LEVELS + 1):
            if n == 0 or binomial_tail(int(lost[k]), n, risk) > error / len(counts):
                break
            worth = float(gained[k]) - weight * float(lost[k])
            if worth > best[0]:
                best = (worth, k)
        out[name] = best[1]
    return out


def trials(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, level, quality), one row for each text with a label: the exact test needs independent rows, so
    rows that share a doc_id, or their words but for case, signs and digits, count once. The one that counts
    has the smallest digest of its doc_id; of several labels of a doc_id the lowest counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    own = found.select("doc_id", "stratum", "level", "content").join(known, "doc_id")
    first = F.struct(F.xxhash64("doc_id"), "doc_id", "content", "stratum", "level", "quality")
    for key in ("doc_id", "content"):
        own = own.groupBy(key).agg(F.min(first).alias("r")).select("r.doc_id", "r.content", "r.stratum", "r.level", "r.quality")
    return own.select("stratum", "level", "quality")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, error: float = 0.05, weight: float = 10.0, most_strata: int = 10_000) -> DataFrame:
    """Measures and verdict of every row of docs(doc_id, text, stratum).

    base_failed: fewer than 50 words, or more than half of them in repeated three-word windows. kept is
    false for these and for what the stratum's certified level rejects. The risk is that of good documents
    that pass the base rules. A stratum without enough good labels to certify any level rejects nothing beyond
    the base. A null text has no words; a null stratum is the stratum ""; a text of any length is measured
    whole; an empty table gives no rows. Labels count as trials() says; null labels and ids do not count.
    Of levels that serve equally the most lenient is taken. Repeated rows give repeated rows; other columns are
    not read. The driver gets the counts of each labelled stratum by level; more than most_strata strata (not
    languages or sources, then) raise ValueError.
    """
    found = written(measures(docs, stratum).withColumn("level", level()), "measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tested = trials(found.where(~failed), labels).groupBy("stratum").agg(*(F.count(F.when((F.col("quality") == q) & (F.col("level") == k), 1)).alias(f"n{q}_{k}") for q in (0, 1) for k in range(LEVELS + 2)))
    rows = tested.limit(most_strata + 1).collect()
    if len(rows) > most_strata:
        raise ValueError(f"more than {most_strata} strata")
    counts = {r["stratum"]: tuple(np.asarray([r[f"n{q}_{k}"] for k in range(LEVELS + 2)]) for q in (1, 0)) for r in rows}
    chosen = docs.sparkSession.createDataFrame(sorted(choose(counts, risk, error, weight).items()), "stratum string, chosen int")
    base = failed.alias("base_failed")
    kept = (~failed & (F.col("level") > F.coalesce("chosen", F.lit(0)))).alias("kept")
    # at most most_strata rows of a name and a number
    return found.join(F.broadcast(chosen), "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, kept)
