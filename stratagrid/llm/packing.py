"""Best-fit packing by patterns: non-negative least squares over the histogram of lengths.

Only the histogram (one count for each length up to the limit) and the plan made from it reach the
driver; both have a size that the limit bounds. The pieces themselves get their places by rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, slices, texts_of, written
from .encoding import default_tokenizer, encoder


def patterns(limit: int) -> np.ndarray:
    """All multisets of one to three lengths that fill a sequence: rows of three, 0 where there is none."""
    i = np.arange(0, limit // 3 + 1)
    low, mid = np.meshgrid(i, np.arange(0, limit // 2 + 1), indexing="ij")
    high = limit - low - mid
    keep = (low <= mid) & (mid <= high)
    return np.stack([high[keep], mid[keep], low[keep]], axis=1)


def fit(found: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes ||A x - hist|| small; column p of A counts the lengths in pattern p.

    Multiplicative steps keep x non-negative and never raise the error."""
    size = len(hist)
    b = hist.astype(float)
    b[0] = 0
    used = (b[found] > 0) | (found == 0)
    live = used.all(axis=1)
    x = np.zeros(len(found))
    sub = found[live]
    if not len(sub):
        return x

    def down(v):  # transposed A
        v = v.copy()
        v[0] = 0
        return v[sub].sum(axis=1)

    def up(y):
        out = np.bincount(sub.reshape(-1), np.repeat(y, 3), minlength=size)
        out[0] = 0
        return out

    y, want = np.full(len(sub), b.sum() / max(1, 3 * len(sub))), down(b)
    for _ in range(rounds):
        y *= want / np.maximum(down(up(y)), 1e-12)
    x[live] = y
    return x


def plan(hist: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, how many such sequences): repeat counts fitted, rounded, then the rest packed.

    Counts are rounded down, fitted to what is left, and at last rounded to the nearest, the largest first,
    as far as the pieces go. The rest goes, longest piece first, to the sequences with the least room that take it
    (best fit by decreasing length)."""
    hist = hist.astype(np.int64).copy()
    found = patterns(limit)
    out: list[tuple[tuple[int, ...], int]] = []
    for last in (False, False, True):
        x = fit(found, hist)
        for p in np.argsort(-x, kind="stable"):
            if x[p] < (0.5 if last else 1):
                break
            lengths = tuple(int(v) for v in found[p] if v)
            need = {v: lengths.count(v) for v in lengths}
            n = min(int(x[p] + (0.5 if last else 0)), *(int(hist[v]) // k for v, k in need.items()))
            if n > 0:
                for v, k in need.items():
                    hist[v] -= n * k
                out.append((lengths, n))
    room: dict[int, list[list]] = {}  # space left: [lengths, how many]
    for length in range(limit, 0, -1):
        left = int(hist[length])
        while left:
            space = next((s for s in range(length, limit) if room.get(s)), None)
            if space is None:
                each = limit // length
                if full := left // each:
                    room.setdefault(limit - each * length, []).append([(length,) * each, full])
                if rest := left - full * each:
                    room.setdefault(limit - rest * length, []).append([(length,) * rest, 1])
                break
            lengths, n = room[space].pop()
            each = min(space // length, left)
            n_used = min(n, left // each)
            if n > n_used:
                room[space].append([lengths, n - n_used])
            room.setdefault(space - each * length, []).append([lengths + (length,) * each, n_used])
            left -= n_used * each
    return out + [(lengths, n) for groups in room.values() for lengths, n in groups]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: which piece goes where."""
    at: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in planned:
        offset = 0
        for v in lengths:
            rows.append((v, at.get(v, 0), sequence, offset))
            at[v] = at.get(v, 0) + n
            offset += v
        sequence += n
    table = np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
_IDS = ", ids array<int>"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(docs: DataFrame, limit: int, tokenizer: str | None = None, end_id: int = 2, ids: bool = False) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its length in its partition; ids adds its token ids."""
    path = tokenizer or default_tokenizer()
    ddl = _PIECES + (_IDS if ids else "")
    schema = arrow_schema(ddl)

    def pieces(batches):
        enc, end = encoder(path), np.asarray([end_id], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, dtype=np.int64)
        for batch in slices(batches):
            rows = []
            for d, x in zip(batch.column("doc_id").to_pylist(), enc.encode(texts_of(batch))):
                x += end
                n = len(x) // 4
                cuts = [0, *range(n % limit or limit, n + 1, limit)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own = (np.frombuffer(x, "<u4")[a:b].astype(np.int32),) if ids else ()
                    rows.append((d, k, a, b - a, zlib.crc32(x[4 * a : 4 * b]), part, int(seen[b - a]), *own))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, ddl)


def pack_documents(docs: DataFrame, limit: int = 1024, tokenizer: str | None = None, end_id: int = 2, ids: bool = False) -> DataFrame:
    """Packs docs(doc_id, text) into few sequences of at most limit ids; a row for each piece, with `ids` its token ids too.

    A null or empty text is the end id alone. Repeated rows are documents of their own (a doc_id may then
    occur twice with the same piece). Pieces of one length are interchangeable; those read first get the
    first places. Texts of any length are cut whole. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, limit, tokenizer, end_id, ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    hist = np.zeros(limit + 1, dtype=np.int64)
    for r in based.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most limit rows
        hist[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(slots(plan(hist, limit)))  # rows: a few for each length
    ddl = _PACKED + (_IDS if ids else "")
    schema = arrow_schema(ddl)

    def place(own: pa.Table, bases: pa.Table) -> pa.Table:
        """The pieces of one part of the input, with the numbers of pieces of each length before it."""
        t = shared.value
        base = np.zeros(limit + 1, dtype=np.int64)
        base[bases.column("length").to_numpy()] = bases.column("base").to_numpy()
        length = own.column("length").to_numpy()
        rank = own.column("rank").to_numpy() + base[length]
        k = np.searchsorted((t[:, 0] << 44) + t[:, 1], (length << 44) + rank, side="right") - 1
        return pa.table([*(own.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(t[k, 2] + rank - t[k, 1]), pa.array(t[k, 3]), *([own.column("ids")] if ids else [])], schema=schema)

    # a part at a time: a part is what one task read
    return pieces.groupBy("part").cogroup(based.groupBy("part")).applyInArrow(place, ddl)
