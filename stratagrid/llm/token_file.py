"""Fixed-width bit packing of token ids, with block offsets for random access.

A segment holds whole documents in ascending doc_id order. Layout, little-endian:

    magic "FWP1" | bits u8 | n_docs u32 | n_tokens u64 | block_tokens u32
    doc ids i64[n_docs] | doc id is null u8[n_docs] | doc token counts u64[n_docs]
    block byte offsets u64[n_blocks + 1] | packed blocks

Each id takes the fewest bits that hold the vocabulary; each block of block_tokens ids starts on a byte,
so any range of ids is read from the blocks that it touches. Segments are the rows of a Parquet table,
since Spark's committer is what makes a write survive lost executors.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, slices, text_groups, texts_of, written
from .encoding import default_tokenizer, encoder

MAGIC = b"FWP1"
_HEAD = struct.Struct("<4sBIQI")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits bits each, the first in the lowest bits; eight ids fill exactly bits bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    n = len(ids)
    rows = np.zeros((-(-n // 8), 8), dtype=np.uint64)
    rows.reshape(-1)[:n] = ids
    out = np.zeros((len(rows), bits), dtype=np.uint8)
    for i in range(8):
        for j in range(i * bits // 8, ((i + 1) * bits - 1) // 8 + 1):
            by = i * bits - 8 * j
            part = rows[:, i] << np.uint64(by) if by >= 0 else rows[:, i] >> np.uint64(-by)
            out[:, j] |= (part & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    groups = -(-n // 8)
    raw = np.zeros(groups * bits, dtype=np.uint8)
    raw[: min(len(data), len(raw))] = np.frombuffer(data, dtype=np.uint8)[: len(raw)]
    rows = raw.reshape(groups, bits).astype(np.uint64)
    out = np.zeros((groups, 8), dtype=np.uint64)
    for i in range(8):
        for j in range(i * bits // 8, ((i + 1) * bits - 1) // 8 + 1):
            by = i * bits - 8 * j
            out[:, i] |= rows[:, j] >> np.uint64(by) if by >= 0 else rows[:, j] << np.uint64(-by)
    return (out & np.uint64((1 << bits) - 1)).astype("<u4").reshape(-1)[:n]


def segment(doc_ids: list[int | None], ids: list[bytes], bits: int, block_tokens: int = 4096) -> bytes:
    """One segment of documents and their ids (bytes of little-endian unsigned 32-bit integers)."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    if len(flat) and int(flat.max()) >> bits:
        raise ValueError(f"an id does not fit into {bits} bits")
    blocks = [pack(flat[i : i + block_tokens], bits) for i in range(0, len(flat), block_tokens)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([
        _HEAD.pack(MAGIC, bits, len(doc_ids), len(flat), block_tokens),
        np.asarray([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.asarray([d is None for d in doc_ids], dtype="u1").tobytes(),
        np.asarray([len(x) // 4 for x in ids], dtype="<u8").tobytes(),
        offsets.tobytes(), *blocks,
    ])


class Segment:
    """Reads a segment; tokens(a, b) touches only the blocks that hold ids a to b."""

    def __init__(self, data: bytes):
        magic, self.bits, n, self.n_tokens, self.block = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = _HEAD.size
        ids = np.frombuffer(data, "<i8", n, at).tolist()
        null = np.frombuffer(data, "u1", n, at + 8 * n).tolist()
        self.doc_ids = [None if z else d for d, z in zip(ids, null)]
        self.counts = np.frombuffer(data, "<u8", n, at + 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        blocks = -(-self.n_tokens // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 17 * n)
        self.data = memoryview(data)[at + 17 * n + 8 * (blocks + 1) :]

    def tokens(self, a: int, b: int) -> np.ndarray:
        a, b = max(0, a), min(b, self.n_tokens)
        if a >= b:
            return np.zeros(0, dtype="<u4")
        first, last = a // self.block, (b - 1) // self.block
        if self.block % 8 == 0 or first == last:  # whole groups of eight: the blocks are one run of bits
            raw = self.data[int(self.offsets[first]) : int(self.offsets[last + 1])]
            return unpack(raw, min((last + 1) * self.block, self.n_tokens) - first * self.block, self.bits)[a - first * self.block : b - first * self.block]
        return np.concatenate([self.tokens(max(a, k * self.block), min(b, (k + 1) * self.block)) for k in range(first, last + 1)])

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


_SEGMENTS = "part int, part_start long, n_tokens long, content binary"
_LOCAL = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def write_segments(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, partition_bytes: int = 16 << 20, segment_tokens: int = 1 << 20) -> DataFrame:
    """Encodes docs(doc_id, text) and writes segments in ascending doc_id order; returns the written table.

    Rows that share a doc_id are ordered by a digest of the text, so a doc_id that many rows share is dealt
    over tasks like any other; a null doc_id comes first; a null text is empty, so its document is the end
    id alone. A text of any length is encoded whole. Other columns are not read. An empty table gives no segments.
    """
    path = tokenizer or default_tokenizer()
    schema = arrow_schema(_SEGMENTS)

    def encode(batches):
        enc = encoder(path)
        bits = bits_for(max(len(enc.starts), end_id + 1))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        part, start, names, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, start, held, segment(names, ids, bits)), schema.types)], schema=schema)

        for batch in slices(batches):
            for d, x in zip(batch.column("doc_id").to_pylist(), enc.encode(texts_of(batch))):
                names.append(d)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= segment_tokens:
                    yield full()
                    start, names, ids, held = start + held, [], [], 0
        if names:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    placed = rows.repartitionByRange(text_groups(docs, "text", partition_bytes), *order).sortWithinPartitions(*order)
    return written(placed.select("doc_id", "text").mapInArrow(encode, _SEGMENTS), "segments")


def read_segments(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the segments alone.

    What stands before a partition of the write is summed over its totals (one row each) and joined to the
    rows of numbers that the segments give, not to the segments."""
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the write
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = arrow_schema(_LOCAL)

    def decode(batches):
        for batch in slices(batches, "content", most_rows=1):
            for part, start, data in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "content"))):
                s = Segment(data)
                flat, cuts = s.tokens(0, s.n_tokens), s.starts.tolist()
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(crc), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array([start + a for a in cuts[:-1]], pa.int64()),
                    pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)

    found = segments.select("part", "part_start", "content").mapInArrow(decode, _LOCAL)
    return found.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
