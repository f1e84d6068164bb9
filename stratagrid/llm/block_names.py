"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and get integer names; then
adjacent names are paired, distinct pairs sorted and named, and so on until one name is left of each text. Texts
with as many blocks have the same pairing, so they are equal exactly where their last names are: no
identity rests on a digest.

What is moved to sort the blocks is each block's bytes once for each task that holds it, dealt by a digest; the texts
themselves refer to blocks by that digest. A digest that two different blocks share is seen where they are sorted,
and then all blocks are named again under another seed. Every level is a written table, half as large
as the one before, and texts that have one name left take no part in further levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_schema, slices, texts_of, written

#: Bytes of a block, and blocks that a task remembers to have sent.
BLOCK, SENT = 2048, 100_000


def normal(text: str) -> bytes:
    """The bytes that are compared: UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER)


def _blocks(body: bytes, block: int) -> list[bytes]:
    """The blocks of a text, the last one shorter; an empty text has one empty block."""
    return [body[k : k + block] for k in range(0, max(len(body), 1), block)]


def _digest(block: bytes, seed: int, bits: int) -> tuple[int, int]:
    found = xxhash.xxh3_128_intdigest(block, seed) & ((1 << bits) - 1)
    return (found >> 64) - (1 << 63), (found & (1 << 64) - 1) - (1 << 63)


_PARTS = "row long, doc_id long, n_blocks long, text_sha256 string, high array<long>, low array<long>"
_BLOCKS = "high long, low long, block binary"
_NAMES = "high long, low long, name long, clash boolean"


def _cut(docs: DataFrame, block: int, seed: int, bits: int) -> DataFrame:
    """A row for each row of docs, with the digests of its blocks in order."""
    schema = arrow_schema(_PARTS)

    def run(batches):
        for batch in slices(batches):
            sha, high, low = [], [], []
            for text in texts_of(batch):
                body = normal(text)
                found = [_digest(b, seed, bits) for b in _blocks(body, block)]
                sha.append(hashlib.sha256(body).hexdigest())
                high.append([h for h, _ in found])
                low.append([v for _, v in found])
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(map(len, high), pa.int64()), pa.array(sha, pa.string()), pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _PARTS)


def _contents(docs: DataFrame, block: int, seed: int, bits: int) -> DataFrame:
    """The blocks of all texts, those that a task remembers to have sent only once."""
    schema = arrow_schema(_BLOCKS)

    def run(batches):
        sent: set[tuple[int, int, int]] = set()
        for batch in slices(batches):
            out = []
            for text in texts_of(batch):
                for b in _blocks(normal(text), block):
                    high, low = _digest(b, seed, bits)
                    # what is remembered is a second digest under the first, so that a clash still reaches the sort
                    mark = (high, low, xxhash.xxh3_64_intdigest(b, seed + 1))
                    if mark not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(mark)
                        out.append((high, low, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select("text").mapInArrow(run, _BLOCKS)


def _named(blocks: DataFrame) -> DataFrame:
    """(high, low, name, clash) of distinct blocks: each task sorts its blocks and counts them."""
    schema = arrow_schema(_NAMES)

    def run(batches):
        name, last = TaskContext.get().partitionId() << 40, None
        for batch in slices(batches, "block", most_rows=10_000):
            high, low = batch.column("high").to_numpy(), batch.column("low").to_numpy()
            block = batch.column("block").to_pylist()
            new, clash = np.ones(len(block), bool), np.zeros(len(block), bool)
            for k, now in enumerate(zip(high.tolist(), low.tolist(), block, strict=True)):
                if last is not None and now[:2] == last[:2]:
                    clash[k] = now[2] != last[2]
                    new[k] = clash[k]
                last = now
            names = name + np.cumsum(new)
            name = int(names[-1])
            yield pa.RecordBatch.from_arrays([pa.array(high[new]), pa.array(low[new]), pa.array(names[new]), pa.array(clash[new])], schema=schema)

    # blocks of one digest meet in one task, each task's copies of it once
    return blocks.repartition("high", "low").sortWithinPartitions("high", "low", "block").mapInArrow(run, _NAMES)


def _paired(parts: DataFrame) -> DataFrame:
    """(row, place, left, right) of adjacent names; right is -1 where there is none."""
    even = F.col("place") % 2 == 0
    pairs = parts.groupBy("row", F.floor(F.col("place") / 2).alias("place")).agg(
        F.max(F.when(even, F.col("name"))).alias("left"), F.max(F.when(~even, F.col("name"))).alias("right"), F.first("left_over").alias("left_over"))
    return pairs.withColumn("right", F.coalesce("right", F.lit(-1)))


def identities(docs: DataFrame, block: int = BLOCK, bits: int = 128) -> DataFrame:
    """(row, doc_id, text_sha256, n_blocks, name) of docs(doc_id, text): texts are equal but for A-Z where n_blocks and
    name are. The name is an integer with no meaning beyond this table."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seed = 0
    while True:
        names = written(_named(_contents(docs, block, seed, bits)), "block-names")
        if not names.where("clash").take(1):
            break
        seed, bits = seed + 2, 128
    rows = written(_cut(docs, block, seed, bits), "block-rows")
    # left_over counts the names that a row has left at this level
    parts = rows.select("row", F.col("n_blocks").alias("left_over"), F.posexplode(F.arrays_zip("high", "low")).alias("place", "at"))
    parts = parts.select("row", "left_over", F.col("place").cast("long").alias("place"), F.col("at.high").alias("high"), F.col("at.low").alias("low"))
    parts = written(parts.join(names.drop("clash"), ["high", "low"]).select("row", "place", "left_over", "name"), "block-level")
    done = parts.where("left_over = 1").select("row", "name")
    while (live := parts.where("left_over > 1")).take(1):
        pairs = written(_paired(live), "block-pairs")
        # sorted within tasks; written, so a name stays whatever is lost later
        named = pairs.select("left", "right").distinct().sortWithinPartitions("left", "right")
        named = written(named.withColumn("name", F.monotonically_increasing_id()), "block-names")
        parts = written(pairs.join(named, ["left", "right"]).select("row", "place", F.ceil(F.col("left_over") / 2).alias("left_over"), "name"), "block-level")
        done = done.unionByName(parts.where("left_over = 1").select("row", "name"))
    return rows.select("row", "doc_id", "n_blocks", "text_sha256").join(done, "row")


def deduplicate(docs: DataFrame, block: int = BLOCK, bits: int = 128) -> DataFrame:
    """A row for each row of docs(doc_id, text), with the row that stays of those with an equal text.

    Texts are equal when they are identical after lower-casing A-Z. Of equal ones the row with the largest doc_id stays;
    a null id is below all others, and of rows that repeat the largest id one stays. A null text counts as
    empty, and all empty texts are equal. A text of any length is compared whole, block by block. An empty
    table gives no rows. Other columns are not read. `block` is the size of a block in bytes; `bits` of the first
    digest can be lowered to provoke the renaming under another seed."""
    found = written(identities(docs, block, bits), "block-identities")
    last = F.max(F.struct("doc_id", "row")).alias("last")  # a null id sorts first
    groups = found.groupBy("n_blocks", "name").agg(last, F.count("*").alias("group_size"))
    return found.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256")
