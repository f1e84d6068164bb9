"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to `order` bytes, with the counts of what followed each in
the training texts. A byte is predicted by the longest context that has been seen; a byte new to it
costs an escape and passes to the next shorter context, where the bytes already ruled out no longer count
(symbol exclusion). Escapes are estimated by method D: each byte that follows a context gives half of its
first count to the escape. Below order 0 the bytes left are equally likely. Every text ends with a symbol of its own, so texts of all lengths together have
probability one.

Nothing here is broadcast that grows with the corpus. Documents are dealt, in the order in which they are
read, into blocks of bounded bytes. Each block sends its distinct grams (order + 1 bytes) and words with
their counts, packed into one row for each shard; a shard sums them over all blocks, makes its part of the
model and sends each block the values of its own grams and words. A shard holds all grams whose context
ends in the same two bytes, so its part of the trie is complete; the number of shards grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_schema, crc32_mod, slices, text_groups, written

#: Ends a text and stands before its start; this byte is in no UTF-8 text.
EDGE = 0xFF
#: Blocks are worked on in windows of so many bytes, whatever the length of a text.
CHUNK = 2 << 20
_LARGEST_TABLE = 1 << 26


def gram_ranks(a: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of order + 1 bytes in a: the distinct ones as sorted numbers, and which stands where."""
    keys, rank = np.unique(a, return_inverse=True)
    keys, rank = keys.astype(np.uint64), rank.astype(np.int64)
    for k in range(1, order + 1):
        at = (rank[: len(a) - k] << 8) | a[k:]
        size = len(keys) << 8
        if size <= _LARGEST_TABLE:
            seen = np.zeros(-(-size // 64) * 64, dtype=bool)
            seen[at] = True
            used = np.flatnonzero(seen)
            # the rank of a set bit: those in the words before, and those below it in its word
            words = np.packbits(seen, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            word = at >> 6
            below = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            rank = before[word] + np.bitwise_count(below)
        else:
            used, rank = np.unique(at, return_inverse=True)
        keys = (keys[used >> 8] << np.uint64(8)) | (used & 255).astype(np.uint64)
    return keys, rank


class Block:
    """Texts in one row of bytes, each after its edges. Grams are looked at in windows of CHUNK places."""

    def __init__(self, texts: list[bytes], order: int):
        edge = bytes([EDGE])
        self.order = order
        self.bytes = np.frombuffer(b"".join(edge * order + t + edge for t in texts) + edge * order, dtype=np.uint8)
        self.n = np.asarray([len(t) + 1 for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n + order)[:-1]]).astype(np.int64)

    def windows(self):
        """(distinct grams, which stands where, whose text it is, whether it lies within that text)."""
        for s in range(0, len(self.bytes) - self.order, CHUNK):
            part = self.bytes[s : s + CHUNK + self.order]
            keys, rank = gram_ranks(part, self.order)
            place = np.arange(s, s + len(rank))
            owner = np.searchsorted(self.starts, place, side="right") - 1
            yield keys, rank, owner, place < self.starts[owner] + self.n[owner]

    def counts(self, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct grams, sorted, and how often each stands in the texts trained on (0: in none)."""
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for k, rank, owner, valid in self.windows():
            seen = np.bincount(rank[valid], minlength=len(k)) > 0
            keys.append(k[seen])
            counts.append(np.bincount(rank[valid], trained[owner[valid]], minlength=len(k))[seen])
        return _sum_by(np.concatenate(keys), np.concatenate(counts))

    def sums(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum over each text of the values of its grams."""
        out = np.zeros(len(self.n))
        for k, rank, owner, valid in self.windows():
            each = _look(keys, values, k)[rank]
            out += np.bincount(owner[valid], each[valid], minlength=len(out))
        return out


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values, minlength=len(found)).astype(np.int64)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values by key, 0 where the key is missing."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def code_lengths(grams: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after the bytes before it.

    grams must hold, for each pair of last context bytes among them, all grams of the corpus with that
    pair; pairs[b, s] counts byte s after byte b in the whole training text (orders 1 and 0)."""
    mask = [np.uint64((1 << 8 * (k + 1)) - 1) for k in range(order + 1)]
    cells, cell_counts = {}, {}
    for k in range(2, order + 1):
        cells[k], cell_counts[k] = _sum_by(grams & mask[k], counts)
    flat = pairs.reshape(-1).astype(np.int64)
    cells[1], cell_counts[1] = np.arange(65536, dtype=np.uint64), flat
    cells[0], cell_counts[0] = np.arange(256, dtype=np.uint64), pairs.sum(axis=0).astype(np.int64)
    nodes, totals, kinds, shared = {}, {}, {}, {}
    for k in range(order + 1):
        seen = cell_counts[k] > 0
        key, c = cells[k][seen], cell_counts[k][seen]
        nodes[k], totals[k] = _sum_by(key >> np.uint64(8), c)
        kinds[k] = _sum_by(key >> np.uint64(8), np.ones(len(key)))[1]
        if k:  # what the followers of each context count for in the context one byte shorter
            shared[k] = _sum_by(key >> np.uint64(8), _look(cells[k - 1], cell_counts[k - 1], key & mask[k - 1]))[1]
    out = np.zeros(len(grams))
    open_ = np.ones(len(grams), dtype=bool)
    above_n = above_shared = np.zeros(len(grams), dtype=np.int64)
    for k in range(order, -1, -1):
        context = (grams & mask[k]) >> np.uint64(8)
        n, total = _look(nodes[k], kinds[k], context), _look(nodes[k], totals[k], context)
        c = _look(cells[k], cell_counts[k], grams & mask[k])
        left, new = total - above_shared, n - above_n
        hit, miss = open_ & (c > 0), open_ & (c == 0) & (new > 0)
        out[hit] += np.log10((2 * c[hit] - 1) / (2.0 * left[hit]))
        out[miss] += np.log10(new[miss] / (2.0 * left[miss]))
        open_ &= c == 0
        above_n = n
        above_shared = _look(nodes[k], shared[k], context) if k else above_shared
    n0 = len(cells[0][cell_counts[0] > 0])
    out[open_] -= np.log10(max(1, 256 - n0))
    return out


def small(data: bytes) -> bytes:
    """Compressed, after its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def from_small(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(numbers: np.ndarray) -> bytes:
    """Whole numbers as bytes of equal weight side by side, compressed."""
    return small(np.ascontiguousarray(numbers.astype("<i8").view("u1").reshape(-1, 8).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(from_small(data), "u1").reshape(8, -1).T).view("<i8").reshape(-1)


_BLOCKS = "block long, n int, doc_ids binary, null_ids binary, held binary, sizes binary, content binary"
_FACTS = "kind int, shard int, block long, keys binary, counts binary"
_VALUES = "block long, kind int, keys binary, bits binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Kinds of facts: grams, words, and counts of pairs of bytes.
GRAMS, WORDS, PAIRS = 0, 1, 2


def _rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """docs(doc_id, held_out, text) as rows of about block_bytes of text; a longer text is a block of its own."""

    def deal(batches):
        part, done, held, rows = TaskContext.get().partitionId(), 0, 0, []

        def full():
            ids = [d for d, _, _ in rows]
            return _rows(_BLOCKS, [(part << 32 | done, len(rows), np.asarray([d or 0 for d in ids], "<i8").tobytes(), np.asarray([d is None for d in ids]).tobytes(), np.asarray([h for _, h, _ in rows]).tobytes(),
                                    np.asarray([len(t) for *_, t in rows], "<i8").tobytes(), small(b"".join(t for *_, t in rows)))])

        for batch in slices(batches):
            for d, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                t = t.encode("utf-8", "surrogatepass").translate(LOWER)
                if rows and held + len(t) > block_bytes:
                    yield full()
                    done, held, rows = done + 1, 0, []
                rows.append((d, h, t))
                held += len(t)
        if rows:
            yield full()

    return docs.mapInArrow(deal, _BLOCKS)


def _texts(row: dict) -> tuple[list[bytes], np.ndarray]:
    """The texts of a block and which are trained on."""
    ends = np.cumsum(np.frombuffer(row["sizes"], "<i8")).tolist()
    content = from_small(row["content"])
    return [content[a:b] for a, b in zip([0, *ends], ends)], ~np.frombuffer(row["held"], bool)


def _dealt(kind: int, shard: np.ndarray, block: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """A row for each shard with its keys, ascending, as differences."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order].astype(np.int64), counts[order]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)).tolist()
    return [(kind, int(shard[a]), block, planes(np.diff(keys[a:b], prepend=0)), planes(counts[a:b])) for a, b in zip(cuts, cuts[1:])]


def _facts(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """What each block tells each shard: its grams, its words and its pairs of bytes, with training counts."""

    def gather(batches):
        for batch in slices(batches, "content"):
            for row in batch.to_pylist():
                texts, trained = _texts(row)
                grams, counts = Block(texts, order).counts(trained)
                pair, n = np.unique((grams & np.uint64(0xFFFF)).astype(np.int64), return_inverse=True)
                rows = [(PAIRS, 0, row["block"], planes(pair), planes(np.bincount(n, counts, minlength=len(pair))))]
                rows += _dealt(GRAMS, (grams >> np.uint64(8)).astype(np.uint16).astype(np.int64) * 40503 % 65521 % shards, row["block"], grams, counts)
                seen: Counter = Counter()
                for t, y in zip(texts, trained):
                    if y:
                        seen.update(t.split())
                seen[b""] += int(trained.sum())  # ends
                for t, y in zip(texts, trained):
                    if not y:
                        seen.update(dict.fromkeys(t.split(), 0))
                of: dict[int, list[bytes]] = {}
                for w in seen:
                    of.setdefault(zlib.crc32(w) % shards, []).append(w)
                rows += [(WORDS, k, row["block"], b" ".join(own), planes(np.asarray([seen[w] for w in own]))) for k, own in of.items()]
                yield _rows(_FACTS, rows)

    return blocks.mapInArrow(gather, _FACTS)


def _merge(part: pa.Table, order: int, pairs: np.ndarray) -> pa.Table:
    """The values of one shard's grams or words, a row for each block."""
    kind, rows = part.column("kind")[0].as_py(), []
    blocks, keys, counts = (part.column(c).to_pylist() for c in ("block", "keys", "counts"))
    if kind == WORDS:
        c: Counter = Counter()
        for k, n in zip(keys, counts):
            for w, m in zip(k.split(b" "), from_planes(n).tolist()):
                c[w] += m
        rows = [(b, kind, k, small(np.log10([c[w] + 1.0 for w in k.split(b" ")]).tobytes())) for b, k in zip(blocks, keys)]
    else:
        own = [np.cumsum(from_planes(k)) for k in keys]
        found, at = np.unique(np.concatenate(own).astype(np.uint64), return_inverse=True)
        bits = code_lengths(found, np.bincount(at, np.concatenate([from_planes(n) for n in counts]), minlength=len(found)).astype(np.int64), order, pairs)[at]
        cuts = np.cumsum([0, *map(len, own)]).tolist()
        rows = [(b, kind, k, small(bits[s:e].tobytes())) for b, k, s, e in zip(blocks, keys, cuts, cuts[1:])]
    return pa.Table.from_batches([_rows(_VALUES, rows)])


def score(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """Scores every row of docs(doc_id, text), learning from those with crc32(doc_id as text) % folds != held.

    The model codes the bytes of the text with A-Z in lower case, and the end. base_score is that of the
    smoothed counts of words and ends. A null text is empty: the end alone. A null doc_id is trained on.
    A text of any length is scored whole, in windows. Equally long contexts can't tie: there is one of each
    length. Without training rows all bytes are equally likely (1/256) and base_score is that of V = N = 0.
    An empty table gives no rows. Repeated rows count and score each on its own. Other columns are not read.
    """
    shards = max(32, text_groups(docs, "text", block_bytes // 2))
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), folds) == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = written(_blocks(rows, block_bytes), "blocks", "zstd")
    facts = written(_facts(blocks, order, shards), "facts", "zstd")

    def totals(batches):
        """Counts of pairs of bytes over the blocks of a task."""
        seen = np.zeros(65536, dtype=np.int64)
        for batch in batches:
            for k, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                seen[from_planes(k)] += from_planes(n)
        yield _rows("pair long, n long", [(int(k), int(seen[k])) for k in np.flatnonzero(seen)])

    def words_of(part: pa.Table) -> pa.Table:
        c: Counter = Counter()
        for k, n in zip(part.column("keys").to_pylist(), part.column("counts").to_pylist()):
            for w, m in zip(k.split(b" "), from_planes(n).tolist()):
                c[w] += m
        return pa.Table.from_batches([_rows("tokens long, kinds long", [(sum(c.values()), sum(n > 0 for n in c.values()))])])

    pairs = np.zeros((256, 256), dtype=np.int64)
    counted = facts.where(F.col("kind") == PAIRS).select("keys", "counts").mapInArrow(totals, "pair long, n long")
    for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    found = facts.where(F.col("kind") == WORDS).groupBy("shard").applyInArrow(words_of, "tokens long, kinds long").agg(F.sum("tokens"), F.sum("kinds")).first()
    tokens, unit = int(found[0] or 0), float(np.log10((found[0] or 0) + (found[1] or 0) + 1))
    scores_schema = arrow_schema(_SCORES)

    def judge(part: pa.Table, known: pa.Table) -> pa.Table:
        if not part.num_rows:
            return scores_schema.empty_table()
        row = part.to_pylist()[0]
        texts, trained = _texts(row)
        of, keys, bits = {}, [np.zeros(0, np.int64)], [np.zeros(0)]
        for kind, k, v in zip(*(known.column(c).to_pylist() for c in ("kind", "keys", "bits"))):
            v = np.frombuffer(from_small(v))
            if kind == WORDS:
                of.update(zip(k.split(b" "), v.tolist()))
            else:
                keys.append(np.cumsum(from_planes(k)))
                bits.append(v)
        k, v = np.concatenate(keys).astype(np.uint64), np.concatenate(bits)
        by = np.argsort(k)
        total = Block(texts, order).sums(k[by], v[by])
        n_tokens, n_known, base = [], [], []
        for t in texts:
            each = [*map(of.__getitem__, t.split()), of[b""]]
            n_tokens.append(len(each))
            n_known.append(len(each) - each.count(0.0))
            base.append(sum(each) - len(each) * unit)
        return pa.table([
            pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["null_ids"], bool)), pa.array(~trained), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
            pa.array([tokens] * len(texts), pa.int64()), pa.array(base, pa.float64()), pa.array(total)], schema=scores_schema)

    # as many partitions as there are shards, and then blocks: tasks stay equally large as the corpus grows
    dealt = facts.where(F.col("kind") != PAIRS).repartition(2 * shards, "kind", "shard")
    values = dealt.groupBy("kind", "shard").applyInArrow(lambda part: _merge(part, order, pairs), _VALUES)
    n = max(1, blocks.count())
    return blocks.repartition(n, "block").groupBy("block").cogroup(values.repartition(n, "block").groupBy("block")).applyInArrow(judge, _SCORES)
